"""License scans by conditional compression.

Each template of a license is a zstandard raw dictionary. Candidate blocks are the words around a word that every place of a
template's wording must have (one that tells licenses apart, or one of its rarest); each is compressed with the template and without
it. A block that the template makes smaller is a candidate of it, the more the size falls the better: candidates are
ranked by that, and the exact wording confirms them in this order. A template that saves nothing is not looked at further: so the
size reductions choose, and the words only confirm: the template's words must stand there in order but for a small share, and the
words that tell licenses apart (version numbers, clauses such as NC or ND) must be there exactly. A wording of two
words has no others in between: parted, they are too short to be a repetition to a compressor. Sizes are the better of two
levels, since a single one can miss a short repetition. That no wording is lost is tested against confirming
all templates everywhere.

What is reported are the blocks of the text: lines with a cue word, joined with the lines around that have one too, and grown over
the lines of every confirmed wording: texts that are wrapped, or wrapped inside comments, are one block.

Defined results: a null or empty text has no block, nor has one without a cue; a very long text, or a very long line, is read whole,
and time grows with its words, as only the surroundings of telling or rare words are compressed; a null doc_id stays null, one that is no
number is an error (it is cast to long); repeated rows each give their rows; of the templates of one license in a block the one of the largest reduction
stands for it, then the smaller difference, the longer template, the earlier one; other columns are passed over; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings by which public licenses announce themselves, and openings of full texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "License: MIT",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "License: Apache-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "License: GPLv3",
        "Licensed under the GPLv3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "License: GPLv2",
        "Licensed under the GPLv2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Released under BSD-3-Clause License.",
        "Released under the BSD-3-Clause License.",
        "License: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Released under the BSD-2-Clause License.", "License: BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
}
#: What may stand between a cue's words: a line may end there, and a comment's next one begin.
_TO = r"[\s*#/;%|>-]+"
CUES = rf"(?i)licen[sc]|copyright|spdx|warrant|redistribut|permission{_TO}is|permission{_TO}to{_TO}use|public{_TO}domain|creative{_TO}commons"
WORDS = re.compile(r"[0-9A-Za-z]+(?:[.-][0-9A-Za-z]+)*")
#: Words that must agree exactly: they tell one license from another.
_VERSION = r"(?:v?\d[\w.]*|-[\w.-]+)?"
TELLING = re.compile(rf"^(?:v?\d.*|mit|boost|bsl{_VERSION}|apache{_VERSION}|gnu|[al]?gpl{_VERSION}|lesser|affero|bsd{_VERSION}|isc|mpl{_VERSION}|mozilla|cc0?(?:-[\w.-]+)?|by-[\w.-]+|sa|nc|nd|sharealike|.*-(?:only|clause)|attribution(?:-\w+)*|noncommercial|noderivatives|unencumbered)$")
#: Levels of compression whose better result counts.
LEVELS = (3, 19)
OUT = "doc_id long, block long, start long, end long, license string, template int, gain double, missing int, extra int, exact boolean, wording string"


def words(text: str) -> list[str]:
    return [_word(w) for w in WORDS.findall(text)]


def _word(w: str) -> str:
    """Lower case, in one spelling."""
    w = w.lower()
    return w.replace("licenc", "licens") if w.startswith(("licenc", "sublicenc")) else w


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Character spans of candidate blocks before they are grown: runs of lines with cues."""
    begin = last = None
    for m in re.finditer(CUES, text):
        if last is not None and m.end() <= last:
            continue
        a, b = _lines(text, m.start(), m.end())
        if last is not None and a <= last + 1:
            last = max(last, b)
            continue
        if last is not None:
            yield begin, last
        begin, last = a, b
    if last is not None:
        yield begin, last


def _lines(text: str, a: int, b: int) -> tuple[int, int]:
    """The span of the whole lines of a span."""
    end = text.find("\n", b)
    return text.rfind("\n", 0, a) + 1, len(text) if end < 0 else end


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, share: float = 0.15):
        import zstandard as z

        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.share, self.known = share, {}
        self.plain = [z.ZstdCompressor(level=k, **plain) for k in LEVELS]
        self.entries = []
        for name, texts in templates.items():
            for i, t in enumerate(texts):
                want = words(t)
                d = z.ZstdCompressionDict(" ".join(want).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
                self.entries.append((name, i, want, [z.ZstdCompressor(level=k, dict_data=d, **plain) for k in LEVELS]))

    def reduced(self, entry: int, block: str) -> tuple[int, float]:
        """Bytes that a template saves of a block, and their share of its size without it."""
        if (entry, block) not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            raw = block.encode()
            sizes = [(len(a.compress(raw)), len(b.compress(raw))) for a, b in zip(self.plain, self.entries[entry][3], strict=True)]
            self.known[entry, block] = max((a - b, (a - b) / a) for a, b in sizes)
        return self.known[entry, block]

    def limits(self, entry: int) -> tuple[int, int]:
        """Words that a place of a template may lack, and may have in between."""
        m = len(self.entries[entry][2])
        return int(self.share * m), max(2, int(self.share * m)) if m > 2 else 0

    def candidates(self, have: list[str], places: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
        """(entry, first and last place where its wording may begin) around each word that it must have."""
        for i, (_, _, want, _) in enumerate(self.entries):
            lack, add = self.limits(i)
            rare = sorted(range(len(want)), key=lambda k: len(places.get(want[k], ())))
            # a telling word is in every place, and so is one of any lack + 1 words
            telling = [k for k in rare if TELLING.match(want[k])]
            for k in telling[:1] or rare[: lack + 1]:
                for a in places.get(want[k], ()):
                    yield i, max(0, a - k - add), min(len(have) - 1, a - k + lack)

    def ranked(self, have: list[str], places: dict[str, list[int]]) -> list[tuple[int, int, list[int]]]:
        """(bytes saved, entry, places where its wording may begin): candidates that are smaller with the template, the best first."""
        won: dict[int, tuple[int, set[int]]] = {}
        for i, a, b in self.candidates(have, places):
            saved = self.reduced(i, " ".join(have[a : b + len(self.entries[i][2]) + self.limits(i)[1]]))[0]
            if saved > 0:
                most, starts = won.get(i, (0, set()))
                won[i] = max(most, saved), starts | set(range(a, b + 1))
        return sorted(((n, i, sorted(s)) for i, (n, s) in won.items()), key=lambda x: (-x[0], x[1]))

    def confirm(self, have: list[str], starts: list[int], entry: int) -> list[tuple[int, int, int, int, str]]:
        """(first word, end, words missing, words put in between, their wording) of each place of ``starts`` where the template's
        wording is. A place's words may lack and add few words, and no telling one."""
        want, m = self.entries[entry][2], len(self.entries[entry][2])
        lack, add = self.limits(entry)
        count, first, found = Counter(want), set(want[: lack + 1]), []
        for s in starts:
            if s < len(have) and have[s] in first:
                part = have[s : s + m + add]
                if sum((Counter(part) & count).values()) >= m - lack and (got := self.aligned(part, want, lack, add)):
                    n, missing, extra = got
                    found.append((len(missing) + len(extra), s, s + n, len(missing), len(extra), " ".join([f"-{w}" for w in missing] + [f"+{w}" for w in extra])))
        out: list[tuple] = []
        for _, s, e, *rest in sorted(found):
            if all(e <= x[0] or x[1] <= s for x in out):
                out.append((s, e, *rest))
        return sorted(out)

    @staticmethod
    def aligned(have: list[str], want: list[str], lack: int, add: int) -> tuple[int, list[str], list[str]] | None:
        """(words of ``have`` taken, words missing, words put in between) of the start of ``have`` that differs least from
        ``want``, by longest common subsequences that pass over no word that names a version or clause."""
        m, never = len(want), -len(want) - 1
        free = [not TELLING.match(w) for w in want]
        rows = [[0] * (m + 1)]
        for j in range(m):
            rows[0][j + 1] = rows[0][j] if free[j] else never
        best = None
        for e, w in enumerate(have, 1):
            above, skip = rows[-1], not TELLING.match(w)
            row = [above[0] if skip else never]
            for j in range(m):
                x = above[j + 1] if skip else never
                if free[j] and row[j] > x:
                    x = row[j]
                if w == want[j] and above[j] + 1 > x:
                    x = above[j] + 1
                row.append(x if x >= 0 else never)
            rows.append(row)
            n = row[m]
            if n >= 0 and m - n <= lack and e - n <= add and (best is None or m + e - 2 * n < best[0]):
                best = (m + e - 2 * n, e)
        if best is None:
            return None
        i, j, missing, extra = best[1], m, [], []
        while i or j:
            n = rows[i][j]
            if i and j and have[i - 1] == want[j - 1] and rows[i - 1][j - 1] >= 0 and rows[i - 1][j - 1] + 1 == n:
                i, j = i - 1, j - 1
            elif j and free[j - 1] and rows[i][j - 1] == n:
                j -= 1
                missing.append(want[j])
            else:
                i -= 1
                extra.append(have[i])
        return best[1], missing[::-1], extra[::-1]

    def scan(self, text: str) -> list[tuple[int, int, list[tuple[str, int, float, int, int, str]]]]:
        """(start, end, licenses that it announces) of each block; a license is (name, template, gain, missing, extra, wording)."""
        have, at, places = [], [], defaultdict(list)
        for m in WORDS.finditer(text):
            w = _word(m[0])
            places[w].append(len(have))
            have.append(w)
            at.append(m.span())
        found = []
        for _, i, starts in self.ranked(have, places):  # a text may hold several notices: all that the ranking has are confirmed
            for first, end, *got in self.confirm(have, starts, i):
                saved, share = self.reduced(i, " ".join(have[first:end]))
                found.append((*_lines(text, at[first][0], at[end - 1][1]), i, saved, share, got))
        grown: list[list] = []
        for a, b, *place in sorted([*blocks(text), *found], key=lambda x: x[:2]):
            if grown and a <= grown[-1][1]:
                grown[-1][1] = max(grown[-1][1], b)
            else:
                grown.append([a, b, []])
            if place:
                grown[-1][2].append(place)
        return [(a, b, self.chosen(place)) for a, b, place in grown]

    def chosen(self, found: list) -> list[tuple[str, int, float, int, int, str]]:
        """The template that stands for each license found in a block: of the largest reduction; licenses in this order."""
        best: dict[str, tuple] = {}
        for i, saved, share, got in found:
            name, t, want, _ = self.entries[i]
            key = (-saved, got[0] + got[1], -len(want), i)
            if name not in best or key < best[name][0]:
                best[name] = (key, (name, t, round(share, 4), *got))
        return [v for _, v in sorted(best.values(), key=lambda x: (x[0], x[1][0]))]


def scan_licenses(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, block, start, end, license, template, gain, missing, extra, exact, wording): a row for each license that a block
    announces, and one with a null license for a block that no template explains. start and end: characters."""
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        names = [f.split()[0] for f in OUT.split(", ")]
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (a, b, found) in enumerate(scanner.scan(t)):
                    for name, i, gain, missing, extra, wording in found or [(None, None, None, None, None, None)]:
                        rows.append((d, n, a, b, name, i, gain, missing, extra, None if name is None else missing + extra == 0, wording))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where(F.col("t").rlike(CUES)).mapInArrow(run, OUT)
