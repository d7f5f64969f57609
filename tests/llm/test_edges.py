"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: no operator may fail on them."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from chronolattice.llm.decontaminate import contaminated, drop_contaminated
from chronolattice.llm.html_extract import extract, extract_pages
from chronolattice.llm.jaccard_join import jaccard_join, jaccard_links, keep_representatives
from chronolattice.llm.license_scan import TEMPLATES, scan_licenses
from chronolattice.llm.mixture import mix_sources, mixed_documents
from chronolattice.llm.outliers import quality_rules
from chronolattice.llm.quality_mil import classify_quality, keep_good
from chronolattice.llm.queries import tokenizer_path
from chronolattice.llm.substring_dedup import dedup_substrings
from chronolattice.llm.suffix_dedup import dedup_bytes
from chronolattice.llm import license_scan, token_coder
from chronolattice.llm.token_coder import BLOCK, Words, decode_frame, encode_documents, encode_frames, read_tokens

GAP = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, n string, x0 string, d string, t string, k long, `group` string, mix string, kept string, h long"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.integers(30)) for _ in range(n))


BASE = prose(1, 200)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("lorem", "Lorem ", 2) + " tail"), (3, BASE.replace("lorem", "Lorem ", 2) + " tail"), (4, None), (5, ""), (6, " \n\t "), (None, BASE), (None, None), (7, "one two"), (8, "ONE two"), (9, prose(2, 30_000)),
    (10, "x" * 5000), (11, "naïve — £ 漢字 \x1c  ok\r\nline\x0bline " * 20), (12, prose(3, 60) + " " + BASE[300:900]), (12, "another text of the same id"), (13, "und " * 400), (14, prose(4, 80) + "\nReleased under the MIT License.\n" + prose(5, 20)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else f"s{n % 3}", None, 3, 0.1, "n", "x", "d", "t", 5, "g", "m", "k", 1) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, None, None), (None, 1, 0), (13, 0, 0), (13, 0, 0), (10, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")


def rank(i):
    return 1 << 62 if i is None else i


def test_windows(docs, nothing):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(docs).collect())
    first = {}
    for i, t in TEXTS:
        w = GAP.findall(t or "")
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, 1 << 63), rank(i))
    want = collections.Counter()
    for i, t in TEXTS:
        w = GAP.findall(t or "")
        gone = {p + j for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < rank(i) for j in range(13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want
    assert dedup_substrings(nothing).count() == 0


def brute_bytes(length):
    order = sorted({(rank(i), t or "") for i, t in TEXTS}, key=lambda x: x[0])
    by_id = collections.defaultdict(list)
    for i, t in order:
        by_id[i].append(t)
    seen, out = set(), {}
    for i in sorted(by_id):
        if len(by_id[i]) > 1:  # rows that share an id: the order is a hash's, so look at what both orders agree on
            for t in by_id[i]:
                out[i, t] = None
            for t in by_id[i]:
                b = t.encode()
                seen |= {b[p : p + length] for p in range(len(b) - length + 1)}
            continue
        b = by_id[i][0].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        out[i, by_id[i][0]] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("group", [1 << 20, 200])
def test_bytes(docs, nothing, group):
    want = brute_bytes(100)
    rows = dedup_bytes(docs, group=group).collect()
    assert len(rows) == len(TEXTS)
    got = collections.defaultdict(set)
    for r in rows:
        got[rank(r.doc_id)].add((r.n_bytes, r.n_removed, r.kept_sha256))
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    for (i, _), w in want.items():
        assert w is None or w in got[i], i
    assert dedup_bytes(nothing).count() == 0


@pytest.mark.parametrize("chunk", [4096, 1])
def test_jaccard(docs, nothing, chunk):
    sets = []
    for i, t in TEXTS:
        w = GAP.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, frozenset(tuple(w[p : p + 4]) for p in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 85 * (len(sets[a][1]) + len(sets[b][1]) - both):
                root[find(a)] = find(b)
    want = collections.Counter()
    for n, (i, s) in enumerate(sets):
        least = min(rank(sets[m][0]) for m in range(len(sets)) if find(m) == find(n))
        want[i, len(s), None if least == 1 << 62 else least] += 1
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(docs, width=4, num=85, den=100, chunk=chunk).collect())
    assert got == want
    assert jaccard_join(nothing).count() == 0
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 7, 9, 10, 12} and kept.where("doc_id in (2, 3)").count() == 0
    assert keep_representatives(nothing).count() == 0


@pytest.mark.parametrize("chunk", [4096, 40])
def test_links(spark, docs, nothing, chunk):
    # near copies in a chain and a crowd: the ends of a component are not all alike
    words = BASE.split()
    near = [(100 + i, " ".join([*words[: 2 * (i % 40)], *(f"w{i}x{k}" for k in range(i % 3)), *words[2 * (i % 40) + i % 5 :]])) for i in range(90)]
    near += [(300, BASE.upper()), (301, "  " + BASE)]
    rows = [(i, t) for i, t in TEXTS] + near
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {}
    for _, t in rows:
        w = GAP.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[t] = frozenset(tuple(w[p : p + 4]) for p in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
    like = lambda a, b: bool(a & b) and 100 * len(a & b) >= 85 * len(a | b)
    number = {t: sum(like(s, o) for u, o in sets.items() if u != t) for t, s in sets.items()}
    got = jaccard_join(table, width=4, num=85, den=100, chunk=chunk).collect()
    assert collections.Counter((r.doc_id, r.n_links) for r in got) == collections.Counter((i, number[t]) for i, t in rows)
    distinct = set(sets.values())
    want = sum(like(a, b) for a in distinct for b in distinct if a != b) // 2
    pairs = [tuple(r) for r in jaccard_links(table, width=4, num=85, den=100, chunk=chunk).collect()]
    assert len(pairs) == len(set(pairs)) == want > len(distinct) and all(a < b for a, b in pairs)
    assert {x for p in pairs for x in p} <= {r.set_id for r in got}
    assert jaccard_links(nothing).count() == 0


def test_representatives_of_repeated_and_null_ids(spark):
    near = BASE + " tail"
    rows = [(12, BASE), (12, "another text of the same id"), (20, near), (None, prose(21, 90)), (None, prose(21, 90) + " tail")]
    kept = keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # each text of a repeated id stays, and of two near copies without ids one
    assert len(kept) == 3 and {(12, BASE), (12, "another text of the same id")} < {tuple(r) for r in kept}


def test_rules(docs, nothing):
    rows = quality_rules(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.n == "n" and r.size == 3
    want = collections.Counter()
    for i, t in TEXTS:
        t = t or ""
        w = GAP.findall(t)
        lines = [x for x in t.split("\n") if GAP.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {p + j for p in range(len(w) - 2) if c[w[p], w[p + 1], w[p + 2]] > 1 for j in range(3)}
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(not r.kept for r in rows if r.base_failed)
    assert quality_rules(nothing).count() == 0


def test_rules_of_a_null_source(spark):
    # two languages with the same texts and groups: a null source is judged by its own estimate, as a named one is
    rows = [(i, prose(i, 80) + " #" * (0 if i % 3 else 12), g, "s" if i % 3 else o) for i in range(300) for g, o in (("en", None), ("fr", "o"))]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    by = {g: {r.doc_id: r.distance for r in got if r.lang == g} for g in ("en", "fr")}
    assert len(by["en"]) == 300 and by["en"] == by["fr"]


def test_mix(docs, nothing):
    rows = mix_sources(docs, untaken=True).collect()
    sizes, total = collections.Counter(), collections.Counter()
    for n, (_, t) in enumerate(TEXTS):
        sizes[None if n % 7 == 0 else f"s{n % 3}"] += len(GAP.findall(t or ""))
    targets = {r.source: r.mix.target for r in rows}
    for r in rows:
        total[r.source] += r.mix.words
        assert r.mix.source_size == sizes[r.source]
    assert all(abs(total[s] - targets[s]) < 1 for s in targets) and sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert all(targets[s] <= 3 * sizes[s] + 1e-6 for s in targets)
    out = mixed_documents(docs)
    assert out.columns == docs.columns and sum(len(GAP.findall(r.text or "")) for r in out.collect()) == sum(total.values())
    assert mix_sources(nothing).count() == 0 and mixed_documents(nothing).count() == 0


def test_classifier(docs, labels, nothing):
    rows = classify_quality(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in rows)
    assert {r.score for r in classify_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert classify_quality(nothing, labels).count() == 0 and keep_good(nothing, labels).count() == 0
    assert keep_good(docs, labels).columns == docs.columns


def test_benchmark(spark, docs, nothing):
    passage = BASE[100:400]
    edited = passage[:50] + "Q" + passage[51:120] + passage[123:]
    items = spark.createDataFrame([(1, edited), (2, None), (3, ""), (4, "   "), (5, "ONE  TWO"), (6, prose(77, 40)), (1, edited)], "item_id long, text string")
    for chars in (4_000_000, 100):
        got = {(r.doc_id, r.item_id) for r in contaminated(docs, items, block_chars=chars).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (7, 5), (8, 5)} or got == {(1, 1), (2, 1), (3, 1), (None, 1), (7, 5), (8, 5), (12, 1)}
        kept = drop_contaminated(docs, items, block_chars=chars)
        assert kept.columns == docs.columns and not {1, 2, 3, 7, 8, None} & ({r.doc_id for r in kept.where("text is not null").collect()})
    assert contaminated(nothing, items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def test_licenses(docs, nothing):
    assert [(r.doc_id, r.license, r.exact) for r in scan_licenses(docs).collect()] == [(14, "MIT", True)]
    assert scan_licenses(nothing).count() == 0


def test_licenses_of_one_block(spark):
    # more notices than any leading few, in one long line
    names = [k for k, v in TEMPLATES.items() if v[0].startswith(("Released", "Licensed", "This work"))]
    line = " ".join(TEMPLATES[k][0] for k in names)
    two = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. The bundled code is Released under the MIT License."
    rows = scan_licenses(spark.createDataFrame([(1, line), (2, two), (3, two.replace("MIT", "")), (4, f"{prose(6, 900)} {two}")], "doc_id long, text string")).collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r.license)
        assert r.exact
    assert sorted(got[1]) == sorted(names) and sorted(got[2]) == sorted(got[4]) == ["CC-BY-NC-4.0", "MIT"] and got[3] == ["CC-BY-NC-4.0"]


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Copyright (c) 2020, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
FREE = "This is free and unencumbered software released into the public\ndomain."


def test_wrapped_licenses(spark):
    commented = "int x;\n" + "\n".join(f" * {x}" for x in ISC.split("\n")) + "\nint y;"
    texts = [MIT, BSD, ISC, FREE, commented, f"Copyright A.\n{prose(8, 30)}\nReleased under the MIT License.\n{prose(9, 30)}\nReleased under the MIT License."]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = [[(r.license, r.exact) for r in rows if r.doc_id == i and r.license] for i in range(len(texts))]
    assert got == [[("MIT", True)], [("BSD-3-Clause", True)], [("ISC", True)], [("Unlicense", True)], [("ISC", True)], [("MIT", True), ("MIT", True)]]
    grant = next(r for r in rows if r.doc_id == 0 and r.license)
    assert MIT[grant.start : grant.end].startswith("Permission") and MIT[grant.start : grant.end].endswith("the Software is")
    # lines with cues that no template explains stay blocks of their own
    assert [r.license for r in sorted(rows, key=lambda r: r.block) if r.doc_id == 5] == [None, "MIT", "MIT"]


def test_announcements(spark):
    lines = {
        "This code comes under the MIT licence.": None, "Licensed under the MIT licence.": "MIT", "License: GPLv3": "GPL-3.0", "Released under BSD-3-Clause license": "BSD-3-Clause", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "Licensed by Foo under the MIT License.": "MIT", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC 3.0.": None, "Licensed under the Apache License, Version 1.1.": None,
        "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "": None, "a licence to print money": None,
    }
    rows = scan_licenses(spark.createDataFrame([*enumerate(lines), (None, "License: MIT"), (None, None)], "doc_id long, text string")).collect()
    got = {r.doc_id: r.license for r in rows if r.license}
    assert got == {**{i: v for i, v in enumerate(lines.values()) if v}, None: "MIT"}


def test_every_template_announces_itself(spark):
    from chronolattice.llm.license_scan import Scanner

    scanner, all_ = Scanner(), [(k, t) for k, ts in TEMPLATES.items() for t in ts]
    for name, t in all_:  # against a plain search for each wording
        plain = {k for k, u in all_ if u.lower() in t.lower()}
        assert name in {x[0] for _, _, found in scanner.scan(f"First line.\n{t}\nLast line.") for x in found} >= plain


def everywhere(scanner, text):
    """All that exact wording confirms, without any compression: every template at every word."""
    have = license_scan.words(text)
    return {(scanner.entries[i][0], i, s, e) for i in range(len(scanner.entries)) for s, e, *_ in scanner.confirm(have, list(range(len(have))), i)}


def chosen(scanner, text):
    have, places = license_scan.words(text), collections.defaultdict(list)
    for i, w in enumerate(have):
        places[w].append(i)
    return {(scanner.entries[i][0], i, s, e) for _, i, starts in scanner.ranked(have, places) for s, e, *_ in scanner.confirm(have, starts, i)}


def test_compression_loses_no_wording():
    scanner, rng = license_scan.Scanner(), np.random.default_rng(12)
    other = "work software under the of and a is der mit de license code permission terms this".split() + WORDS
    for _ in range(400):
        parts = []
        for _ in range(rng.integers(1, 4)):
            _, _, want, _ = scanner.entries[rng.integers(len(scanner.entries))]
            want, lack = list(want), int(0.15 * len(want))
            for _ in range(rng.integers(0, lack + 1)):
                free = [k for k, w in enumerate(want) if not license_scan.TELLING.match(w)]
                del want[rng.choice(free)]
            for _ in range(rng.integers(0, max(2, lack) + 1)):
                want.insert(rng.integers(0, len(want) + 1), rng.choice(other))
            parts += [*rng.choice(other, rng.integers(0, 5)), *want]
        text = " ".join(parts)
        found = everywhere(scanner, text)
        assert chosen(scanner, text) == found
        listed = {x[0] for _, _, block in scanner.scan(text) for x in block}
        assert listed == {x[0] for x in found}


def test_compression_chooses(monkeypatch):
    text = "Some lines.\nReleased under the MIT License.\nMore of them. License: GPLv3"
    assert {x[0] for _, _, b in license_scan.Scanner().scan(text) for x in b} == {"MIT", "GPL-3.0"}
    monkeypatch.setattr(license_scan.Scanner, "reduced", lambda self, entry, block: (0, 0.0))
    assert {x[0] for _, _, b in license_scan.Scanner().scan(text) for x in b} == set()


def test_distance_against_brute_force():
    from chronolattice.llm.decontaminate import Matcher, budget, normalise

    def least(item, text):  # the table of all distances of the item to substrings
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    rng = np.random.default_rng(7)
    items = ["".join(rng.choice(list("ab c"), n)) for n in rng.integers(10, 60, 60)]
    texts = []
    for item in items:
        t = list(item)
        for _ in range(rng.integers(0, 4)):
            p = rng.integers(0, len(t))
            t[p : p + rng.integers(0, 2)] = rng.choice(list("abcx"), rng.integers(0, 2))
        texts.append("".join(rng.choice(list("ab c"), rng.integers(0, 30))) + "".join(t) + "".join(rng.choice(list("xyz "), rng.integers(0, 30))))
    matcher = Matcher(list(enumerate(items)), 0.1, 12)
    for text in map(normalise, texts):
        got = {number: distance for number, distance, *_ in matcher.matches(text)}
        for number, raw in enumerate(items):
            item = normalise(raw)
            k = budget(len(item), 0.1, 12)
            d = least(item, text) if item else 1 << 30
            if len(item) >= 12:
                assert got.get(number) == (d if d <= k else None), (item, text)


def test_short_and_nameless_items(spark):
    docs = spark.createDataFrame([(1, "cats and a dog"), (2, "scatter"), (3, "nothing here"), (4, "good dogs")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "cats and"), (7, "a"), (8, "dog")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(1, None), (1, 7), (1, 8)}
    assert {r.doc_id for r in drop_contaminated(docs, items).collect()} == {2, 3, 4}


@pytest.mark.parametrize("cells", [4_000_000, 1])
def test_tokens(spark, docs, nothing, tmp_path, monkeypatch, cells):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_coder, "CELLS", cells)  # of 1: frames of one block, which long documents go over
    tok = Tokenizer.from_file(tokenizer_path())
    path = str(tmp_path / "tokens")
    rows = sorted(encode_documents(docs, tokenizer=tokenizer_path(), path=path, shards=2).collect(), key=lambda r: r.start)
    start, want = 0, collections.Counter()
    for i, t in TEXTS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want[i, len(ids) // 4, zlib.crc32(ids)] += 1
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [rank(r.doc_id) for r in rows] == sorted(rank(i) for i, _ in TEXTS)
    assert sum(len(bytes(r.ids)) // 4 for r in read_tokens(spark, path, ids=True).collect()) == start
    assert encode_documents(nothing, tokenizer=tokenizer_path()).count() == 0


def test_tokens_of_one_id(spark, tmp_path):
    rows = [(None, prose(i, 40)) for i in range(400)]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokenizer=tokenizer_path(), path=str(tmp_path / "t"), shards=4)
    by = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert sum(by) == 400 and len(by) == 4 and max(by) < 200  # rows without an id are not all in one shard


def test_frames_round_trip():
    rng = np.random.default_rng(5)
    cases = [rng.integers(0, 49408, 3000), np.zeros(5000, np.int64), np.array([49407]), np.tile(rng.integers(0, 900, 37), 400), rng.zipf(1.3, 3 * BLOCK + 5) % 49408, rng.integers(0, 49408, 5 * BLOCK)]
    for ids in cases:
        frames = encode_frames(ids, 49408)
        assert (np.concatenate([b for _, f in frames for b in decode_frame(f)]) == ids).all() and sum(n for n, _ in frames) == len(ids)
    frame = encode_frames(cases[4], 49408)[0][1]
    whole = decode_frame(frame)
    assert [len(b) for b in whole] == [BLOCK, BLOCK, BLOCK, 5]
    for j in range(4):  # a block reads alone, too
        assert (decode_frame(frame, [j])[0] == whole[j]).all()
    assert encode_frames(np.zeros(0, np.int64), 49408) == []
    assert len(encode_frames(cases[1], 49408)[0][1]) < 250 and len(encode_frames(cases[3], 49408)[0][1]) < 2500
    for at in (2, 40, len(frame) // 2):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            decode_frame(bytes(bad))
    with pytest.raises(ValueError):
        encode_frames(np.array([49408]), 49408)


def test_coder_beats_a_general_compressor(spark):
    import zstandard

    texts = [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids = np.frombuffer(b"".join(x + b"\x02\0\0\0" for x in Words(tokenizer_path()).ids(texts)), "<u4")
    own = 8 * sum(len(f) for _, f in encode_frames(ids.astype(np.int32), 49408)) / len(ids)
    zstd = zstandard.ZstdCompressor(level=3)
    general = 8 * sum(len(zstd.compress(ids[a : a + BLOCK].astype("<u2").tobytes())) for a in range(0, len(ids), BLOCK)) / len(ids)
    assert own < 9 and own < 0.9 * general


def test_words_of_other_tokenizers():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")  # keeps white space
    words, tok, texts = Words(path), Tokenizer.from_file(path), ["a  b\n c", "", "the end. "]
    assert not words.by_word and Words(tokenizer_path()).by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in words.ids([t.encode() for t in texts])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body><header class="site"><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept them all, please, or read on.</div><main><article><h1>A title &amp; more</h1><p>First paragraph of the text,\n with a <b>bold</b> word and &eacute;&#x20AC;.
<p>Second paragraph, not closed<br>and its second line goes on for a while.<aside class="related"><p>Related: <a href=x>other story you might like</a></p></aside><ul><li>A point in the text.</li><li>One more point, longer than the first.</li></ul>
<form><label>Mail</label><input name=q><button>Send</button></form><script>var a = "</p><p>never";</script></article><section id="comments"><p>A reader's comment that is quite long, and has commas, too.</p></section></main>
<div class="ad">Buy this product now. It is very good, really, and cheap as well.</div><footer>&copy; 2020 Someone, all rights reserved.</footer></body></html>"""


def test_pages(spark):
    assert extract(PAGE) == "A title & more\n\nFirst paragraph of the text, with a bold word and é€.\n\nSecond paragraph, not closed and its second line goes on for a while.\n\nA point in the text.\n\nOne more point, longer than the first."
    odd = ["", None, "plain text only, without any tag at all, but long enough to be one.", "<", "<p", "</p></div>", "<div>" * 3000 + "deep text that is long enough, surely." + "</div>" * 3000, "<p>a &#0; &#xFFFFFFF; &nope; b, and more words here.</p>", "<script>never", "<p>x</p>" * 4000]
    rows = extract_pages(spark.createDataFrame([(i, "u", h, "extra") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")).collect()
    assert len(rows) == len(odd) and all(r.n_chars == len(r.text) for r in rows) and rows[0].text == rows[1].text == ""
    assert rows[2].text == odd[2] and "deep text" in rows[6].text
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if n < 4:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.toPandas(), docs.schema)
            assert 0 < docs.count() <= 300
    assert out.count() == docs.count()
