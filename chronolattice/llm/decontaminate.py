"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised alike: ASCII letters lower-cased, runs of white space one space. A test item of n characters may be
matched with k = floor(errors * n) edits. It is cut into k + 1 pieces: k edits leave one piece whole, so some piece occurs
exactly where the item does. An Aho-Corasick automaton of all pieces reads each document once; every hit gives the
stretch the item would lie in, overlapping stretches of an item are joined, and Myers' bit-parallel algorithm finds
the least edit distance of the whole item to any substring there.

Benchmarks are read in blocks of at most ``block_chars`` characters, each broadcast (that is its bound) and matched against
all documents, so an automaton never outgrows an executor.

Defined results: null or blank items and texts match nothing; items shorter than ``least`` characters are matched exactly and
as whole words (letters and digits do not go on at either end), and one of a single word, which ordinary language holds too,
is reported but drops no document; a null item_id stays null; of equal distances the first place counts; repeated rows
each give their rows; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAPS = re.compile(r"[\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
OUT = "doc_id long, item_id long, distance int, budget int, start long, end long"


def normalise(text: str | None) -> str:
    return GAPS.sub(" ", (text or "").translate(UPPER)).strip(" ")


def budget(n: int, errors: float, least: int) -> int:
    return int(errors * n) if n >= least else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of lengths as even as can be, with their offsets."""
    edge = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edge, edge[1:], strict=False) if b > a]


def myers(item: str, masks: dict[str, int], text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of ``item`` to a substring of ``text`` if it is ``most`` or less, and where the first such
    substring ends."""
    m = len(item)
    high, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, end = score, i + 1
        ph = ph << 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return (best, end) if best <= most else None


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Items ready to be found."""

    def __init__(self, items: list[tuple[int | None, str]], errors: float, least: int, single: bool = True):
        import ahocorasick

        self.items, self.auto, found, self.least = [], ahocorasick.Automaton(), {}, least
        for number, raw in items:
            item = normalise(raw)
            if not item or not (single or " " in item or len(item) >= least):
                continue
            k = budget(len(item), errors, least)
            self.items.append((number, item, k, masks_of(item)))
            for at, piece in pieces(item, k):
                found.setdefault(piece, []).append((len(self.items) - 1, at))
        for piece, uses in found.items():
            self.auto.add_word(piece, (len(piece), uses))
        if found:
            self.auto.make_automaton()
        else:
            self.auto = None

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item number, distance, budget, start, end) of the best match of each item in a normalised text; start is
        the beginning of the stretch it was found in."""
        if self.auto is None or not text:
            return
        near: dict[int, list[int]] = {}
        for last, (size, uses) in self.auto.iter(text):
            for i, at in uses:
                near.setdefault(i, []).append(last + 1 - size - at)
        for i, begins in near.items():
            number, item, k, masks = self.items[i]
            best, n = None, len(item)
            lo = hi = None
            if not k:  # found whole: the first place where no word goes on
                at = next((b for b in sorted(set(begins)) if n >= self.least or not (b and text[b - 1].isalnum() and item[0].isalnum()) and not (text[b + n : b + n + 1].isalnum() and item[-1].isalnum())), None)
                if at is not None:
                    yield number, 0, 0, at, at + n
                continue
            for b in [*sorted(begins), None]:
                if lo is not None and (b is None or b - k > hi):
                    got = myers(item, masks, text[max(0, lo) : hi], k)
                    if got and (best is None or got[0] < best[0]):
                        best = (got[0], max(0, lo), max(0, lo) + got[1])
                    lo = None
                if b is not None:
                    lo, hi = (b - k if lo is None else lo), b + n + k
            if best:
                yield number, best[0], k, best[1], best[2]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", errors: float = 0.08, least: int = 40, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance, budget, start, end): every document and test item found in it, with the best match; start and
    end are character offsets in the normalised text (start: of the stretch that was searched)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    read = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def against(block: int) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, errors, least)
            for batch in batches:
                rows = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    rows += [(d, *m) for m in matcher.matches(normalise(t.as_py()))]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "item_id", "distance", "budget", "start", "end"])

        return read.mapInArrow(run, OUT)

    return reduce(DataFrame.unionByName, [against(b) for b in range(blocks)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", errors: float = 0.08, least: int = 40, block_chars: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows that hold a test item. One pass over the texts for each block of items; nothing is shuffled."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    at = docs.columns.index(text)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = docs.sparkSession.sparkContext.broadcast(sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, errors, least, single=False)
            for batch in batches:
                clean = [next(matcher.matches(normalise(t.as_py())), None) is None for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
