"""Substring deduplication over word windows with a count-min prefilter.

A window is ``width`` consecutive words. A word goes if some window that covers it also starts in a document
with a smaller id. Two passes:

1. every partition counts, for each window, its anchor (the ``gram``-word piece of the window whose name is
   smallest; equal windows have equal anchors, so an anchor occurs at least as often as its window) in a sparse
   count-min sketch. The sketches merge slice by slice; counters saturate at 3; the size is fixed by ``bits``.
2. windows whose anchor is estimated to occur once cannot repeat and go no further. All others are grouped
   exactly by their names (anchor and context, or 96 bits of their own): see ``contexts``. A window that
   a third of all documents hold brings a few rows a batch to its group.

Defined results: a null text has no words; a null doc_id counts as larger than all others; rows that repeat a
doc_id with the same text get the same result, with other texts each their own; ids that are equal never
remove each other's words; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolattice.llm import contexts, sketch
from chronolattice.llm import grams as g
from chronolattice.llm.cluster import partitions, written

LAST = (1 << 63) - 1
MOST = 3


def row_keys(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The two columns that the passes read, with plain names and no null ids."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def text_key(t: Column) -> Column:
    """32 bits of the text in a long's upper half: parts rows that share an id but not their text."""
    return F.shiftleft(F.xxhash64(t), 32)


def _anchored(data, at, a, b, gram, width):
    """Of rows [a, b): word names, words before each row, first words of windows, their anchors' names."""
    lo, hi = int(at[a]), int(at[b])
    starts, ends, counts = g.words(data, at, a, b)
    name = g.names(g.prefix(data[lo:hi]), starts - lo, ends - lo)
    piece = np.zeros(max(0, len(name) - gram + 1), g.U)
    for j in range(gram):
        piece = piece * g.BASE + name[j : j + len(piece)]
    piece = g.mix(piece)
    at_min = g.minimizers(piece, width - gram + 1)
    window, first = g.word_grams(name, counts, width)
    return name, counts, window, first, at_min[first], piece


def window_sketch(docs: DataFrame, width: int, gram: int, bits: int) -> bytes:
    """The merged sketch of anchor counts: two rows of counters, each by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = g.texts(batch.column(1))
            found = []
            for a, b in g.chunks(at):
                _, _, _, _, anchor, piece = _anchored(data, at, a, b, gram, width)
                found.append(_both(piece[np.unique(anchor)], bits))
            if found and (out := sketch.parts(np.concatenate(found), bits)) is not None:
                yield out

    return sketch.table(sketch.merge(docs.mapInArrow(run, "slice int, cells binary"), bits, MOST), bits, MOST)


def _both(name: np.ndarray, bits: int) -> np.ndarray:
    half = np.uint32(1 << (bits - 1))
    return np.concatenate((sketch.cells(name, bits - 1), sketch.cells(g.mix(name ^ g.GOLD), bits - 1) + half))


def _often(table: bytes, name: np.ndarray, bits: int) -> np.ndarray:
    """Whether both counters of a name are 2 at least."""
    t = np.frombuffer(table, np.uint8)
    c = _both(name, bits)
    two = (t[c >> np.uint32(2)] >> ((c & np.uint32(3)) << np.uint32(1)).astype(np.uint8) & np.uint8(3)) >= 2
    return two[: len(name)] & two[len(name) :]


#: A window's name as packed into a context: 96 bits.
PACKED = np.dtype([("h", "<u8"), ("i", "<u4")])
#: Windows that a batch gathers before its contexts are compared with each other.
GATHER = 1 << 20


def _contexts(docs: DataFrame, table, width: int, gram: int, bits: int) -> DataFrame:
    """Contexts of the anchors that are estimated to repeat, and what a batch knows of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            data, at = g.texts(batch.column(1))
            rows, held = [], 0
            for a, b in g.chunks(at):
                name, counts, window, first, anchor, piece = _anchored(data, at, a, b, gram, width)
                if not len(first):
                    continue
                often = _often(table.value, piece[anchor], bits)
                if not often.any():
                    continue
                window, first, anchor = window[often], first[often], anchor[often]
                other = g.mix(name ^ g.GOLD)
                total = np.zeros(len(first), g.U)
                for j in range(width):
                    total = total * g.INVERSE + other[first + j]
                row = np.searchsorted(counts, first, side="right") - 1
                cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1))))
                n = np.diff(np.concatenate((cut, [len(first)])))
                inside = np.arange(len(first)) - np.repeat(cut, n) + np.repeat(first[cut] - anchor[cut] + width, n)
                c = g.mix(np.add.reduceat(g.mix(window + inside.astype(g.U) * g.GOLD), cut) + n.astype(g.U))
                w = np.empty(len(first), PACKED)
                w["h"], w["i"] = window, (g.mix(total) >> g.U(32)).astype(np.uint32)
                packed = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((np.concatenate((cut, [len(first)])) * PACKED.itemsize).astype(np.int32)), pa.py_buffer(w.tobytes())])
                rows.append((piece[anchor[cut]], c, ids[a + row[cut]], keys[a + row[cut]] | (first[cut] - counts[row[cut]]), n, packed))
                held += len(first)
                if held > GATHER:
                    yield from _sent(rows)
                    rows, held = [], 0
            if rows:
                yield from _sent(rows)

    return docs.mapInArrow(run, contexts.OPEN)


def _sent(rows: list) -> Iterator[pa.RecordBatch]:
    *parts, w = zip(*rows, strict=True)
    return contexts.open_rows(*(np.concatenate(x) for x in parts), pa.concat_arrays(w), within=False)


def _windows(ws: list[bytes], ns: np.ndarray):
    all_ = np.frombuffer(b"".join(ws), PACKED)
    n = ns.astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(all_)) - np.repeat(np.cumsum(n) - n, n), all_["h"].copy(), all_["i"].copy()


def repeated_windows(docs: DataFrame, width: int, gram: int, bits: int) -> DataFrame:
    """(d, x, ps, bs) of each document with windows that also start in a smaller one: x is the text key; ps has runs
    (first window, windows), bs packed ones."""
    table = docs.sparkSession.sparkContext.broadcast(window_sketch(docs.select("d", "t"), width, gram, bits))
    open_ = _contexts(docs.select("d", "t", text_key(F.col("t")).alias("k")), table, width, gram, bits)
    dealt = open_.repartition(partitions(docs.sparkSession), "a").sortWithinPartitions("a", "c", "d", "k")
    found = written(dealt.mapInArrow(lambda x: contexts.compare(x, _windows, within=False), contexts.FOUND), "windows")
    single = found.where("kind = 1").select("h", "i", "d", "k").withColumn("least", F.min("d").over(Window.partitionBy("h", "i"))).where("d > least").select("d", "k", F.lit(1).alias("n"))
    runs = found.where("kind = 0").select("d", "k", "n").unionByName(single)
    x = F.shiftright("k", 32).alias("x")
    flags = runs.select("d", x, F.struct(F.col("k").bitwiseAND(contexts.LOW).cast("int").alias("p"), "n").alias("r"), F.lit(None).cast("binary").alias("b")).unionByName(found.where("kind = 2").select("d", x, F.lit(None).cast("struct<p:int,n:int>").alias("r"), "b"))
    return flags.groupBy("d", "x").agg(F.collect_list("r").alias("ps"), F.collect_list("b").alias("bs"))


def covered(ps, bs, n: int, width: int) -> np.ndarray:
    """Which of n items lie in a flagged window."""
    runs = [np.stack((ps.values.field(0).to_numpy(), ps.values.field(1).to_numpy()), 1)] if ps.is_valid and len(ps.values) else []
    runs += [np.frombuffer(x.as_buffer(), np.uint32).reshape(-1, 2) for x in bs.values] if bs.is_valid else []
    if not runs:
        return np.zeros(n, bool)
    r, step = np.concatenate(runs).astype(np.int64), np.zeros(n + 1, np.int64)
    np.add.at(step, r[:, 0], 1)
    np.add.at(step, np.minimum(r[:, 0] + r[:, 1] + width - 1, n), -1)
    return np.cumsum(step[:n]) > 0


def dedup_substrings(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 13, gram: int = 7, bits: int = 28) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed, kept_sha256, spans) of every row.

    ``spans``: [first word, word after the last) of each removed run. ``kept_text``: the words left, joined by
    one space. ``bits``: the sketch has 2**bits two-bit counters (64 MB for 28), whatever the input."""
    if not 1 <= gram <= width:
        raise ValueError("gram must be from 1 to width")
    base = row_keys(docs, text, doc_id)
    flags = repeated_windows(base, width, gram, bits)
    joined = base.withColumn("x", F.shiftright(text_key(F.col("t")), 32)).join(flags, ["d", "x"], "left").select("d", "t", "ps", "bs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = g.texts(batch.column(1))
            ps, bs = batch.column(2), batch.column(3)
            raw = data.tobytes() if len(data) else b""
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i in range(batch.num_rows):
                starts, ends, _ = g.words(data, at, i, i + 1)
                n = len(starts)
                gone = covered(ps[i], bs[i], n, width)
                kept = b" ".join(raw[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist()))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
                for c, v in zip(cols, (kept.decode("utf-8", "replace"), n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), edge.tolist()), strict=True):
                    c.append(v)
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.list_(pa.int64())))], ["d", "kept_text", "n_words", "n_removed", "kept_sha256", "spans"])

    out = joined.mapInArrow(run, "d long, kept_text string, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>")
    return out.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "kept_text", "n_words", "n_removed", "kept_sha256", "spans")
