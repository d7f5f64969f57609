"""Byte-level deduplication by distributed prefix doubling.

A byte goes if a ``length``-byte string that covers it also starts earlier. The classic way ranks all positions by
their first bytes, sorts pairs (rank here, rank further on) at doubled offsets, ranks again, and stops at
positions that are unique or past the threshold. This operator keeps that scheme and thins its rounds:

* a rank need only be equal for equal strings, so names (hashes) stand for ranks: 1, 2, 4 ... 32 bytes, each the
  pair of two names half as long, made where the text is; no round has to send all positions.
* round one sorts 32-byte names, of anchors only: each ``length``-byte string has one, the position in it whose
  32-byte name is smallest, so equal strings have equal anchors. About one byte in 35 is one. Strings whose
  anchor's name is unique are unique.
* round two sorts (32-byte name, name of the anchor's whole context): all strings of an anchor at once.
* round three takes the contexts that differ although their 32 bytes agree and compares their ``length``-byte names,
  past the threshold. A group too large for one task's memory is compared by Spark, string by string.

Defined results: matches never cross documents; a null text is empty; a null doc_id is larger than all others; rows
that repeat id and text get the same result; rows that repeat an id with other texts count as one document after
another in the order of a hash of their text; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolattice.llm import contexts
from chronolattice.llm import grams as g
from chronolattice.llm.cluster import partitions, release, written
from chronolattice.llm.substring_dedup import LAST, covered, row_keys, text_key

#: Bytes of the first sorted names; contexts a batch gathers; strings that one task compares at once.
FIRST, GATHER, GROUP = 32, 1 << 19, 1 << 20


def doubled(data: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length``-byte strings at all positions (length a power of two): each is the pair of two names
    half as long."""
    name, span = g._BYTE[data], 1
    while span < length:
        if len(name) <= span:
            return np.zeros(0, g.U)
        name = name[: len(name) - span] * g.BASE + (name[span:] ^ g.GOLD)
        span *= 2
    return g.mix(name)


def _first_round(docs: DataFrame, length: int, first: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            data, at = g.texts(batch.column(1))
            rows, held = [], 0
            for a, b in g.chunks(at):
                lo, hi = int(at[a]), int(at[b])
                if hi - lo < length:
                    continue
                part, offsets = data[lo:hi], at[a : b + 1] - lo
                name = doubled(part, first)
                anchor = g.minimizers(name, length - first + 1).astype(np.int32)
                # strings that lie in one row
                ok = np.ones(len(anchor) + 1, np.int32)
                step = np.zeros(hi - lo + 2, np.int32)
                cut = np.maximum(offsets[1:] - length + 1, offsets[:-1])
                np.add.at(step, cut, 1)
                np.add.at(step, offsets[1:], -1)
                ok = np.cumsum(step)[: len(anchor)] == 0
                new = np.flatnonzero(ok & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~ok[:-1])))
                if not len(new):
                    continue
                # a row's first string also begins a context, even if its anchor is the last row's
                stop = np.flatnonzero(ok & np.concatenate(((anchor[1:] != anchor[:-1]) | ~ok[1:], [True])))
                n = stop - new + 1
                row = np.searchsorted(offsets, new, side="right") - 1
                sums = g.prefix(part)
                c = g.mix(g.names(sums, new, stop + length) + g.mix((anchor[new] - new).astype(g.U) * g.U(1 << 20) + n.astype(g.U)))
                rows.append((name[anchor[new]], c, ids[a + row], keys[a + row] | (new - offsets[row]), n))
                held += len(n)
                if held > GATHER:
                    yield from _sent(rows)
                    rows, held = [], 0
            if rows:
                yield from _sent(rows)

    return docs.mapInArrow(run, contexts.OPEN)


def _sent(rows: list) -> Iterator[pa.RecordBatch]:
    parts = [np.concatenate(x) for x in zip(*rows, strict=True)]
    return contexts.open_rows(*parts, pa.nulls(len(parts[0]), pa.binary()), within=True)


def _cut_out(docs: DataFrame, length: int) -> DataFrame:
    """Contexts' bytes: rows (a, d, k, n, w) from documents with lists of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = g.texts(batch.column(1))
            raw = memoryview(data)
            ids, keys, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
            for s in range(0, batch.num_rows, 64):
                part = lists.slice(s, 64)
                per = np.diff(part.offsets.to_numpy())
                flat = part.flatten()
                a, p, n = (flat.field(i).to_numpy() for i in range(3))
                row = s + np.repeat(np.arange(len(per)), per)
                start = at[row] + p
                w = [bytes(raw[i:j]) for i, j in zip(start.tolist(), (start + n + length - 1).tolist())]
                yield contexts.batch_of("a long, d long, k long, n int, w binary", len(row), a=a, d=ids[row], k=keys[row] | p, n=n, w=pa.array(w, pa.binary()))

    return docs.mapInArrow(run, "a long, d long, k long, n int, w binary")


def _third_round(rows: DataFrame, length: int, group: int) -> DataFrame:
    """Strings of contexts with one anchor, compared by name: rows of kind 0 (runs of repeats), and of kind 1 where a
    group has more than ``group`` strings."""

    def named(a, d, k, n, w):
        data = np.frombuffer(b"".join(w), np.uint8)
        size = n + length - 1
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        sums = g.prefix(data)
        h = g.names(sums, begin[row] + at, begin[row] + at + length)
        return row, at, h

    def settle(a, d, k, n, w) -> Iterator[pa.RecordBatch]:
        row, at, h = named(a, d, k, n, w)
        order = np.lexsort((k[row] + at, d[row], h, a[row]))
        r, t, h = row[order], at[order], h[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (a[r[1:]] != a[r[:-1]])))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (d[r] > d[r[head]]) | (k[r] + t > k[r[head]] + t[head])
        flag = np.zeros(len(row), bool)
        flag[order] = gone
        on = np.flatnonzero(flag)
        if len(on):
            cut = np.flatnonzero(np.concatenate(([True], (on[1:] != on[:-1] + 1) | (row[on[1:]] != row[on[:-1]]))))
            n2 = np.diff(np.concatenate((cut, [len(on)])))
            p = on[cut]
            yield contexts.batch_of(contexts.FOUND, len(p), kind=np.zeros(len(p), np.int8), d=d[row[p]], k=k[row[p]] + at[p], n=n2.astype(np.int32))

    def single(a, d, k, n, w) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(a), 20_000):
            e = slice(s, s + 20_000)
            row, at, h = named(a[e], d[e], k[e], n[e], w[e])
            i = (g.mix(h ^ a[e][row].view(g.U)) >> g.U(32)).astype(np.uint32)
            yield contexts.batch_of(contexts.FOUND, len(row), kind=np.ones(len(row), np.int8), h=h.view(np.int64), i=i.view(np.int32), d=d[e][row], k=k[e][row] + at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        large = None  # the anchor whose group is being sent to Spark
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)] + [np.array(batch.column(4).to_pylist(), object)]
            if large is not None:
                m = int(np.searchsorted(now[0] != large, True)) if (now[0] == large).any() else 0
                if m:
                    yield from single(*[x[:m] for x in now])
                now = [x[m:] for x in now]
                if not len(now[0]):
                    continue
                large = None
            held = now if held is None else [np.concatenate((x, y)) for x, y in zip(held, now, strict=True)]
            if held[3].sum() < group // 4:
                continue
            a = held[0]
            last = int(len(a) - np.searchsorted(a[::-1] != a[-1], True)) if (a != a[-1]).any() else 0
            if last:
                yield from settle(*[x[:last] for x in held])
                held = [x[last:] for x in held]
            if held[3].sum() > group:
                yield from single(*held)
                large, held = held[0][-1], None
        if held is not None and len(held[0]):
            yield from settle(*held)

    return rows.mapInArrow(run, contexts.FOUND)


def dedup_bytes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = 100, group: int = GROUP) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; ``kept``: the bytes left; ``spans``: [first
    byte, byte after the last) of each maximal removed run."""
    first = FIRST
    while first > length:
        first //= 2
    spark = docs.sparkSession
    base = row_keys(docs, text, doc_id)
    n = partitions(spark)
    keyed = base.withColumn("k", text_key(F.col("t")))
    low, x = F.col("k").bitwiseAND(contexts.LOW).cast("int"), F.shiftright("k", 32)
    dealt = _first_round(keyed.select("d", "t", "k"), length, first).repartition(n, "a").sortWithinPartitions("a", "c", "d", "k")
    found = written(dealt.mapInArrow(lambda b: contexts.compare(b, None, within=True), contexts.FOUND), "anchors")
    del dealt
    release(spark)
    closer = found.where("kind = 3").groupBy("d", x.alias("x")).agg(F.collect_list(F.struct(F.col("h").alias("a"), low.alias("p"), "n")).alias("l"))
    with_text = keyed.withColumn("x", x).join(closer, ["d", "x"]).select("d", "t", "k", "l")
    cut = _cut_out(with_text, length).repartition(n, "a").sortWithinPartitions("a", "d", "k")
    strings = written(_third_round(cut, length, group), "strings")
    del closer, with_text, cut
    release(spark)
    w = Window.partitionBy("h", "i")
    rest = strings.where("kind = 1").select("h", "i", "d", "k").withColumn("least", F.min(F.struct("d", "k")).over(w)).where(F.struct("d", "k") > F.col("least")).select("d", "k", F.lit(1).alias("n"))
    runs = found.where("kind = 0").select("d", "k", "n").unionByName(strings.where("kind = 0").select("d", "k", "n")).unionByName(rest)
    flags = runs.select("d", x.alias("x"), F.struct(low.alias("p"), "n").alias("r"), F.lit(None).cast("binary").alias("b")).unionByName(found.where("kind = 2").select("d", x.alias("x"), F.lit(None).cast("struct<p:int,n:int>").alias("r"), "b"))
    flags = flags.groupBy("d", "x").agg(F.collect_list("r").alias("ps"), F.collect_list("b").alias("bs"))
    joined = keyed.withColumn("x", x).join(flags, ["d", "x"], "left").select("d", "t", "ps", "bs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = g.texts(batch.column(1))
            ps, bs = batch.column(2), batch.column(3)
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for i in range(batch.num_rows):
                own = data[at[i] : at[i + 1]]
                gone = covered(ps[i], bs[i], len(own), length)
                kept = own[~gone].tobytes()
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
                for c, v in zip(cols, (kept, len(own), int(gone.sum()), len(edge), hashlib.sha256(kept).hexdigest(), edge.tolist()), strict=True):
                    c.append(v)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["d", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = joined.mapInArrow(run, "d long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
    return out.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
