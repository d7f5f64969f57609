"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks: its documents are ordered by a keyed hash (the same in every run) and dealt into
buckets by the hash's range. A source's target is a number of words; it is met by whole passes over all its
documents plus one part of a pass, which ends inside one document at most. What a pass takes of a bucket is a
block. The numbers of blocks of all sources are split among the output shards by a binary tree: at each node the
left half's share of every source is one multivariate-hypergeometric draw, so quotas are exact and every way to
deal the blocks is equally likely. A source's blocks are permuted and each shard takes its own disjoint run of
that permutation; inside a shard rows are ordered by another keyed hash.

Texts are read once, for sizes and keys; all the rest works on a table of a few numbers a row. No step gathers a source
in one task: running sums and places go over ranges of buckets first and then inside a range. The tree is walked on
the executors, one path a shard. A bucket has ``bucket_docs`` documents on average, or as many more as keep all blocks
under BLOCKS, up to which a draw is exact; so every size is drawn alike.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a source without words
gets target 0; null and repeated doc_ids are rows like others, and every row counts and stays, rows that are equal in all
columns included; ties of the keyed hash go by a hash of the whole row; an empty table gives an empty result; other columns
stay as they are, but for one named mix, which the result replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolattice.llm.cluster import partitions, written

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of all sources at most (numpy draws from fewer than 10**9), and buckets or blocks of a range.
BLOCKS, RANGE = 900_000_000, 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of all sizes by weight; none is above ``most`` times its own size, and what that leaves over goes to
    the others by weight, until none is above."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in set(free))
        weight = sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        for i in over or free:
            out[i] = most * sizes[i] if over else share[i]
        free = [i for i in free if i not in set(over)] if over else []
    return out


def _hash(seed: int, docs: DataFrame, names: Sequence[str]) -> Column:
    """A hash of columns that tells nulls apart; maps go as text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    quoted = [F.col(f"`{n}`") for n in names]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in quoted])
    return F.xxhash64(F.lit(seed), nulls, *[F.to_json(F.struct(c)) if "map<" in kinds[n] else c for n, c in zip(names, quoted, strict=True)])


def source_plan(slim: DataFrame, cycle: Sequence[float], most: float, bucket_docs: int) -> DataFrame:
    """(s, source_size, target, buckets): one row a source. Sources are few against documents; they are ranked and
    given targets in one task."""
    sums = slim.groupBy("s").agg(F.sum("size").alias("z"), F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            p = pd.concat(got)
            rows = sorted(((s is None or pd.isna(s)), "" if s is None or pd.isna(s) else s, int(z), int(n)) for s, z, n in zip(p.s, p.z, p.n))
            out = targets([r[2] for r in rows], [cycle[i % len(cycle)] for i in range(len(rows))], most)
            # a document is in most + 1 blocks at most
            each = max(bucket_docs, -(-sum(r[3] for r in rows) * (int(most) + 1) // (BLOCKS - (int(most) + 1) * len(rows))))
            yield pd.DataFrame({"s": [None if r[0] else r[1] for r in rows], "source_size": [r[2] for r in rows], "target": out, "buckets": [-(-r[3] // each) for r in rows]})

    return sums.coalesce(1).mapInPandas(run, "s string, source_size long, target double, buckets long")


def _draw(seed: int, node: tuple[int, int], quota: np.ndarray, n: int) -> np.ndarray:
    """One multivariate-hypergeometric draw of n blocks, the same wherever and whenever the node is visited."""
    if int(quota.sum()) > BLOCKS:
        raise ValueError("more blocks than a draw is exact for; larger buckets make fewer")
    key = hashlib.blake2b(f"{seed}:{node[0]}:{node[1]}".encode(), digest_size=8).digest()
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(key, "little")))
    return rng.multivariate_hypergeometric(quota, n, method="marginals")


def shard_quota(quota: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's blocks of each source: the first one's place in the source's permutation, and their number."""
    lo, hi, start = 0, shards, np.zeros_like(quota)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _draw(seed, (lo, hi), quota, round(int(quota.sum()) * (mid - lo) / (hi - lo)))
        if shard < mid:
            hi, quota = mid, left
        else:
            lo, start, quota = mid, start + left, quota - left
    return start, quota


def _before(sums: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """Running sums of ``value`` before each (s, part), in two levels: over ranges of parts, and inside a range."""
    ranged = sums.withColumn("__range", F.expr(f"{part} div {RANGE}"))
    back = lambda *by: Window.partitionBy(*by)
    top = ranged.groupBy("s", "__range").agg(F.sum(value).alias("__sum"))
    top = top.select(F.col("s").alias("__s"), F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(back("s").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__top"))
    inner = ranged.withColumn("__inner", F.coalesce(F.sum(value).over(back("s", "__range").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = inner.join(top, inner.s.eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    return joined.select("s", part, (F.col("__top") + F.col("__inner")).cast("long").alias(out))


def plan_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3.0, bucket_docs: int = 256, seed: int = 7) -> DataFrame:
    """One row a document, without its text: id, s (source), key (hash of the whole row), size, source_size, target, order
    (keyed hash), bucket, rank (place in the bucket), passes (whole passes taken), rest (words of the part pass), taken.
    Exact but for the fraction of a word in a target."""
    read = docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("s"), size_of(F.col(text)).alias("size"), _hash(seed, docs, [doc_id, text]).alias("o"), _hash(seed, docs, docs.columns).alias("key"))
    # equal rows are counted first and told apart by number, so that many of them neither meet in a task nor in a bucket
    equal = read.groupBy("id", "s", "size", "o", "key").count()
    slim = equal.select("id", "s", "size", "key", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("copy"), "o").withColumn("order", F.xxhash64("o", "copy"))
    slim = written(slim.drop("o"), "sizes")
    plan = source_plan(slim, list(weights), most, bucket_docs).withColumnRenamed("s", "__s")
    d = slim.join(plan, slim.s.eqNullSafe(F.col("__s"))).drop("__s")
    # the hash's upper 31 bits, dealt evenly into buckets in the hash's order
    d = d.withColumn("bucket", F.shiftright(F.shiftrightunsigned("order", 33) * F.col("buckets"), 31))
    d = d.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    d = d.withColumn("__left", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    before = _before(d.groupBy("s", "bucket").agg(F.sum("size").alias("z")), "bucket", "z", "__before").select(F.col("s").alias("__s"), F.col("bucket").alias("__b"), "__before")
    order = Window.partitionBy("s", "bucket").orderBy(F.shiftrightunsigned("order", 33), "order", "id", "key", "copy")
    d = d.withColumn("__in", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rank", F.row_number().over(order))
    d = d.join(before, d.s.eqNullSafe(F.col("__s")) & (d.bucket == F.col("__b")))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left") - F.col("__before") - F.col("__in"))).cast("long")
    return d.withColumn("rest", rest).select("id", "s", "key", "size", "source_size", "target", "order", "bucket", "rank", "passes", "rest", (F.col("passes") * F.col("size") + F.col("rest")).alias("taken"))


def block_shards(planned: DataFrame, *, shards: int = 16, seed: int = 7) -> DataFrame:
    """(s, pass, bucket, shard, place): every block's shard and its place among the source's permuted blocks."""
    per = planned.groupBy("s", "bucket").agg(F.max("passes").alias("passes"), F.max(F.col("rest") > 0).alias("more"))
    last = F.col("passes") + F.when(F.col("more"), 1).otherwise(0)
    blocks = per.where(last > 0).select("s", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("pass"), "bucket")
    quota = blocks.groupBy("s").agg(F.count("*").alias("n"))
    # the permutation is the order of a keyed hash; its upper 31 bits are dealt into ranges of some RANGE blocks
    h = blocks.withColumn("h", F.xxhash64(F.lit(seed + 1), "pass", "bucket")).join(quota.withColumnRenamed("s", "__s"), blocks.s.eqNullSafe(F.col("__s"))).drop("__s")
    h = h.withColumn("slice", F.shiftright(F.shiftrightunsigned("h", 33) * (F.expr(f"n div {RANGE}") + 1), 31))
    before = _before(h.groupBy("s", "slice").agg(F.count("*").alias("z")), "slice", "z", "__before").select(F.col("s").alias("__s"), F.col("slice").alias("__slice"), "__before")
    order = Window.partitionBy("s", "slice").orderBy(F.shiftrightunsigned("h", 33), "h", "pass", "bucket")
    placed = h.withColumn("__n", F.row_number().over(order) - 1).join(before, h.s.eqNullSafe(F.col("__s")) & (h["slice"] == F.col("__slice")))
    placed = placed.select("s", "pass", "bucket", (F.col("__before") + F.col("__n")).alias("place"), F.expr(f"(__before + __n) div greatest(1, n div {shards})").alias("__part"))
    everything = quota.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("s").isNull().alias("null"), "s", "n"))).alias("q"))
    paths = everything.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("id"), "q").repartition(min(shards, 64), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, q in zip(b.id, b.q):
                start, n = shard_quota(np.array([x["n"] for x in q], np.int64), shards, int(shard), seed)
                got = np.flatnonzero(n)
                if len(got):
                    yield pd.DataFrame({"qs": [q[i]["s"] for i in got], "first": start[got], "after": (start + n)[got], "width": [max(1, q[i]["n"] // shards) for i in got], "shard": int(shard)})

    # a shard's run meets its few parts of the permutation, not all blocks of the source
    runs = paths.mapInPandas(run, "qs string, first long, after long, width long, shard int")
    runs = runs.select("*", F.explode(F.expr("sequence(first div width, (after - 1) div width)")).alias("__p"))
    on = placed.s.eqNullSafe(runs.qs) & (F.col("__part") == F.col("__p")) & (placed.place >= runs["first"]) & (placed.place < runs["after"])
    return placed.join(runs, on).select("s", "pass", "bucket", "shard", "place")


def mix_takes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", shards: int = 16, seed: int = 7, untaken: bool = False, **more) -> DataFrame:
    """The mix without texts: the columns of ``plan_documents`` and pass, words (taken this time), shard and slot (order inside
    the shard), a row for every time a document is taken. With ``untaken``, one that is not taken has a row of 0 words."""
    planned = written(plan_documents(docs, text=text, doc_id=doc_id, source=source, seed=seed, **more), "plan")
    shard = block_shards(planned, shards=shards, seed=seed).select(F.col("s").alias("__s"), F.col("pass").alias("__pass"), F.col("bucket").alias("__bucket"), "shard")
    last = F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0)
    rows = planned.withColumn("pass", F.explode_outer(F.when(last > 0, F.sequence(F.lit(1).cast("long"), last))))
    on = rows.s.eqNullSafe(F.col("__s")) & (F.col("pass") == F.col("__pass")) & (rows.bucket == F.col("__bucket"))
    words = F.when(F.col("shard").isNull(), 0).when(F.col("pass") <= F.col("passes"), F.col("size")).otherwise(F.col("rest")).cast("long")
    out = rows.join(shard, on, "left").select(*planned.columns, "pass", words.alias("words"), "shard", F.xxhash64(F.lit(seed + 2), "pass", "order").alias("slot"))
    return out if untaken else out.where("words > 0")


def _taken(docs: DataFrame, text: str, doc_id: str, source: str, seed: int, more: dict) -> DataFrame:
    """The columns of ``docs`` and the struct ``__mix``, a row for every time one is taken. Texts are joined once, by a
    hash of the whole row; rows that are equal in all columns stand for one another."""
    takes = mix_takes(docs, text=text, doc_id=doc_id, source=source, seed=seed, **more)
    keyed = docs.withColumn("__k", _hash(seed, docs, docs.columns)).dropDuplicates([doc_id, "__k"])
    mix = F.struct(*[F.col(c) for c in takes.columns if c not in ("id", "s", "key")]).alias("__mix")
    t = takes.select(F.col("id").alias("__i"), F.col("key").alias("__key"), mix)
    return keyed.join(t, F.col(f"`{doc_id}`").eqNullSafe(F.col("__i")) & (F.col("__k") == F.col("__key"))).drop("__k", "__i", "__key")


def mix_sources(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 7, **more) -> DataFrame:
    """``mix_takes`` with the columns of ``docs`` and the struct ``mix``."""
    docs = docs.drop("mix")
    return _taken(docs, text, doc_id, source, seed, more).withColumnRenamed("__mix", "mix")


def mixed_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", shards: int | None = None, seed: int = 7, **more) -> DataFrame:
    """The mix as documents: a row for every time one is taken, dealt into shards (as many as shuffles have partitions, so
    that one fits a task) and shuffled inside each. A source's last part pass ends inside one document at most; that
    row's text is cut after the words it gives."""
    shards = shards or partitions(docs.sparkSession)
    rows = _taken(docs, text, doc_id, source, seed, more | {"shards": shards})
    given = F.when(F.col("__mix.words") < F.col("__mix.size"), _first_words(F.col(text), F.col("__mix.words"))).otherwise(F.col(text))
    return rows.withColumn(text, given).repartition(shards, F.col("__mix.shard")).sortWithinPartitions("__mix.shard", "__mix.slot").drop("__mix")


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word (n is 1 at least)."""
    words = F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")
