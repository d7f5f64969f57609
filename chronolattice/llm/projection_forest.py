"""Near duplicates among embeddings: a forest of random-projection trees with spill.

1. Equal vectors become one, with their number; copies are linked by counting and are never paired.
2. A sample of at most ``sample`` vectors (those with the smallest hash names) reaches the driver. It gives the *hot cores*:
   directions with at least ``hot`` of the sample within half the angle of ``least``. All vectors that close to one direction are
   links of each other (the angle is a metric), whatever their number: they are counted, not paired, and are dealt to no
   tree. What a core's members may have as further links lies within three halves of the angle: members and that
   halo meet in a join dealt by chunks of both.
3. The sample also gives the top splits of each tree: random directions, cut at the median of a node. Vectors within a margin of
   the cut go both ways (spill). Every other vector is routed to its buckets, which are split further, by random
   directions of their own, inside a task, to leaves of at most ``leaf`` vectors; where nearly all lie within the margin
   the node stays whole. Buckets of more than ``bucket`` vectors are dealt as pairs of chunks, so none is held whole.
4. Vectors of a leaf are compared by cosine in doubles; each pair found counts once over all trees.

A tree can miss a pair, many trees miss few: a pair at the threshold stays together through 20 splits of evenly spread vectors
with about 0.65, and eight such trees miss about one in 5,000. Tests measure recall against brute force.

Defined results: a vector that is null, empty, zero or holds a null, NaN or infinite component links with nothing and is its own
component; vectors of different lengths never link; rows that repeat link like other copies; a null id counts as a
link and takes the smallest id of its component, and is kept only where no row of its component has an id; other columns are
passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolattice.llm.cluster import written
from chronolattice.llm.components import components

#: Rows of a chunk in joins of large groups, and rows compared at once.
CHUNK, BLOCK = 2048, 1024
#: Roundings of a cosine in doubles stay far below this.
EPSILON = 1e-9
LINK = "a long, b long, na long, nb long"


@dataclass
class Forest:
    """What routing needs: bounded by the sample. ``tops``: for each tree its directions by level and its cuts by node."""

    d: int
    least: float
    leaf: int
    bucket: int
    margin: float
    pivots: np.ndarray
    tops: list[tuple[np.ndarray, dict[int, float]]]
    chunks: list[dict[int, int]] = field(default_factory=list)

    @property
    def half(self) -> float:
        return math.acos(self.least) / 2


def units(column, d: int) -> np.ndarray:
    """The directions of a list column whose lists have d finite entries, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def core(f: Forest, x: np.ndarray) -> np.ndarray:
    """For each vector the nearest pivot, if it is within half the angle, else -1."""
    if not len(f.pivots) or not len(x):
        return np.full(len(x), -1)
    c = x @ f.pivots.T
    near = c.argmax(1)
    return np.where(c[np.arange(len(x)), near] >= math.cos(f.half) + EPSILON, near, -1)


def pivots(x: np.ndarray, least: float, hot: int) -> np.ndarray:
    """Directions with at least ``hot`` vectors of x, that no earlier one has, within half the angle: the fullest first."""
    bar = math.cos(math.acos(least) / 2) + EPSILON
    near = [np.flatnonzero(r) for at in range(0, len(x), BLOCK) for r in x[at : at + BLOCK] @ x.T >= bar]
    free, out = np.ones(len(x), bool), []
    for i in sorted((i for i, r in enumerate(near) if len(r) >= hot), key=lambda i: (-len(near[i]), i)):
        own = near[i][free[near[i]]]
        if len(own) < hot:
            continue
        p = x[own].mean(0)
        p /= np.sqrt(p @ p)
        held = free & (x @ p >= bar)
        if held.sum() < len(own):  # the middle of its vectors is usually better, but need not be
            p, held = x[i], np.isin(np.arange(len(x)), own)
        out.append(p)
        free &= ~held
    return np.array(out).reshape(-1, x.shape[1])


def sides(p: np.ndarray, cut: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    return p <= cut + margin, p >= cut - margin


def top(x: np.ndarray, rows: int, f: Forest, tree: int, fewest: int = 16) -> tuple[np.ndarray, dict[int, float]]:
    """The upper splits of a tree over a sample x of ``rows`` vectors: one random direction a level, medians of nodes. A node is
    split while it stands for more vectors than a leaf, a 64th of all or a 16th of ``bucket``, and enough of the sample is there to
    find its middle; where nearly all lies within the margin, the next direction splits it."""
    rng = np.random.default_rng([tree, 13])
    levels = max(1, math.ceil(math.log2(max(2, len(x) / fewest))))
    ways = rng.normal(size=(levels, f.d))
    ways /= np.sqrt((ways * ways).sum(1, keepdims=True))
    cuts, todo = {}, [(1, 0, np.arange(len(x)))]
    most = max(f.leaf, min(f.bucket // 16, rows // 64))
    while todo:
        node, level, of = todo.pop()
        if level == levels or len(of) < 2 * fewest or len(of) * rows / len(x) <= most:
            continue
        p = x[of] @ ways[level]
        cut = float(np.median(p))
        left, right = sides(p, cut, f.margin)
        if left.sum() + right.sum() > 1.8 * len(of):
            cuts[node] = math.inf  # not by this direction: all go left, to be split by the next
            todo.append((2 * node, level + 1, of))
            continue
        cuts[node] = cut
        todo += [(2 * node, level + 1, of[left]), (2 * node + 1, level + 1, of[right])]
    return ways, cuts


def routed(f: Forest, tree: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) for all buckets of a tree that the rows of x belong to."""
    ways, cuts = f.tops[tree]
    row, node, rows, nodes = np.arange(len(x)), np.ones(len(x), np.int64), [], []
    for way in ways:
        names, back = np.unique(node, return_inverse=True)
        cut = np.array([cuts.get(int(v), math.nan) for v in names])[back]
        done = np.isnan(cut)
        rows.append(row[done])
        nodes.append(node[done])
        row, node, cut = row[~done], node[~done], cut[~done]
        left, right = sides((x @ way)[row], cut, f.margin)
        row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
    return np.concatenate([*rows, row]), np.concatenate([*nodes, node])


def leaves(x: np.ndarray, f: Forest, seed: int) -> Iterator[np.ndarray]:
    """The leaves of a bucket's own tree, as places in x."""
    rng, todo = np.random.default_rng([seed, 31]), [np.arange(len(x))]
    while todo:
        of = todo.pop()
        for _ in range(4 if len(of) > f.leaf else 0):
            way = rng.normal(size=f.d)
            p = x[of] @ (way / np.sqrt(way @ way))
            left, right = sides(p, float(np.median(p)), f.margin)
            if left.sum() + right.sum() <= 1.8 * len(of):
                todo += [of[left], of[right]]
                break
        else:
            yield of


def close(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs whose cosine is ``least`` or more."""
    found = [np.nonzero(x[at : at + BLOCK] @ y.T >= least) for at in range(0, len(x), BLOCK)]
    return np.concatenate([i + at * BLOCK for at, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])


def _links(a, b, n_a, n_b) -> pa.Table:
    turn = a > b
    return pa.table({"a": np.where(turn, b, a), "b": np.where(turn, a, b), "na": np.where(turn, n_b, n_a), "nb": np.where(turn, n_a, n_b)})


def _compared(f: Forest):
    """Links inside a bucket."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rid")
        x, rid, n = units(rows["v"], f.d), rows["rid"].to_numpy(), rows["n"].to_numpy()
        found = [np.zeros(0, np.int64)]
        for of in leaves(x, f, int(rows["bucket"][0].as_py()) & 0xFFFFFFFF):
            i, j = close(x[of], x[of], f.least)
            i, j = of[i[i < j]], of[j[i < j]]
            found.append(np.unique(np.minimum(i, j) * len(x) + np.maximum(i, j)))
        i, j = np.divmod(np.unique(np.concatenate(found)), max(1, len(x)))
        return _links(rid[i], rid[j], n[i], n[j])

    return run


def tree_links(reps: DataFrame, f: Forest, tree: int) -> DataFrame:
    """(a, b, na, nb): the links that one tree finds among vectors outside the hot cores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = units(b["v"], f.d)
            out = np.flatnonzero(core(f, x) < 0)
            row, bucket = routed(f, tree, x[out])
            row, many = out[row], np.array([f.chunks[tree].get(int(v), 1) for v in bucket])
            # of a bucket in chunks, a row goes to all pairs of chunks with its own
            mine = b["rid"].to_numpy()[row] % many
            again = np.repeat(np.arange(len(row)), many)
            other = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
            low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
            key = (bucket[again] << 32) + (low << 16) + high
            for at in range(0, len(again), 8192):
                take = pa.array(row[again[at : at + 8192]])
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 8192]), *[b[c].take(take) for c in ("rid", "n", "v")]], ["bucket", "rid", "n", "v"])

    kind = reps.schema["v"].dataType.simpleString()
    rows = reps.select("rid", "n", "v").mapInArrow(run, f"bucket long, rid long, n long, v {kind}")
    return rows.groupBy("bucket").applyInArrow(_compared(f), LINK)


def bucket_sizes(reps: DataFrame, f: Forest) -> list[dict[int, int]]:
    """For each tree the buckets of more than ``bucket`` vectors, with the number of chunks that they are dealt in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            x = units(b["v"], f.d)
            x = x[core(f, x) < 0]
            for t in range(len(f.tops)):
                for k, c in zip(*np.unique(routed(f, t, x)[1], return_counts=True), strict=True):
                    total[t, int(k)] = total.get((t, int(k)), 0) + int(c)
        yield pa.RecordBatch.from_pydict({"tree": pa.array([t for t, _ in total], pa.int64()), "bucket": pa.array([k for _, k in total], pa.int64()), "c": pa.array(total.values(), pa.int64())})

    large = reps.select("v").mapInArrow(run, "tree long, bucket long, c long").groupBy("tree", "bucket").agg(F.sum("c").alias("c")).where(F.col("c") > f.bucket).collect()
    return [{r["bucket"]: -(-2 * r["c"] // f.bucket) for r in large if r["tree"] == t} for t in range(len(f.tops))]


def halo_links(reps: DataFrame, f: Forest) -> DataFrame | None:
    """(a, b, na, nb): links of hot cores' members with vectors outside their core."""
    reach = math.cos(min(math.pi, 3 * f.half)) - EPSILON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (p, member, rid, n, v): members of core p, and others in its halo; of two cores the later one's are the halo."""
        for b in batches:
            x = units(b["v"], f.d)
            own = core(f, x)
            row, p = np.nonzero(x @ f.pivots.T >= reach)
            keep = (own[row] < 0) | (own[row] >= p)
            row, p = row[keep], p[keep]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(own[row] == p), *[b[c].take(take) for c in ("rid", "n", "v")]], ["p", "member", "rid", "n", "v"])

    kind = reps.schema["v"].dataType.simpleString()
    rows = reps.select("rid", "n", "v").mapInArrow(run, f"p long, member boolean, rid long, n long, v {kind}")
    counts = {(r["p"], r["member"]): r["count"] for r in rows.groupBy("p", "member").count().collect()}  # two a core at most
    both = [p for p in range(len(f.pivots)) if counts.get((p, False))]
    if not both:
        return None
    chunks = {k: -(-counts.get((p, k[1]), 0) // CHUNK) for p in both for k in ((p, True), (p, False))}
    table = F.create_map(*[F.lit(x).cast("long") for (p, m), c in chunks.items() for x in (2 * p + int(m), c)])
    of = lambda m: table[2 * F.col("p") + F.lit(int(m))]
    mine = F.pmod(F.xxhash64("rid"), F.when(F.col("member"), of(True)).otherwise(of(False)))
    rows = rows.where(F.col("p").isin(both)).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("member"), of(False)).otherwise(of(True)) - 1)))
    rows = rows.withColumns({"i": F.when(F.col("member"), F.col("mine")).otherwise(F.col("other")), "j": F.when(F.col("member"), F.col("other")).otherwise(F.col("mine"))})

    def meet(of: pa.Table) -> pa.Table:
        m = of["member"].to_numpy()
        x, rid, n = units(of["v"], f.d), of["rid"].to_numpy(), of["n"].to_numpy()
        if not m.any() or m.all():
            return _links(*[np.zeros(0, np.int64)] * 4)
        i, j = close(x[m], x[~m], f.least)
        return _links(rid[m][i], rid[~m][j], n[m][i], n[~m][j])

    return rows.select("p", "i", "j", "member", "rid", "n", "v").groupBy("p", "i", "j").applyInArrow(meet, LINK)


def with_core(reps: DataFrame, f: Forest) -> DataFrame:
    """``reps`` without its vectors but with ``core``, -1 where there is none."""
    rest = [c for c in reps.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b[c] for c in rest], pa.array(core(f, units(b["v"], f.d)).astype(np.int64))], [*rest, "core"])

    return reps.mapInArrow(run, ", ".join(f"{c} {reps.schema[c].dataType.simpleString()}" for c in rest) + ", core long")


def planted(reps: DataFrame, d: int, n: int, *, least: float, trees: int, leaf: int, bucket: int, sample: int, hot: float, spill: float) -> Forest:
    """The forest over vectors of d entries, from the ``sample`` with the smallest names."""
    share = F.lit(min(1.0, 1.5 * sample / n + 100 / n))
    first = reps.where(F.col("x") <= (share * 2.0**64 - 2.0**63)).orderBy("x", "y").limit(sample).select("v").toArrow()
    x = units(first["v"], d)
    f = Forest(d, least, leaf, bucket, spill * math.sqrt((2 - 2 * least) / d), pivots(x, least, max(24, math.ceil(hot * len(x)))), [])
    out = x[core(f, x) < 0]
    rows = max(1, round(n * len(out) / max(1, len(x))))
    f.tops = [top(out, rows, f, t) if len(out) else (np.zeros((0, d)), {}) for t in range(trees)]
    f.chunks = bucket_sizes(reps, f)
    return f


def usable(v: Column) -> Column:
    whole = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return F.coalesce(whole & F.exists(v, lambda c: c != 0), F.lit(False))


def near_embeddings(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95, trees: int = 8, leaf: int = 1024, bucket: int = 1 << 17, sample: int = 8192, hot: float = 0.003, spill: float = 0.5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: the other rows that it links with, the smallest id that it
    reaches, whether that is its own."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable(F.col(vector)), F.col(vector)).alias("v"))
    named = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("x"), F.hash("v").alias("y"))
    reps = named.where("x is not null").groupBy("x", "y").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("v").alias("v"))
    reps = written(reps.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    cored, links, cores = [], [], {}
    lengths = reps.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # as many as there are lengths
    for at, r in enumerate(lengths):
        own = reps.where(F.size("v") == r["d"])
        f = planted(own, r["d"], r["count"], least=least, trees=trees, leaf=leaf, bucket=bucket, sample=sample, hot=hot, spill=spill)
        shift = at << 32  # names of cores, apart for each length
        mine = with_core(own, f).withColumn("core", F.when(F.col("core") >= 0, -1 - shift - F.col("core")))
        cored.append(mine)
        found = [tree_links(own, f, t) for t in range(trees)]
        if len(f.pivots):
            halo = halo_links(own, f)
            found += [halo] if halo is not None else []
        links += [written(x, "tree") for x in found]
    if not cored:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    all_ = written(reduce(DataFrame.unionByName, cored), "cores")
    pairs = written(reduce(DataFrame.unionByName, links).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb")), "links")
    partners = pairs.select(F.col("a").alias("rid"), F.col("nb").alias("k")).unionByName(pairs.select(F.col("b").alias("rid"), F.col("na").alias("k"))).groupBy("rid").agg(F.sum("k").alias("k"))
    cores = all_.where("core is not null").groupBy("core").agg(F.sum("n").alias("core_n"))  # bounded by the samples
    # components over cores and single vectors
    node = all_.select("rid", F.coalesce("core", "rid").alias("node"))
    ends = pairs.join(node.select(F.col("rid").alias("a"), F.col("node").alias("u")), "a").join(node.select(F.col("rid").alias("b"), F.col("node").alias("v")), "b").select("u", "v")
    roots = components(ends).select("node", "root")
    whole = all_.join(partners, "rid", "left").join(F.broadcast(cores), "core", "left").withColumn("node", F.coalesce("core", "rid")).join(roots, "node", "left")
    count = F.when(F.col("core_n").isNotNull(), F.col("core_n")).otherwise(F.col("n")) - 1 + F.coalesce("k", F.lit(0))
    whole = written(whole.select("x", "y", "low", count.alias("n_links"), F.coalesce("root", "node").alias("root")), "classes")
    lowest = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = whole.join(lowest, "root").select("x", "y", "n_links", "component_id")
    out = named.drop("v").join(classes, ["x", "y"], "left")
    linked = F.col("x").isNotNull()
    least_id = F.when(linked, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), least_id.alias("component_id"), F.col("vec_id").eqNullSafe(least_id).alias("kept"))
