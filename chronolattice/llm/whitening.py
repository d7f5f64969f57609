"""Embedding whitening over a compensated covariance.

An entry c becomes the whole number x = floor(64 * c) + 1,000,000. Four passes, none of which gathers rows:

1. the number of vectors and the exact sums per dimension (whole numbers);
2. the covariance. The mean is a double-double (high and low part), so is every centred entry. Outer products are split
   without error (Dekker's product), and added up with Knuth's error-free sum: a task keeps a high and a low matrix. Rows of
   these matrices are merged across tasks, high and low parts together, in two steps, so that no merge holds more than
   a part of the tasks' rows. What reaches the driver has as many numbers as the matrix, whatever the input;
3. its eigenvectors (Householder tridiagonal form and divide and conquer: LAPACK's syevd), and the projections of all
   rows, written once;
4. mean and covariance of the whitened rows by the same sums, for the distance from the identity.

Defined results: vectors that are null or hold a null, NaN or infinite entry are dropped; so are those with an entry of
2**46 or more in size (its x would be no exact double), empty ones, and vectors that have not the most frequent length
(of equally frequent lengths the smallest counts). Rows that repeat, and null ids, count and come out like any other.
Components whose variance is rounding error (at most d * 2**-52 of the largest) are left out: they cannot be whitened; so one
vector, or equal ones, give no rows, like an empty table. ``deviation`` is a decimal, null past 38 digits. Other
columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolattice.llm.cluster import written

SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0**46
SPLIT = 134217729.0  # 2**27 + 1
#: Rows that are multiplied at once, and the parts in which tasks' sums are merged first.
ROWS, PARTS = 256, 64


# error-free transformations


def two_sum(a, b):
    """a + b as a rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    """a as the sum of two numbers of 26 bits."""
    t = SPLIT * a
    high = t - (t - a)
    return high, a - high


def added(high, low, h, l):
    """The sum of two double-doubles."""
    s, e = two_sum(high, h)
    return two_sum(s, e + (low + l))


def summed(p, e):
    """The sum over the first axis of products p with errors e, as a double-double."""
    while len(p) > 1:
        half = len(p) // 2
        s, t = two_sum(p[:half], p[half : 2 * half])
        t += e[:half] + e[half : 2 * half]
        if len(p) % 2:
            s, t = np.concatenate([s, p[-1:]]), np.concatenate([t, e[-1:]])
        p, e = s, t
    return two_sum(p[0], e[0])


def double_double(x: Fraction) -> tuple[float, float]:
    high = float(x)
    return high, float(x - Fraction(high))


def centred(values, mean):
    """values - mean as double-doubles; ``mean`` is a pair of arrays."""
    h, e = two_sum(values, -mean[0])
    return two_sum(h, e - mean[1])


def outer_sum(h, l) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension i: the sums over rows of its products with the dimensions from i on, for rows h + l."""
    a, b = halves(h)
    out = []
    for i in range(h.shape[1]):
        x, xa, xb = h[:, i : i + 1], a[:, i : i + 1], b[:, i : i + 1]
        y, ya, yb = h[:, i:], a[:, i:], b[:, i:]
        p = x * y
        e = ((xa * ya - p) + xa * yb + xb * ya) + xb * yb
        e += x * l[:, i:]
        e += l[:, i : i + 1] * y
        out.append(summed(p, e))
    return out


# passes over the rows


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has whole numbers for all entries."""
    v = F.col(vector)
    fit = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))  # NaN is larger than all numbers
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(F.coalesce(fit, F.lit(False)))


def matrix(column, d: int) -> np.ndarray:
    """A list column of an Arrow batch, whose lists all have d entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def whole(column, d: int) -> np.ndarray:
    return np.floor(SCALE * matrix(column, d)) + SHIFT


def exact_sums(rows: DataFrame, vector: str, d: int) -> tuple[int, list[int]]:
    """The number of rows and the sums of their whole numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = whole(b.column(0), d).astype(np.int64)
            n += len(x)
            high += (x >> 26).sum(0)
            low += (x & ((1 << 26) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(d), "n": np.full(d, n), "high": high, "low": low})

    sums = rows.select(vector).mapInArrow(run, "i long, n long, high long, low long").groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")])
    got = {r["i"]: r for r in sums.collect()}  # d rows
    return (int(got[0]["n"]) if got else 0), [(int(got[i]["high"]) << 26) + int(got[i]["low"]) for i in sorted(got)]


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.sort_values("task")
    return summed(np.stack(rows["high"].to_list()), np.stack(rows["low"].to_list()))


def merged(partial: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows (i, task, high, low) of all tasks added up for each i; as many rows as the matrix has reach the driver."""
    shape = "i long, task long, high array<double>, low array<double>"

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        high, low = _merged(rows)
        return pd.DataFrame({"i": rows["i"][:1], "task": rows["task"].min(), "high": [high], "low": [low]})

    some = partial.groupBy("i", F.expr(f"task % {PARTS}")).applyInPandas(step, shape)
    every = some.groupBy("i").applyInPandas(step, shape)
    return {r["i"]: (np.array(r["high"]), np.array(r["low"])) for r in every.collect()}


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def double_sums(rows: DataFrame, column: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a list column of doubles, as double-doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d), np.zeros(d)
        for b in batches:
            x = matrix(b.column(0), d)
            if len(x):
                total = added(*total, *summed(x, np.zeros_like(x)))
        yield pa.RecordBatch.from_pydict({"i": [0], "task": [_task()], "high": [total[0]], "low": [total[1]]})

    return merged(rows.select(column).mapInArrow(run, "i long, task long, high array<double>, low array<double>"))[0]


def covariance(rows: DataFrame, column: str, n: int, mean: tuple[np.ndarray, np.ndarray], numbers=matrix) -> np.ndarray:
    """The covariance (divisor n) of a list column, centred at ``mean`` before anything is multiplied."""
    d = len(mean[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(d - i), np.zeros(d - i)) for i in range(d)]
        for b in batches:
            h, l = centred(numbers(b.column(0), d), mean)
            for at in range(0, len(h), ROWS):
                total = [added(*t, *s) for t, s in zip(total, outer_sum(h[at : at + ROWS], l[at : at + ROWS]), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": np.arange(d), "task": np.full(d, _task()), "high": [t[0] for t in total], "low": [t[1] for t in total]})

    got = merged(rows.select(column).mapInArrow(run, "i long, task long, high array<double>, low array<double>"))
    v = np.zeros((d, d))
    for i, (high, low) in got.items():
        v[i, i:] = v[i:, i] = (high + low) / n
    return v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues that are no rounding error, falling, and their unit eigenvectors as columns."""
    e, q = np.linalg.eigh(v)  # LAPACK syevd: tridiagonal form, divide and conquer
    e, q = e[::-1], q[:, ::-1]
    real = int((e > max(len(e) * 2.0**-52 * e[0], 0.0)).sum()) if len(e) else 0
    return e[: min(real, most)], q[:, : min(real, most)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - S)**2 for each row, exactly."""
    k, r = zip(*(divmod(s, n) for s in sums), strict=True)
    q = x.astype(np.int64) - np.array(k, np.int64)  # n * x - S = n * q - r, with 0 <= r < n
    d, top = len(sums), int(np.abs(q).max(initial=0))
    if d * top * top >= 1 << 62 or d * top * n >= 1 << 62:
        q = q.astype(object)
    squares, mixed, rest = (q * q).sum(1), (q * np.array(r, q.dtype)).sum(1), sum(a * a for a in r)
    return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares, mixed, strict=True)]


@dataclass
class Fit:
    """What whitening needs of the fit list, whatever its size."""

    d: int
    n: int
    sums: list[int]
    mean: tuple[np.ndarray, np.ndarray]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def fit(rows: DataFrame, vector: str, most: int) -> tuple[DataFrame, Fit | None]:
    """The rows of the most frequent length and the whitening of them; None if there is none."""
    first = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if first is None:
        return rows, None
    d = first["d"]
    rows = rows.where(F.size(vector) == d)
    n, sums = exact_sums(rows, vector, d)
    parts = [double_double(Fraction(s, n)) for s in sums]
    mean = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    v = covariance(rows, vector, n, mean, whole)
    return rows, Fit(d, n, sums, mean, float(np.trace(v)), *components(v, most))


def projected(rows: DataFrame, vec_id: str, vector: str, f: Fit) -> DataFrame:
    """(vec_id, deviation, w): each row's whitened vector."""
    turn = f.vectors / np.sqrt(f.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b.column(1), f.d)
            h, l = centred(x, f.mean)
            w = h @ turn + l @ turn
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(f.values))
            # decimals of 38 digits at most
            deviation = pa.array([str(v) if v < 10**38 else None for v in deviations(x, f.n, f.sums)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["vec_id", "deviation", "w"])

    kind = rows.schema[vec_id].dataType.simpleString()
    out = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).mapInArrow(run, f"vec_id {kind}, deviation string, w array<double>")
    return out.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "w")


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable vector and each of the first
    ``most`` components."""
    rows, f = fit(usable(vectors.select(vec_id, vector), vector), vector, most)
    if f is None or not len(f.values):
        kind = vectors.schema[vec_id].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    k = len(f.values)
    table = written(projected(rows, vec_id, vector, f), "whitened")
    high, low = double_sums(table, "w", k)
    parts = [double_double((Fraction(a) + Fraction(b)) / f.n) for a, b in zip(high.tolist(), low.tolist(), strict=True)]
    mean = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    error = float(np.abs(covariance(table, "w", f.n, mean) - np.eye(k)).max())
    explained = F.lit((f.values / f.trace).tolist()).cast("array<double>")
    long = table.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
