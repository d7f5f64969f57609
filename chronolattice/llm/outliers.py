"""Quality rules: robust multivariate outliers of text statistics, by minimum covariance determinant.

Everything here is DataFrame expressions; no Python runs on the executors.

1. Text statistics come from array expressions over each text's words and lines (written once to the shared
   folder: later steps read a few numbers a document, not texts).
2. The statistics are transformed to vectors (logarithms and logits) in fixed point, so all sums are of integers and
   reruns agree to the last bit whatever the order of rows.
3. A group is a language and source; groups of under ``min_rows`` rows are joined by language. Concentration steps
   (minimum covariance determinant): from a start at coordinate-wise centres, take the ``share`` of rows nearest to
   the current centre, estimate mean and covariance from them, repeat. The threshold distance comes from a histogram of
   log distances (counts only, so a group with a third of all rows is summed map-side like any other).
4. A row is rejected if its Mahalanobis distance under the last estimate is above the cutoff.

Distances use the Cholesky factor of each group's covariance, written out as column expressions, with a small
floor on the diagonal, so a group of equal vectors has a usable estimate.

Defined results: a null text has no words (base_failed, not kept); null lang or source is a group value of its
own; repeated rows are each judged; groups too small on any level get the estimate of all rows; an empty table
gives an empty result; other columns stay as they are, but for those named like a result, which it replaces.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolattice.llm.cluster import written

#: What separates words (fixed by the contract) and what counts as a symbol.
GAP, SYMBOLS, WORD = "[\\x20\\x09-\\x0D]+", "[#*$%&|<>]", "[^\\x20\\x09-\\x0D]"
SCALE = 1000
DIMS = ("log_words", "mean_chars", "symbols", "dup_lines", "repeats")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text and with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Trigrams of words are compared by 64-bit hashes inside one text. Repeats are found by sorting: a text in which
    few different trigrams repeat is checked against their list, any other by sorting positions with hashes, so
    time stays near linear in the text's length."""
    keep = [c for c in docs.columns if c != text and not c.startswith("__")]
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    t = t.withColumn("__w", F.filter(F.split("__t", GAP), lambda x: x != "")).withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD)))
    t = t.withColumn("n_words", F.size("__w").cast("long"))
    t = t.withColumn("word_chars", F.length(F.regexp_replace("__t", GAP, "")).cast("long"))
    t = t.withColumn("n_symbols", F.regexp_count("__t", F.lit(SYMBOLS)).cast("long"))
    t = t.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    zipped = F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", 2, F.greatest(F.size("__w"), F.lit(1))).alias("b"), F.slice("__w", 3, F.greatest(F.size("__w"), F.lit(1))).alias("c"))
    t = t.withColumn("__g", F.when(F.col("n_words") >= 3, F.slice(F.transform(zipped, lambda z: F.xxhash64(z.a, z.b, z.c)), 1, (F.col("n_words") - 2).cast("int"))).otherwise(F.array().cast("array<bigint>")))
    t = t.drop("__w", "__lines", "__t")
    t = t.withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.sort_array("__g")).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("__d", F.array_distinct(F.filter("__s", lambda x, i: (i > 0) & (x == F.get("__s", i - 1)))))
    few = F.filter(F.transform("__g", lambda x, i: F.when(F.array_contains("__d", x), i)), lambda i: i.isNotNull())
    t = t.withColumn("__z", F.when(F.size("__d") > 48, F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    many = F.transform(F.filter("__z", lambda s, k: ((k > 0) & (s.x == F.get("__z", k - 1).x)) | (s.x == F.get("__z", k + 1).x)), lambda s: s.i)
    t = t.withColumn("__p", F.when(F.size("__d") == 0, F.array().cast("array<int>")).when(F.col("__z").isNull(), few).otherwise(F.sort_array(many)))
    covered = F.aggregate(F.col("__p"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)
    return t.withColumn("n_repeat_words", covered.cast("long")).drop("__g", "__s", "__d", "__z", "__p")


def _fixed(c: Column) -> Column:
    return F.round(c * SCALE).cast("long")


def _logit(part: Column, whole: Column) -> Column:
    return F.log((part + 0.5) / (whole - part + 0.5))


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics x0 to x4, in thousandths, limited to what the statistics can honestly reach."""
    n, z = F.col("n_words").cast("double"), F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    x = [
        F.log1p(n),
        F.log1p(F.col("word_chars") / z) * 2,
        F.log1p(F.col("n_symbols") * 100 / z),
        F.log1p(F.col("n_dup_lines") * 100 / F.greatest(F.col("n_lines"), F.lit(1))) / 2,
        F.log1p(F.col("n_repeat_words") * 100 / z) / 2,
    ]
    return stats.withColumns({f"x{i}": _fixed(c) for i, c in enumerate(x)})


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    p = len(DIMS)
    wide = lambda i, j=None: F.sum((F.col(f"x{i}") if j is None else F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)"))
    sums = [F.count("*").alias("n")] + [wide(i).alias(f"s{i}") for i in range(p)] + [wide(i, j).alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*sums)


def _estimate(moments: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Means m and the Cholesky factor l of the covariance, from the moments."""
    p, n = len(DIMS), F.col("n").cast("double")
    out = moments.select(*keys, "n", *[(F.col(f"s{i}").cast("double") / n).alias(f"m{i}") for i in range(p)], *[F.col(f"s{i}{j}").cast("double").alias(f"q{i}{j}") for i in range(p) for j in range(i + 1)])
    for j in range(p):
        for i in range(j, p):
            c = F.col(f"q{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}") + (F.lit((floor * SCALE) ** 2) if i == j else F.lit(0.0))
            c = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), c)
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit((floor * SCALE / 4) ** 2))) if i == j else c / F.col(f"l{j}{j}"))
    return out.select(*keys, "n", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _distance(rows: DataFrame) -> DataFrame:
    """With the squared Mahalanobis distance d2, from the columns of the row's estimate."""
    for i in range(len(DIMS)):
        c = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"z{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"z{i}", c / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(DIMS))]))


def _centres(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The start: medians and half the middle half's width of each coordinate, from counts of coordinate values
    in steps of a twentieth (counts, so exact and the same in every run)."""
    step = SCALE // 20
    long = rows.select(*keys, F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / step) for i in range(len(DIMS))])).alias("dim", "bin")).groupBy(*keys, "dim", "bin").count()
    w = Window.partitionBy(*keys, "dim")
    long = long.withColumn("cum", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
    at = lambda q: (F.min(F.when(F.col("cum") >= q * F.col("all"), F.col("bin"))) + 0.5) * step
    q = long.groupBy(*keys, "dim").agg(at(0.5).alias("m"), at(0.25).alias("a"), at(0.75).alias("b"), F.max("all").alias("n"))
    pick = lambda c, i: F.max(F.when(F.col("dim") == i, c))
    p, sd = len(DIMS), F.greatest((F.col("b") - F.col("a")) / 1.349, F.lit(0.1 * SCALE))
    return q.groupBy(*keys).agg(F.max("n").alias("n"), *[pick(F.col("m"), i).alias(f"m{i}") for i in range(p)], *[(pick(sd, i) if i == j else F.max(F.lit(0.0))).alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)])


#: Log-distance histogram: steps of 1/32 of a natural logarithm.
BINS = 32


def mcd(rows: DataFrame, keys: list[str], *, share: float, steps: int, floor: float) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group after ``steps`` concentration steps.

    Each step is written to the shared folder (one row a group), so plans stay short and no step is run twice."""
    estimate = written(_centres(rows, keys), "mcd")
    for _ in range(steps):
        scored = _distance(_with(rows, estimate, keys)).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BINS))
        h = scored.groupBy(*keys, "bin").count()
        w = Window.partitionBy(*keys)
        h = h.withColumn("cum", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
        cut = h.groupBy(*keys).agg(F.min(F.when(F.col("cum") >= share * F.col("all"), F.col("bin"))).alias("most"))
        inner = _with(scored.select(*keys, "bin", *[f"x{i}" for i in range(len(DIMS))]), cut, keys).where("bin <= most")
        estimate = written(_estimate(_moments(inner, keys), keys, floor), "mcd")
    return estimate


def _with(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    renamed = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    return rows.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).drop(*[f"__{k}" for k in keys])


def chi_square_tail(p: int, tail: float) -> float:
    """The value a chi-square variable of p degrees exceeds with the given probability (Wilson-Hilferty)."""
    lo, hi = 0.0, 40.0
    for _ in range(80):
        z = (lo + hi) / 2
        lo, hi = (z, hi) if math.erfc(z / math.sqrt(2)) / 2 > tail else (lo, z)
    return p * (1 - 2 / (9 * p) + lo * math.sqrt(2 / (9 * p))) ** 3


def quality_rules(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", share: float = 0.75, steps: int = 5, min_rows: int = 50, tail: float = 1e-7, spread: float = 3.0, floor: float = 0.15) -> DataFrame:
    """``docs`` without its text, with the base statistics, base_failed, distance, cutoff and kept.

    ``tail``: share of clean normal rows beyond the cutoff. ``spread``: factor on the covariance, which was
    estimated from the inner ``share`` only and from skewed statistics. ``floor``: least standard deviation of a
    transformed statistic."""
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "cutoff", "kept")
    carried = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in results]
    clean = docs.select(F.struct(*carried).alias("row"), F.col(text).alias("__text"), F.col(lang).cast("string").alias("by_lang"), F.col(source).cast("string").alias("by_source"))
    stats = vectors(text_statistics(clean, "__text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    stats = written(stats.withColumn("__lang", F.col("by_lang")).withColumn("__source", F.col("by_source")), "stats")
    sizes = stats.where(~F.col("base_failed")).groupBy("__lang", "__source").count()
    big = sizes.where(F.col("count") >= min_rows).select("__lang", "__source", F.lit(True).alias("own"))
    grouped = stats.join(big.select(F.col("__lang").alias("a"), F.col("__source").alias("b"), "own"), F.col("__lang").eqNullSafe(F.col("a")) & F.col("__source").eqNullSafe(F.col("b")), "left")
    by_lang = sizes.groupBy(F.col("__lang").alias("c")).agg((F.sum("count") >= min_rows).alias("langs"))
    grouped = grouped.join(by_lang, F.col("__lang").eqNullSafe(F.col("c")), "left")
    own, langs = F.coalesce("own", F.lit(False)), F.coalesce("langs", F.lit(False))
    level = F.when(own, 2).when(langs, 1).otherwise(0)
    named = lambda **c: F.to_json(F.struct(*[F.col(v).alias(k) for k, v in c.items()]), {"ignoreNullFields": "false"})
    key = F.when(level == 2, named(l="__lang", s="__source")).when(level == 1, named(l="__lang")).otherwise("")
    grouped = written(grouped.withColumn("group", key).withColumn("level", level).drop("a", "b", "c", "own", "langs"), "grouped")
    # estimates come from the rows that pass the base rules; a group joined by language uses all rows of that language
    x = [f"x{i}" for i in range(len(DIMS))]
    good = grouped.where(~F.col("base_failed"))
    pool = good.where("level = 2").select("group", *x).unionByName(good.select(named(l="__lang").alias("group"), *x)).unionByName(good.select(F.lit("").alias("group"), *x))
    need = grouped.select("group").distinct()
    estimate = mcd(pool.join(need, "group", "left_semi"), ["group"], share=share, steps=steps, floor=floor)
    judged = _distance(grouped.join(estimate.withColumnRenamed("group", "g"), F.col("group") == F.col("g"), "left"))
    cutoff = chi_square_tail(len(DIMS), tail) * spread**2
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)
    judged = judged.withColumn("distance", F.round(F.sqrt("d2"), 4)).withColumn("cutoff", F.lit(round(math.sqrt(cutoff), 4))).withColumn("kept", kept)
    return judged.select("row.*", *results)
