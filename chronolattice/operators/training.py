"""Preparing training data: packing, truncation, mixing, splits, running means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolattice.sources.storage import placed


def pack(rows: DataFrame, length: int, *order: Column) -> DataFrame:
    """(block, ids): all ids one after another in order, cut into blocks of ``length``; a rest is dropped. A row gives each
    block it reaches into one run of its ids, so rows grow with rows and blocks, not with ids."""
    r = placed(rows, F.size("ids"), "at", *order).where(F.size("ids") > 0)
    last = F.col("at") + F.size("ids") - 1
    r = r.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / length), F.floor(last / length))))
    begin = F.greatest(F.lit(0).cast("long"), F.col("block") * length - F.col("at"))
    run = F.slice("ids", (begin + 1).cast("int"), F.least(F.lit(length), F.size("ids") - begin, (F.col("block") + 1) * length - F.col("at")).cast("int"))
    g = r.groupBy("block").agg(F.sort_array(F.collect_list(F.struct((F.col("at") + begin).alias("from"), run.alias("run")))).alias("x"))
    g = g.select("block", F.flatten(F.transform("x", lambda v: v["run"])).alias("ids"))
    return g.where(F.size("ids") == length)


def truncate(rows: DataFrame, cutoff: int, source: str = "source_ids", target: str = "target_ids") -> DataFrame:
    """Source and target cut in proportion, so that both fit into ``cutoff``."""
    a, b = F.size(source), F.size(target)
    total = F.greatest(a + b, F.lit(1))
    most = lambda n: F.when(total <= cutoff, n).otherwise(F.floor(cutoff * n / total).cast("int"))
    return rows.withColumns({source: F.slice(source, F.lit(1), most(a)), target: F.slice(target, F.lit(1), most(b))})


def interleave(first: DataFrame, second: DataFrame, *order: Column) -> DataFrame:
    """Rows in turn from both, until one of them ends."""
    one = F.lit(1)
    a = placed(first, one, "turn", *order).withColumn("turn", F.col("turn") * 2)
    b = placed(second, one, "turn", *order).withColumn("turn", F.col("turn") * 2 + 1)
    both = a.unionByName(b)
    ends = both.groupBy().agg(F.count_if(F.col("turn") % 2 == 0).alias("__a"), F.count_if(F.col("turn") % 2 == 1).alias("__b"))
    n = ends.select((2 * F.least("__a", "__b")).alias("__n"))
    return both.join(F.broadcast(n), F.col("turn") < F.col("__n")).drop("__n")


def dialogues(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, history, prompt, response): the last question and answer of each conversation, and what was said before."""
    g = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, role, text))).alias("t"))
    said = F.transform("t", lambda x: x[text])
    n = F.size("t")
    return g.where(n >= 2).select(conv, F.concat_ws("\n", F.slice(said, F.lit(1), n - 2)).alias("history"), F.element_at(said, -2).alias("prompt"), F.element_at(said, -1).alias("response"))


def all_dialogues(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n, history, prompt, response): every question of a conversation with its answer and all that was said before."""
    g = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, role, text))).alias("t"))
    said = F.transform("t", lambda x: x[text])
    g = g.where(F.size("t") >= 2).select(conv, said.alias("s"), F.explode(F.sequence(F.lit(1), F.floor(F.size("t") / 2).cast("int"))).alias("n"))
    return g.select(conv, "n", F.concat_ws("\n", F.slice("s", F.lit(1), 2 * F.col("n") - 2)).alias("history"), F.get("s", 2 * F.col("n") - 2).alias("prompt"), F.get("s", 2 * F.col("n") - 1).alias("response"))


def take(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order (a limit over a sort keeps n rows a task)."""
    return rows.orderBy(*order).limit(n)


def skip(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """All rows of an order but the first n."""
    return placed(rows, F.lit(1), "__at", *order).where(F.col("__at") >= n).drop("__at")


def shuffled(rows: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """Rows in an order that a keyed hash gives, the same in every run: what a shuffle buffer of any size tends to."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256))


def split(rows: DataFrame, key: Column, share: float, seed: int = 42) -> DataFrame:
    """Rows with part: 'val' for about ``share`` of them by a keyed hash, else 'train'."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return rows.withColumn("part", F.when(h < int(share * (1 << 32)), "val").otherwise("train"))


def smoothed(rows: DataFrame, group: str, step: str, value: str) -> DataFrame:
    """Exponential running means of short series (one a group), the weight growing with the series' length."""
    g = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(step), F.col(value).alias("v")))).alias("s"))
    n = F.size("s")
    w = 1.8 * (1 / (1 + F.exp(-0.05 * n)) - 0.5)
    last = F.aggregate(F.col("s"), F.struct(F.get("s", F.lit(0))["v"].alias("last"), F.array().cast("array<double>").alias("out")), lambda a, x: F.struct((a["last"] * F.col("w") + (1 - F.col("w")) * x["v"]).alias("last"), F.concat(a["out"], F.array(a["last"] * F.col("w") + (1 - F.col("w")) * x["v"])).alias("out")), lambda a: a["out"])
    z = g.withColumn("w", w).select(group, F.arrays_zip(F.col("s").alias("s"), last.alias("m")).alias("z")).select(group, F.explode("z").alias("z"))
    return z.select(group, F.col(f"z.s.{step}").alias(step), F.round("z.m", 6).alias("smoothed"))


def preference_accuracy(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return pairs.agg(F.round(F.avg((F.col(chosen) > F.col(rejected)).cast("double")), 6).alias("accuracy"))
