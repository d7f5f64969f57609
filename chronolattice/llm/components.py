"""Connected components of a link table, by alternating large and small stars.

Each round joins every link with the smallest neighbour of one end; nothing is collected, and a hub with many
links is only ever summed (map-side) and joined, never held. Rounds are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolattice.llm.cluster import release, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v): root is the smallest node that it reaches."""
    e = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "links")
    last = None
    for _ in range(rounds):
        # large star: neighbours above u point to u's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u, point to the smallest
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = e.join(least, "u")
        e = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = written(e, "links")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        release(links.sparkSession)
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
