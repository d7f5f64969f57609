"""Micro-batches: validity intervals of events as they arrive, and windowed counts with late data.

The batch engine needs no streams; this shows that its interval view of events can be kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "2 days", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, event_type, n): counts in tumbling windows; a window is done when the watermark has passed it."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, every).alias("w"), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def as_triples(events: DataFrame) -> DataFrame:
    """Each event as its triples, without state."""
    e = F.concat(F.lit("g.e"), F.col("event_id").cast("string"))
    row = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))
    rows = F.array(row(F.concat(F.lit("m.u"), F.col("user_id").cast("string")), "user.account.events", e), row(e, "user.event.kind", F.col("event_type")), row(e, "user.event.from", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    return events.select(F.explode(rows).alias("t")).select("t.*")
