"""Frames whose rows have to lie where they lie: kept in the session's checkpoint folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. A session of one machine that names none, as in tests, gets
    a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.getCheckpointDir() is not None:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return found or "file://" + tempfile.mkdtemp(prefix="frames-")


def settled(df: DataFrame) -> DataFrame:
    """``df`` kept under ``spark.checkpoint.dir``: later plans read its partitions and never make them anew."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def placed(rows: DataFrame, size: Column, at: str, *order: Column) -> DataFrame:
    """``rows`` with ``at``: the sum of ``size`` over the rows before in ``order``. Sums are taken over ranges of the order and
    then inside a range, so no task sees all rows; what is summed over all ranges has one row a partition."""
    r = settled(rows.withColumn("__size", size.cast("long")).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = r.groupBy("__range").agg(F.sum("__size").alias("__total"))
    before = totals.select("__range", F.coalesce(F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum("__size").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return r.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "__range").withColumn(at, F.col("__before") + F.col("__inside")).drop("__range", "__size", "__before", "__inside")


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table under ``spark.checkpoint.dir``, read again: unlike a checkpointed frame it is a plain scan to later
    plans, with statistics and pushed filters. The tables go when the driver ends in order."""
    spark = df.sparkSession
    path = f"{shared_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OWN: dict[str, str] = {}


def shared_tables(spark: SparkSession) -> str:
    """This application's folder of tables, which goes with it."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"{_folder(spark).rstrip('/')}/{app}-tables"
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
