"""Shared-storage and session helpers of the corpus operators."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder takes its place in a session of one machine, as in tests; on a cluster that folder
    would be another one on every machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends in order."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(clean, spark, path)
    return path


_OWN: set[str] = set()


def clean(spark: SparkSession, path: str | None = None) -> None:
    """Removes all that the operators have written for themselves so far; results that still read it are void."""
    if spark.sparkContext._jsc is not None:
        remove(spark, path or own_dir(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and a lost executor
    costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more (it does so when the driver collects garbage)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
