"""A surface index that stays: a bucketed table beside the checksum of what it was made of.

Each state of the sources has a folder of its own, named by their checksum: an index is read where its folder is complete and
built where it is not, so a changed source never meets an old index, and a build that was cut short leaves no index behind.
The table is bucketed and sorted by the normal form of a surface: joins on it move and sort the other side only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolattice.operators.grounding import surface_index

COLUMNS = "surface string, mid string, score double, name string, popularity double"


def read_surface_map(spark: SparkSession, path: str) -> DataFrame:
    """(surface, mid, score) of a file of surface, score and entity, parted by tabs; lines with fewer fields or no number as score
    are passed over."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 3).select(f[0].alias("surface"), F.rtrim(f[2]).alias("mid"), f[1].try_cast("double").alias("score"))
    return rows.where("score is not null and mid <> ''")


def read_entity_list(spark: SparkSession, path: str) -> DataFrame:
    """(mid, name, score, aliases) of a file of these, parted by tabs; an entity that comes twice has its last line's place, which
    is its greatest name and score here."""
    f = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).where(F.size(f) >= 3).select(f[0].alias("mid"), f[1].alias("name"), f[2].try_cast("long").alias("score"), F.slice(f, 4, F.greatest(F.lit(0), F.size(f) - 3)).alias("aliases"))
    return rows.where("score is not null").groupBy("mid").agg(F.max(F.struct("name", "score", "aliases")).alias("e")).select("mid", "e.*")


def checksum(*sources: DataFrame) -> str:
    """A name of the rows of frames, whatever their order: how many there are, and the sums of two hashes of them."""
    parts = []
    for df in sources:
        cols = sorted(df.columns)
        row = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
        wide = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0)).cast("string")
        parts.append("|".join([",".join(cols), *df.agg(F.count("*").cast("string"), wide(F.xxhash64(row)), wide(F.hash(row))).first()]))
    import hashlib

    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def _complete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_surface_index(folder: str, surface_map: DataFrame, entities: DataFrame, *, buckets: int = 64) -> tuple[DataFrame, bool]:
    """``grounding.surface_index`` as a table under ``folder`` (a folder that all machines share), and whether it was built now.
    Rows without a surface have no normal form and are left out."""
    spark = surface_map.sparkSession
    sums = checksum(surface_map.select("surface", "mid", F.col("score").cast("double").alias("score")), entities.select("mid", "name", F.col("score").cast("double").alias("score")))
    name, path = f"surface_{sums}_{buckets}", f"{folder.rstrip('/')}/{sums}-{buckets}"
    built = not _complete(spark, path)
    if built:
        index = surface_index(surface_map, entities).select("surface", "mid", F.col("score").cast("double").alias("score"), "name", F.col("popularity").cast("double").alias("popularity"))
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        # one file a bucket
        index.where("surface is not null").repartition(buckets, "surface").write.mode("overwrite").option("path", path).bucketBy(buckets, "surface").sortBy("surface").saveAsTable(name)
    elif not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY (surface) SORTED BY (surface) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name), built
