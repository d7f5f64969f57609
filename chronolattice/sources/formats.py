"""Readers and writers: triple dumps, dictionaries, labels, predictions, datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolattice.sources.kg import COLUMNS


def read_triple_text(spark: SparkSession, path: str) -> DataFrame:
    """Tab-parted lines ``subject predicate object .`` (gzip too) as a graph: prefixes go, datatypes and languages become columns."""
    f = F.split("value", "\t")
    raw = spark.read.text(path).where(F.size(f) >= 3).select(f[0].alias("s"), f[1].alias("p"), f[2].alias("o"))
    ns = r"^<?(?:http://rdf\.freebase\.com/ns/|ns:)?|>$"
    literal = F.col("o").startswith('"')
    text, lang, kind = (F.regexp_extract("o", r'^"(.*)"(?:@([\w-]+)|\^\^<?(?:[^>#]*[#:])?([\w]+)>?)?$', i) for i in (1, 2, 3))
    empty = lambda c: F.when(c != "", c)
    return raw.select(F.regexp_replace("s", ns, "").alias("s"), F.regexp_replace("p", ns, "").alias("p"), F.when(literal, text).otherwise(F.regexp_replace("o", ns, "")).alias("o"), F.when(literal, "literal").otherwise("entity").alias("o_kind"), empty(kind).alias("o_datatype"), empty(lang).alias("o_lang"))


def retype(triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """Literals of predicates in ``kinds`` (p, datatype) get that datatype where they have none."""
    j = triples.join(kinds.select("p", F.col("datatype").alias("__d")), "p", "left")
    untyped = (F.col("o_kind") == "literal") & F.col("o_datatype").isNull() & F.col("o_lang").isNull()
    return j.withColumn("o_datatype", F.when(untyped, F.col("__d")).otherwise(F.col("o_datatype"))).select(*COLUMNS)


def read_dictionary(spark: SparkSession, path: str, name: str, number: str, sep: str = "\t") -> DataFrame:
    """(name, number) of lines with exactly two fields."""
    f = F.split("value", sep)
    return spark.read.text(path).where(F.size(f) == 2).select(F.trim(f[0]).alias(name), F.expr("try_cast(trim(split(value, '" + sep + "')[1]) AS BIGINT)").alias(number)).where(F.col(number).isNotNull())


def read_labels(spark: SparkSession, path: str, *, compat: bool = False) -> DataFrame:
    """(mid, label, num) of a CSV file; commas behind a backslash are text, unless ``compat`` reads them as they stand."""
    if compat:
        return spark.read.csv(path, schema="mid string, label string, num bigint", escape='"', quote='"')
    # a field is quoted, or runs to a comma without a backslash before it
    line = r'^([^,]*),("(?:[^"\\]|\\.|"")*"|(?:[^,\\]|\\.)*),?\s*(-?\d*)'
    part = lambda i: F.regexp_extract("value", line, i)
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace(part(2), '^"|"$', ""), '""', '"'), r"\\(.)", "$1")
    return spark.read.text(path).where("value != ''").select(part(1).alias("mid"), label.alias("label"), F.when(part(3) != "", part(3)).cast("bigint").alias("num"))


def read_int_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="head bigint, rel int, tail bigint", sep="\t")


def first_of_each(triples: DataFrame, relations: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first ``most`` triples of each wanted relation."""
    from chronolattice.operators.dataset import cap_by

    return cap_by(triples.join(relations.select("rel"), "rel", "left_semi"), "rel", most, *order)


def read_dataset(spark: SparkSession, path: str, kind: str, columns: dict[str, str] | None = None, most: int | None = None, system: str | None = None) -> DataFrame:
    """A training dataset of csv, json, jsonl or txt with columns renamed to prompt, query, response and history."""
    if kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    elif kind == "txt":
        df = spark.read.text(path).withColumnRenamed("value", "prompt")
    else:
        df = spark.read.json(path, multiLine=kind == "json")
    for ours, theirs in (columns or {}).items():
        df = df.withColumnRenamed(theirs, ours)
    df = df.withColumn("system", F.lit(system)) if system else df
    return df.limit(most) if most else df


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha1) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha1("content").alias("sha1"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_stages(stages: dict[str, DataFrame], folder: str) -> list[str]:
    """Writes what the stages of a pipeline made, each as JSON lines in a folder of its name; returns the paths."""
    paths = []
    for name, df in stages.items():
        paths.append(f"{folder.rstrip('/')}/{name}")
        df.write.mode("overwrite").json(paths[-1])
    return paths


def load_if_there(spark: SparkSession, readers: dict) -> dict[str, DataFrame | None]:
    """What each reader (path, function of the path) gives, or None where there is nothing at the path yet. Nothing is read."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), {}
    for name, (path, read) in readers.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        out[name] = read(path) if p.getFileSystem(conf).exists(p) else None
    return out
