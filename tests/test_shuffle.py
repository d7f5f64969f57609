"""The shuffle buffer: displacement, every row once, and streams that begin again."""

import random

import pytest
from pyspark.sql import functions as F

from chronolattice.streaming import shuffle as sh


@pytest.mark.parametrize(("n", "rows"), [(0, 50), (1, 50), (7, 200), (64, 64), (100, 30), (5, 0)])
def test_displacement(n, rows):
    buffer, out = [], []
    for at in range(0, rows, 13):
        out += sh.passed(buffer, range(at, min(rows, at + 13)), n, 3, 0, at)
    assert len(buffer) == min(n, rows)
    out += sh.drained(buffer, 3, 0, rows)
    assert sorted(out) == list(range(rows))
    assert all(place - row >= -n for place, row in enumerate(out))
    if 1 < n < rows:
        assert out != sorted(out)
    again, more = [], []
    more += sh.passed(again, range(rows), n, 3, 0, 0)
    more += sh.drained(again, 3, 0, rows)
    assert more == out  # however the rows come


def table(spark, n):
    rng = random.Random(1)
    rows = [(i, None if i % 7 == 0 else f"t\n{i}\"", float("nan") if i % 5 == 0 else rng.random(), [1, None]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, x double, l array<int>").withColumn("at", F.timestamp_micros(F.col("id") * 1_234_567))


def plain(df):
    return sorted(map(repr, df.collect()))


def test_batch(spark):
    t = table(spark, 500).repartition(3, "id").sortWithinPartitions("id")
    out = sh.shuffle_buffer(t, 20)
    assert out.schema == t.schema and plain(out) == plain(t)
    assert [r["id"] for r in out.collect()] == [r["id"] for r in sh.shuffle_buffer(t, 20).collect()] != [r["id"] for r in t.collect()]
    assert sh.shuffle_buffer(t.limit(0), 20).collect() == []


def test_stream_begins_again(spark, tmp_path):
    t = table(spark, 400)
    whole = lambda: spark.read.schema(t.schema).parquet(f"{tmp_path}/out")

    def run():
        s = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = sh.buffered(s, 25, F.col("id"), parts=2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    t.where("id < 200").coalesce(1).write.parquet(f"{tmp_path}/in")
    run()
    first = whole().count()
    assert first == 150 and sh.left_over(spark, f"{tmp_path}/check", t.schema).count() == 50
    t.where("id >= 200").coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    left = sh.left_over(spark, f"{tmp_path}/check", t.schema)
    assert left.count() == 50 and plain(whole().unionByName(left)) == plain(t)
