"""The surface index that stays."""

from chronolattice.operators import grounding as gr
from chronolattice.sources import surface_cache as sc


def rows(df):
    return sorted(map(tuple, df.select("surface", "mid", "score", "name", "popularity").collect()), key=repr)


def test_cache(spark, tmp_path):
    (tmp_path / "map.tsv").write_text("New  York\t0.9\tm.1\nNew York\t0.5\tm.2\nnew york!\tnone\tm.3\nshort line\nParis\t0.7\tm.9\n")
    (tmp_path / "list.tsv").write_text("m.1\tNew York\t12\tNYC\tBig Apple\nm.2\tNew York City\t7\nm.3\tNo\tx\n")
    m, e = sc.read_surface_map(spark, f"{tmp_path}/map.tsv"), sc.read_entity_list(spark, f"{tmp_path}/list.tsv")
    assert {tuple(r) for r in m.collect()} == {("New  York", "m.1", 0.9), ("New York", "m.2", 0.5), ("Paris", "m.9", 0.7)}
    assert {r["mid"]: (r["name"], r["score"], r["aliases"]) for r in e.collect()} == {"m.1": ("New York", 12, ["NYC", "Big Apple"]), "m.2": ("New York City", 7, [])}
    folder = f"file://{tmp_path}/index"
    one, built = sc.cached_surface_index(folder, m, e, buckets=4)
    assert built and rows(one) == rows(gr.surface_index(m, e)) == [("new york", "m.1", 0.9, "New York", 12.0), ("new york", "m.2", 0.5, "New York City", 7.0)]
    # the same rows in another order, in a session that knows no such table: read, not built
    again = m.orderBy("score")
    spark.sql(f"DROP TABLE surface_{sc.checksum(m, e.select('mid', 'name', e['score'].cast('double').alias('score')))}_4")
    two, built = sc.cached_surface_index(folder, again, e, buckets=4)
    assert not built and rows(two) == rows(one)
    # another source is another index; the first one stays
    three, built = sc.cached_surface_index(folder, m.where("mid = 'm.1'"), e, buckets=4)
    assert built and len(rows(three)) == 1 and len(rows(two)) == 2
    # a build that was cut short is built anew
    done = next(p for p in (tmp_path / "index").glob("*/_SUCCESS"))
    done.unlink()
    assert sc.cached_surface_index(folder, m, e, buckets=4)[1] or sc.cached_surface_index(folder, m.where("mid = 'm.1'"), e, buckets=4)[1]
    none, built = sc.cached_surface_index(folder, m.limit(0), e, buckets=4)
    assert built and rows(none) == []


def test_index_side_stays_where_it_is(spark, tmp_path):
    m = spark.createDataFrame([(f"name {i}", f"m.{i}", 0.5) for i in range(50)], "surface string, mid string, score double")
    e = spark.createDataFrame([(f"m.{i}", f"name {i}", i) for i in range(50)], "mid string, name string, score long")
    index, _ = sc.cached_surface_index(f"file://{tmp_path}/index", m, e, buckets=4)
    mentions = spark.createDataFrame([("Name 3",), ("name 7",)], "mention string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = gr.top_surface(mentions, index)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {r["mid"] for r in found.collect()} == {"m.3", "m.7"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    right = plan[plan.index("SortMergeJoin") :]
    side = right[right.rindex("FileScan parquet") - 400 :]
    assert "Bucketed: true" in side and "Exchange hashpartitioning(surface" not in side.split("FileScan parquet")[0].splitlines()[-1]
    assert plan.count("Exchange hashpartitioning(surface") == 1  # of the mentions only
