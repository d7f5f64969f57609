"""Fuzzy grounding against all pairs; labels by an index against all labels."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolattice.operators import grounding as gr
from chronolattice.operators import nearest


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def brute_fuzzy(asked, paths):
    out = {}
    for r in asked:
        want = "/" + r.strip("/").replace(".", "/")
        best = max(((ratio(p, want), p) for p in paths), default=(0, None))
        tail = max(((ratio(p, want), p) for p in paths if p.endswith("/" + want.rsplit("/", 1)[-1])), default=(0, None))
        out[r] = ("exact", want, 1.0) if want in paths else ("fuzzy", best[1], best[0]) if best[0] >= 0.6 else ("suffix", tail[1], tail[0]) if tail[0] >= 0.5 else ("none", None, None)
    return out


@pytest.mark.parametrize("each", [50_000, 60])
def test_fuzzy_grounding_loses_none(spark, each):
    rng = np.random.default_rng(8)
    parts = ["people", "person", "place", "film", "actor", "award", "date", "from", "to", "of_birth", "location", "sports", "team", "roster", "x", "q_z"]
    some = lambda n: "/".join(rng.choice(parts, n))
    paths = sorted({"/" + some(rng.integers(2, 5)) for _ in range(300)} | {"/" + "ab" * 150, "/trade/supplier/balance"})
    asked = [some(3).replace("/", ".") for _ in range(60)] + ["", ".", "zzzz", "people.person.dat_of_birth", "w.w.w.roster", "ww.uu.balance", "q.q.date", "ab" * 149 + ".b"]
    asked += ["".join(c for c in paths[i][1:].replace("/", ".") if rng.random() > 0.2) for i in range(0, len(paths), 5)]
    relations = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, rel int")
    predicted = spark.createDataFrame([(r,) for r in [*asked, asked[0], None]], "relation string")
    got = gr.ground_fuzzy(predicted, relations, each=each).collect()
    want = brute_fuzzy(set(asked), paths)
    assert len(got) == len(asked) + 2
    for r in got:
        assert (r["how"], r["path"], r["score"]) == (want[r["relation"]] if r["relation"] is not None else ("none", None, None)), r
        assert r["rel"] is None or paths[r["rel"]] == r["path"]
    assert {"exact", "fuzzy", "suffix", "none"} <= {r["how"] for r in got}
    near = gr.most_similar(predicted.where("relation is not null").distinct(), relations, 0.6, 0.5, each)
    compared = near.agg(F.sum("compared")).first()[0]
    assert compared < 0.25 * len(set(asked)) * len(paths)
    assert gr.ground_fuzzy(predicted, relations.limit(0)).select("how").distinct().collect()[0][0] == "none"
    assert gr.ground_fuzzy(predicted.limit(0), relations).collect() == []


def test_one_plan_of_the_dictionary(spark):
    from chronolattice.queries import analysis

    plan = analysis.QUERIES["ground_fuzzy"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 12 and "SinglePartition" not in plan


def brute_nearest(queries, labels, k, least):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = set()
    for q, v in queries:
        if v is None or len(v) != 8 or not np.any(v) or not np.isfinite(v).all():
            continue
        found = sorted(((-round(float(unit(v) @ unit(w)), 6), x) for x, w in labels.items()))
        out |= {(q, x, r + 1) for r, (s, x) in enumerate(found[:k]) if -s > least}
    return out


def test_label_index(spark, monkeypatch):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(12, 8))
    labels = {f"l{i:03d}": (middles[i % 12] + 0.3 * rng.normal(size=8)).tolist() for i in range(300)}
    labels["l300"] = labels["l007"]  # equal vectors: the smaller label comes first
    odd = [("bad", None), ("zero", [0.0] * 8), (None, [1.0] * 8), ("short", [1.0, 2.0]), ("l007", labels["l007"])]
    table = spark.createDataFrame([*labels.items(), *odd], "label string, vector array<double>")
    asked = [(i, (middles[i % 12] + 0.3 * rng.normal(size=8)).tolist()) for i in range(40)] + [(100, labels["l007"]), (101, None), (102, [0.0] * 8), (103, [1.0])]
    queries = spark.createDataFrame(asked, "query int, vector array<double>")
    monkeypatch.setattr(nearest, "CHUNK", 10)  # lists in chunks
    ix = nearest.LabelIndex(table, lists=12)
    assert ix.chunks and 1 <= ix.probes <= 12
    rows = lambda df: {(r["query"], r["label"], r["rank"]) for r in df.collect()}
    assert rows(ix.exact(queries, 3)) == brute_nearest(asked, labels, 3, 0.2)
    assert rows(ix.nearest(queries, 3)) <= {(q, x, r) for q, x, _ in brute_nearest(asked, labels, 300, 0.2) for r in (1, 2, 3)}
    got = ix.recall(queries, 3).first()
    assert got["queries"] == 41 and got["wanted"] == 123 and got["recall"] >= 0.9
    assert ix.nearest(queries.limit(0)).collect() == []
    none = nearest.LabelIndex(table.limit(0))
    assert none.nearest(queries).collect() == [] and none.exact(queries).collect() == []


def test_text_vectors(spark):
    words = ["Alexander the Great", "alexander  the_great", "Alexandre the Great", "Napoleon", "", None]
    v = {r["k"]: np.array(r["vector"]) for r in nearest.text_vectors(spark.createDataFrame(list(enumerate(words)), "k int, t string"), "k", "t").collect()}
    cos = lambda a, b: float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    assert cos(0, 1) > 0.9999 and 0.6 < cos(0, 2) < 0.99 and cos(0, 3) < 0.3 and not v[4].any() and not v[5].any()


def test_nearest_over_blocks_of_odd_vectors(spark):
    import math

    from chronolattice.operators import grounding as gr

    vectors = {i: [float(i % 7 - 3), float(i * i % 11 - 5), float(i % 5 - 2)] for i in range(60)} | {60: [0.0, 0.0, 0.0], 61: None, 62: [1.0, None, 2.0], 63: [1.0, 2.0], 64: [math.nan, 1.0, 1.0]}
    rows = spark.createDataFrame([(i, str(i), v) for i, v in vectors.items()], "id long, label string, vector array<float>")
    good = {i: v for i, v in vectors.items() if i < 60 and any(v)} | {63: [1.0, 2.0]}

    def like(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6) if len(a) == len(b) else 0

    want = {}
    for i, v in good.items():
        best = sorted((-like(v, w), str(j)) for j, w in good.items() if like(v, w) > 0.2)[:3]
        want[i] = [b for _, b in best]
    for each in (7, 2048):
        got = {}
        for r in gr.nearest(rows.select(F.col("id").alias("query"), "vector"), rows.select("label", "vector"), 3, 0.2, each).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["label"])
        assert got == want


def test_pairs_of_spellings_are_compared_once(spark):
    from chronolattice.operators.beams import similar_relations

    asked = [(i, "trade.order.custmer", r) for i in range(20) for r in ("trade.order.customer", "trade.order.date")] + [(0, "trade.order.custmer", "trade.order.customer")]
    got = similar_relations(spark.createDataFrame(asked, "slot long, text string, relation string"), 1)
    assert {r["relation"] for r in got.collect()} == {"trade.order.customer"} and got.count() == 20
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()  # slots meet similarities that are there
