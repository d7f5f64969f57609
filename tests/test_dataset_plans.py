"""What mining and generation deal: facts by answer and by topic, candidates never again."""

import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from chronolattice.functions import text as fx
from chronolattice.operators import dataset as ds
from chronolattice.queries import dataset as q
from chronolattice.queries import review
from chronolattice.sources.kg import SCHEMA, cvt_facts, row_facts, triples

SF = "/root/testdata/sf0.001"


def dealt(df) -> list[str]:
    """The keys of all hash exchanges of a plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_candidates_stay_where_their_facts_lie(spark):
    keys = " ".join(dealt(q.QUERIES["gen_candidates"](spark, SF)))
    assert "topic_mid" in keys and "fact_id" not in keys and "s_expression" not in keys and "cvt" not in keys


@pytest.mark.parametrize("family", q.FAMILIES, ids=lambda f: f.family)
def test_rows_say_what_the_graph_says(spark, family):
    g = triples(spark, SF)
    hops = (family.to_cvt, family.to_answer, family.start, family.end)
    a, b = cvt_facts(g, *hops), row_facts(spark, SF)(g, *hops)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_other_relations_are_looked_up_in_the_graph(spark):
    g = triples(spark, SF)
    hops = ("trade.order.customer", "trade.customer.nation", "trade.order.date")
    a, b = cvt_facts(g, *hops), row_facts(spark, SF)(g, *hops)
    assert a.count() == b.count() > 0


def test_mined_over_rows_and_over_the_graph(spark):
    g = triples(spark, SF)
    a, b = ds.mine_facts(g, q.FAMILIES), ds.mine_facts(g, q.FAMILIES, facts_of=row_facts(spark, SF))
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    assert b.where(F.col("fact_id").isNull()).isEmpty()


def test_verification_deals_no_samples(spark):
    keys = dealt(q.QUERIES["verify_samples"](spark, SF))
    assert any("topic_entity_mid" in k for k in keys) and not any("sample_id" in k or "cvt" in k for k in keys)


def test_generated_samples_verify_like_any(spark):
    g, c = triples(spark, SF), q._candidates(spark, SF).where("crc32(sample_id) % 5 = 0")
    a = ds.verify(c, ds.answer_candidates(g, c, tuple({r for f in q.FAMILIES for r in (f.to_cvt, f.to_answer, f.start, f.end) if r})))
    b = ds.verify_generated(c, g, q.FAMILIES, row_facts(spark, SF))
    cols = ("sample_id", "predicted", "answers", "verified", "verification_error")
    assert a.count() == b.count() and a.select(*cols).exceptAll(b.select(*cols)).isEmpty()


def test_registered_families_join_no_nodes_by_name(spark):
    from chronolattice.queries.registry import QUERIES

    keys = dealt(QUERIES["registry_added"](spark, SF))
    assert any("topic_mid" in k for k in keys) and not any("cvt" in k for k in keys)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["fact_summary", "mine_capped", "mine_total", "fact_sample", "summaries", "validation_issues", "review_totals"])
def test_labels_that_nobody_reads_deal_no_facts(spark, no_broadcast, name):
    """Labels too many to be broadcast: facts are not dealt by answer, and both kinds of facts of a line come from one join."""
    from chronolattice.queries import review

    keys = dealt((q.QUERIES | review.QUERIES)[name](spark, SF))
    plan = (q.QUERIES | review.QUERIES)[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("l_orderkey" in k for k in keys) == 1 and "topic_mid" in plan
    if name == "fact_sample":  # labels are looked up for ten facts
        assert plan.index("TakeOrderedAndProject") > plan.index("answer_mid")
    else:
        assert not any("answer_mid" in k for k in keys)


def test_repeats_are_told_in_rows_without_texts(spark):
    sorts = re.findall(r"Sort \[topic_mid.*?\n.*", q.QUERIES["gen_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert sorts and not any("question" in s or "s_expression" in s for s in sorts)


def test_nodes_that_show_as_blank_are_in_no_fact(spark):
    n = lambda s, p, o, lang=None: (s, p, o, "literal", None, lang)
    rows = [n(f"t{i}", "a.b.to", f"c{i}") for i in range(6)] + [n(f"c{i}", "a.b.of", x) for i, x in enumerate(("x0", "x1", " ", "x3", "x4", ""))]
    rows += [n("x0", "rdfs:label", " ", "en"), n("x1", "rdfs:label", " ", "en"), n("x1", "rdfs:label", "", "de"), n("x3", "rdfs:label", "", "en"), n("x3", "rdfs:label", "!", "en"), n("t4", "rdfs:label", "", "de"), n("", "rdfs:label", "Nil", "en")]
    rows[7:7] = [n("x1", "rdfs:label", "\t", "en")]  # sorts before a blank
    of = ds.families(ds.Family("f", "a.b.to", "a.b.of", "a.b.from"))
    got = ds.mine_facts(spark.createDataFrame(rows, SCHEMA), of).select("topic_mid", "answer_label").collect()
    assert sorted(map(tuple, got)) == [("t1", "\t"), ("t4", "x4"), ("t5", "Nil")]


@pytest.mark.parametrize("name", ["mine_capped", "mine_total"])
def test_few_facts_are_chosen_before_they_are_dealt(spark, name):
    plan = (q.QUERIES | review.QUERIES)[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # the plan is printed from the top: below the exchange by topic, facts past a hash of their family have left
    assert "__limit" in plan[plan.index("Exchange hashpartitioning(topic_mid") :]


@pytest.mark.parametrize("limits", [{"cap": 3}, {"total": 5}, {"cap": 2, "total": 3}, {"cap": 4, "total": 2}])
def test_first_facts_with_repeats(spark, limits):
    """Facts that come three times take one place."""
    few = lambda *a: facts_of(*a).where("crc32(topic) % 7 = 0")
    facts_of = row_facts(spark, SF)
    thrice = lambda *a: few(*a).unionByName(few(*a)).unionByName(few(*a))
    g = triples(spark, SF)
    a, b = (ds.mine_facts(g, q.FAMILIES, facts_of=f, **limits) for f in (few, thrice))
    every = sorted((q.FAMILIES.index(next(x for x in q.FAMILIES if x.family == r[0])), r[1]) for r in ds.mine_facts(g, q.FAMILIES, facts_of=few).select("fact_relation_family", "supporting_row_hash").collect())
    want = [r for i in range(len(q.FAMILIES)) for r in [x for x in every if x[0] == i][: limits.get("cap")]][: limits.get("total")]
    for df in (a, b):
        assert sorted(r.supporting_row_hash for r in df.collect()) == sorted(h for _, h in want)


def test_candidates_of_repeated_facts(spark):
    """Facts that come twice make the same candidates, so they are not told apart before."""
    plan = q.QUERIES["summaries"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"HashAggregate\(keys=\[[^]]*answer_mid", plan)
    few = ds.mine_facts(triples(spark, SF), q.FAMILIES, facts_of=row_facts(spark, SF)).where("crc32(topic_mid) % 9 = 0")
    a, b = ds.generate(few, q.FAMILIES), ds.generate(few.unionByName(few).unionByName(few), q.FAMILIES)
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def test_totals_deal_no_expressions(spark):
    assert not any("s_expression" in k for k in dealt(review.QUERIES["sample_totals"](spark, SF)))
    rows = [("a", "x", "t"), ("a", "x", "t"), ("a", "y", "t"), ("b", "z", "u"), (None, None, "u"), ("c", None, None), ("c", "v", ""), ("c", "v", "")]
    df = spark.createDataFrame(rows, "question string, s_expression string, topic_entity_mid string")
    assert ds.sample_totals(df, by="topic_entity_mid").collect() == ds.sample_totals(df).collect() and ds.sample_totals(df.limit(0), by="topic_entity_mid").collect() == ds.sample_totals(df.limit(0)).collect()


def test_draws_become_rows_in_compiled_code(spark):
    df = q._candidates(spark, SF).select("sample_id")
    df.collect()
    rows = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(slice(" in line]
    assert any(re.search(r"\*\(\d+\) Generate", line) for line in rows)


def test_answers_are_matched_once_a_sample(spark):
    v = q._verified(spark, SF)
    matches = lambda *c: v.select(*c)._jdf.queryExecution().optimizedPlan().toString().count("arrays_overlap")
    assert matches("verified", "verification_error", "answers") == matches("verified") > 0


def test_matches_of_plain_ids_and_of_anything_else(spark):
    cases = [
        (["m.a"], ["M.A"], True), (["m.a"], ["g.b", "m.A"], True), (["m.a"], ["m.b"], False), (["m.a|m.b"], ["m.b"], False), (["m.a|m.b"], ["m.a|M.B"], True), (["m.a\n"], ["m.a"], False),
        (["ns:m.a"], ["m.a"], True), (["2001-05-01"], ["2001"], True), ([" "], [""], True), ([], ["m.a"], False), ([None, "m.a"], ["m.a"], True), ([None, "m.a"], ["m.b"], None), (["?"], ["m.b"], False), ([""], ["m.a"], False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p array<string>, e array<string>, same boolean")
    got = {r["i"]: r["m"] for r in df.select("i", fx.answers_match(F.col("p"), F.col("e")).alias("m")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_a_pattern_is_in_no_text_without_its_words(spark):
    texts = spark.createDataFrame([(x,) for w in fx.WORDS.values() for a in w for x in (a, f"x {a} 1999", f"{a}y", a[1:], "none 1999", "")], "t string")
    for pattern, words in fx.WORDS.items():
        assert pattern in {p for _, p, _ in fx.TYPES}
        assert texts.where(F.col("t").rlike(pattern)).where(~reduce(lambda a, b: a | b, [F.col("t").contains(w) for w in words])).isEmpty()


def test_statuses_and_reasons_come_from_one_pass(spark):
    c = q._candidates(spark, SF)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("l_suppkey")
    assert scans(ds.review_summary(c)) <= scans(ds.reviewed(c).select("filter_issues"))


def test_review_counts_every_reason(spark):
    raw = spark.createDataFrame([("a", "In 1999, what?", "(TC x)", "during"), ("b", "", "(TC x)", "during"), ("c", " ", None, "unknown"), ("d", "who of m.a1?", "null", "last")], "sample_id string, question string, s_expression string, temporal_type string")
    s = raw.select("*", F.lit("synthetic").alias("source"), F.array(F.lit("m.x")).alias("answers"), F.lit("m.x").alias("topic_entity_mid"), F.array(F.lit("a.b")).alias("relation_ids"), F.struct(F.lit("s").alias("source_seed_id"), F.lit("m").alias("mined_fact_id")).alias("metadata"))
    got = {(r["metric"], r["key"]): r["n"] for r in ds.review_summary(s).collect()}
    want = {("status", "accepted"): 1, ("status", "rejected"): 3, ("reason", "question is required"): 2, ("reason", "s_expression is missing or null"): 2, ("reason", "temporal_type is unknown"): 1, ("reason", "question still contains raw mids"): 1, ("reason", "last sample must use ARGMAX"): 1, ("reason", "during sample should include a temporal value"): 1}
    assert got == want
    assert ds.review_summary(s.where("false")).count() == 0


def test_training_summary_reads_examples_once(spark):
    e = review._examples(spark, SF)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("l_suppkey")
    assert scans(ds.training_summary(e)) <= scans(e.select("source", "temporal_type"))


def test_training_summary_counts_everything(spark):
    e = spark.createDataFrame([("human", "last"), ("human", None), ("", "first"), (None, "last")], "source string, temporal_type string")
    rows = lambda df: {(r["metric"], r["key"]): r["n"] for r in ds.training_summary(df).collect()}
    want = {("total_examples", ""): 4, ("with_metadata", ""): 3, ("by_source", "human"): 2, ("by_source", ""): 1, ("by_temporal_type", "last"): 1, ("by_temporal_type", "unknown"): 1, ("by_temporal_type", "first"): 1}
    assert rows(e) == want
    assert rows(e.where("false")) == {("total_examples", ""): 0, ("with_metadata", ""): 0}
    assert ds.training_summary(e).dtypes == [("metric", "string"), ("key", "string"), ("n", "bigint")]
