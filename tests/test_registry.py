"""Families, templates and builders as functions of SQL."""

import pytest

from chronolattice.operators.dataset import Family
from chronolattice.operators.registry import Registry
from chronolattice.sources.kg import SCHEMA


@pytest.fixture
def registry(spark):
    rows = []
    for i, (a, b) in enumerate([("1995-01-01", "1997-01-01"), ("2000", None), (None, None)]):
        rows += [("m.t", "a.b.has", f"g.{i}", "entity", None, None), (f"g.{i}", "a.b.who", f"m.x{i}", "entity", None, None), (f"g.{i}", "a.b.what", f"m.y{i}", "entity", None, None)]
        rows += [(f"g.{i}", "a.b.from", a, "literal", None, None)] * (a is not None) + [(f"g.{i}", "a.b.to", b, "literal", None, None)] * (b is not None)
    rows += [("m.t", "rdfs:label", "It's \\ a 'topic'", "literal", None, "en")]
    r = Registry(spark, spark.createDataFrame(rows, SCHEMA))
    r.family(Family("who", "a.b.has", "a.b.who", "a.b.from", "a.b.to", templates=("simple", "during"), role="person"))
    r.template("s1", "simple", "Who's the {role} of {topic_label}?", "join")
    return r


def test_functions(spark, registry):
    assert {r["answer_mid"] for r in spark.sql("SELECT * FROM mined('who', 1990, 1999)").collect()} == {"m.x0", "m.x2"}
    assert {r["answer_mid"] for r in spark.sql("SELECT * FROM mined_who(2000, 2000)").collect()} == {"m.x1", "m.x2"}
    assert spark.sql("SELECT * FROM mined('nobody', 0, 9999)").collect() == [] and spark.sql("SELECT * FROM asked('nobody', 0, 9999)").collect() == []
    got = {(r["template_id"], r["question"], r["s_expression"]) for r in spark.sql("SELECT * FROM asked('who', 0, 9999)").collect()}
    assert got == {("s1", "Who's the person of It's \\ a 'topic'?", "(JOIN (R a.b.who) m.t)")}
    assert spark.sql("SELECT ask_s1('role', 'topic', 'answer', '1999') q, build_tc('a.b.c', 'm.x', 'a.b.from', '1999') e").first() == ("Who's the role of topic?", "(TC (JOIN (R a.b.c) m.x) a.b.from 1999)")


def test_added_and_replaced_at_run_time(spark, registry):
    registry.builder("odd", "concat('(COUNT (JOIN (R ', answer_relation, ') ', topic_mid, '))')")
    registry.template("d1", "during", "In {year}?", "odd")
    registry.family(Family("what", "a.b.has", "a.b.what", "a.b.from", templates=("during",)))
    assert {(r["question"], r["s_expression"]) for r in spark.sql("SELECT * FROM asked('what', 1990, 1999)").collect()} == {("In 1995?", "(COUNT (JOIN (R a.b.what) m.t))"), ("In 2000?", "(COUNT (JOIN (R a.b.what) m.t))")}
    registry.template("d1", "during", "When in {year}?", "join")
    assert {r["question"] for r in spark.sql("SELECT * FROM asked('what', 2000, 2000) WHERE template_id = 'd1'").collect()} == {"When in 2000?"}
    with pytest.raises(ValueError):
        registry.builder("no name", "1")


def test_a_constant_name_leaves_one_branch(spark, registry):
    registry.family(Family("what", "a.b.has", "a.b.what", "a.b.from"))
    plan = spark.sql("SELECT * FROM mined('who', 1990, 1999)")._jdf.queryExecution().optimizedPlan().toString()
    assert "a.b.who" in plan and "a.b.what" not in plan


def test_schema_follows_the_arguments(spark, registry):
    registry.template("d1", "during", "In {year}?", "tc")
    table = "SELECT id, IF(id = 1, NULL, 'T') AS topic_label, 'r' AS role, 1990 + id AS year FROM range(3)"
    df = spark.sql(f"SELECT * FROM with_questions(TABLE({table}), 'd1, s1')")
    assert df.columns == ["id", "topic_label", "role", "year", "d1", "s1"]
    assert {(r["id"], r["d1"], r["s1"]) for r in df.collect()} == {(0, "In 1990?", "Who's the r of T?"), (1, "In 1991?", None), (2, "In 1992?", "Who's the r of T?")}
    for wrong in ("'nope'", "'s1, nope'"):
        with pytest.raises(Exception, match="no template"):
            spark.sql(f"SELECT * FROM with_questions(TABLE({table}), {wrong})").collect()
    with pytest.raises(Exception, match="no column role"):
        spark.sql("SELECT * FROM with_questions(TABLE(SELECT 'T' AS topic_label FROM range(2)), 's1')").collect()
