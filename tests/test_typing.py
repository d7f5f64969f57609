"""Types of expressions by their relations."""

import re

import pytest

from chronolattice.plans.typing import Roles, relation_roles, typed, typed_forms
from chronolattice.sources.kg import SCHEMA

ROLES = Roles(
    {"p.q.child": "p.person", "p.q.born": "p.person", "g.h.city_in": "geo.city", "p.q.date": "p.person", "p.q.alum": "p.student"},
    {"p.q.child": "p.person", "p.q.born": "geo.city", "g.h.city_in": "geo.country", "p.q.date": "dateTime", "p.q.alum": "s.school"},
    {"p.student": frozenset({"p.person"})},
)
XSD = "http://www.w3.org/2001/XMLSchema#"


@pytest.mark.parametrize(
    ("text", "want", "kind", "conflicts"),
    [
        ("(JOIN (R p.q.child) m.x)", "(JOIN[p.person] (R p.q.child[p.person>p.person]) m.x[p.person])", "p.person", ""),
        ("(JOIN p.q.born (JOIN g.h.city_in m.c))", "(JOIN[p.person] p.q.born[p.person>geo.city] (JOIN[geo.city] g.h.city_in[geo.city>geo.country] m.c[geo.country]))", "p.person", ""),
        ("(COUNT (AND p.person (JOIN x.y.z m.c)))", "(COUNT[integer] (AND[p.person] p.person[p.person] (JOIN[p.person] x.y.z[?>?] m.c[?])))", "integer", ""),
        ("(ARGMAX (JOIN x.y.z m.c) (JOIN p.q.born g.h.city_in))", "(ARGMAX[p.person] (JOIN[p.person] x.y.z[?>?] m.c[?]) (JOIN p.q.born[p.person>geo.city] g.h.city_in[geo.city>geo.country]))", "p.person", ""),
        (f'(AND (JOIN p.q.born m.c) (gt p.q.date "1990"^^{XSD}gYear))', f'(AND[p.person] (JOIN[p.person] p.q.born[p.person>geo.city] m.c[geo.city]) (gt[p.person] p.q.date[p.person>dateTime] "1990"^^{XSD}gYear[gYear]))', "p.person", ""),
        ("(lt p.q.date 1990)", "(lt[p.person] p.q.date[p.person>dateTime] 1990[dateTime])", "p.person", ""),
        ("(AND (JOIN p.q.alum m.s) (JOIN p.q.born m.c))", "(AND[p.student] (JOIN[p.student] p.q.alum[p.student>s.school] m.s[s.school]) (JOIN[p.student] p.q.born[p.person>geo.city] m.c[geo.city]))", "p.student", ""),
        ("(AND geo.city (JOIN p.q.born m.c))", "(AND[geo.city] geo.city[geo.city] (JOIN[geo.city] p.q.born[p.person>geo.city] m.c[geo.city]))", "geo.city", "geo.city and p.person"),
        ("(TC (JOIN (R p.q.child) m.x) p.q.date 1990)", "(TC[p.person] (JOIN[p.person] (R p.q.child[p.person>p.person]) m.x[p.person]) p.q.date[p.person>dateTime] 1990)", "p.person", ""),
        ("(JOIN type.object.type p.person)", "(JOIN[p.person] type.object.type[?>?] p.person[p.person])", "p.person", ""),
        ("(AND (JOIN x.y.z m.c) (JOIN p.q.child m.c))", "(AND[p.person] (JOIN[p.person] x.y.z[?>?] m.c[?]) (JOIN[p.person] p.q.child[p.person>p.person] m.c[p.person]))", "p.person", ""),
        ("(JOIN", None, None, ""),
    ],
)
def test_types(text, want, kind, conflicts):
    assert typed(text, ROLES) == (want, kind, conflicts)


def test_roles_of_a_graph(spark):
    e = [("m.a", "type.object.type", "p.person"), ("m.b", "type.object.type", "p.person"), ("m.b", "type.object.type", "p.star"), ("m.c", "type.object.type", "geo.city"), ("m.a", "p.q.born", "m.c"), ("m.b", "p.q.born", "m.c"), ("m.z", "p.q.odd", "m.z")]
    rows = [(s, p, o, "entity", None, None) for s, p, o in e] + [("m.a", "p.q.name", "A", "literal", None, "en"), ("m.a", "p.q.date", "1990", "literal", "dateTime", None)]
    graph = spark.createDataFrame(rows, SCHEMA)
    got = {r["relation"]: (r["domain"], r["range"]) for r in relation_roles(graph).collect()}
    assert got == {"p.q.born": ("p.person", "geo.city"), "p.q.odd": (None, None), "p.q.name": ("p.person", "string"), "p.q.date": ("p.person", "dateTime")}
    up = spark.createDataFrame([("a.b", "c.d"), ("c.d", "e.f")], "class string, super string")
    asked = spark.createDataFrame([(1, "(AND e.f (AND a.b (JOIN p.q.odd m.x)))"), (2, None), (3, "nothing (")], "id int, sexpr string")
    out = {r["id"]: (r["answer_type"], r["conflicts"]) for r in typed_forms(asked, relation_roles(graph), up).collect()}
    assert out == {1: ("a.b", ""), 2: (None, ""), 3: (None, "")}
    assert typed_forms(asked.limit(0), relation_roles(graph.limit(0))).collect() == []


def test_edges_of_nodes_without_class_leave_before_they_are_dealt(spark):
    rows = [("x", "type.object.type", "k.one"), ("m.p1", "type.object.type", "k.two"), ("m.p2", "type.object.type", "k.two"), ("x", "a.b.c", "m.p1"), ("m.p1", "a.b.c", "g.l1"), ("m.p2", "a.b.c", "x"), ("g.l1", "a.b.d", "m.p2"), ("m.q", "a.b.d", "y")]
    graph = spark.createDataFrame([(s, p, o, "entity", None, None) for s, p, o in rows], SCHEMA)
    roles = relation_roles(graph)
    assert {tuple(r) for r in roles.collect()} == {("a.b.c", "k.two", "k.one"), ("a.b.d", None, "k.two")}
    # both ends meet the first letters of classed nodes' names, which every task has, before anything is dealt by node
    plan = roles._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join Inner, .*= __head#.*strategy=broadcast", plan)) == 2
