"""Queries in SQL over functions that were registered by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolattice.operators.dataset import TEMPLATES, Family
from chronolattice.operators.registry import Registry
from chronolattice.queries.dataset import _G, FAMILIES
from chronolattice.sources.kg import row_facts, triples


def _registry(s: SparkSession, d: str) -> Registry:
    r = Registry(s, triples(s, d), row_facts(s, d))
    for f in FAMILIES[:2]:
        r.family(f)
    for t in TEMPLATES[:1]:
        r.template(*t)
    return r


def _mined(s: SparkSession, d: str) -> DataFrame:
    _registry(s, d)
    return s.sql("SELECT fact_relation_family, topic_mid, answer_mid, temporal_start FROM mined('order_supplier', 1996, 1998)")


def _added(s: SparkSession, d: str) -> DataFrame:
    """A family, a template and a builder that come later."""
    r = _registry(s, d)
    r.family(Family("order_when", "trade.order.lines", "trade.line.supplier", "trade.line.from", templates=("dated",), role="seller"))
    r.builder("since", "format_string('(AND (JOIN (R %s) %s) (ge %s \\\"%s\\\"))', answer_relation, topic_mid, time_relation, date)")
    r.template("dated_01", "dated", "Which {role} served {topic_label} since {year}?", "since")
    return s.sql("SELECT DISTINCT question, s_expression FROM asked('order_when', 1900, 2100)")


def _wide(s: SparkSession, d: str) -> DataFrame:
    """Questions of customers, a column each, over a table that is none of facts."""
    r = _registry(s, d)
    r.template("who", "any", "Who is {topic_label}, the {role}?", "join")
    r.template("when", "any", "What did {topic_label} do in {year}?", "tc")
    r.spark.read.parquet(f"{d}/customer.parquet").createOrReplaceTempView("__customers")
    return s.sql("SELECT c_custkey, who, `when` FROM with_questions(TABLE(SELECT c_custkey, c_name AS topic_label, lower(c_mktsegment) AS role, 1990 + c_custkey % 20 AS year FROM __customers), 'who, when')")


QUERIES = {
    "registry_mined": _mined,
    "registry_added": _added,
    "registry_questions": _wide,
}

ORACLES = {
    "registry_mined": f"{_G} SELECT fam fact_relation_family, topic topic_mid, ans answer_mid, a temporal_start FROM f WHERE fam = 'order_supplier' AND (a IS NULL OR a = '' OR CAST(a[:4] AS INT) BETWEEN 1996 AND 1998)",
    "registry_added": f"{_G} SELECT DISTINCT 'Which seller served ' || tl || ' since ' || a[:4] || '?' question, '(AND (JOIN (R trade.line.supplier) ' || topic || ') (ge trade.line.from \"' || a || '\"))' s_expression FROM f WHERE fam = 'order_supplier'",
    "registry_questions": "SELECT c_custkey, 'Who is ' || c_name || ', the ' || lower(c_mktsegment) || '?' who, 'What did ' || c_name || ' do in ' || (1990 + c_custkey % 20) || '?' AS \"when\" FROM customer",
}
