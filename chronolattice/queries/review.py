"""Queries of summaries, grounding counters, reading of SPARQL, comparison of expressions and dialogue data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolattice.functions import text as fx
from chronolattice.operators import dataset as ds
from chronolattice.operators import evaluate as ev
from chronolattice.operators import grounding as gr
from chronolattice.operators import kb
from chronolattice.operators import training as tr
from chronolattice.plans import sexpr, sparql
from chronolattice.queries.analysis import _BEAMS, _IDX, _VALID, _beams, _index, _relations
from chronolattice.queries.dataset import _C, _G, _VERIFIED, _candidates, _facts, _human, _sql_questions, _type, _verified
from chronolattice.sources.kg import TRIPLES_SQL, table, triples

XSD = "http://www.w3.org/2001/XMLSchema#"
#: By dialect: SPARQL with {o}, {c} and {y} (order, customer, year) and the expression it stands for; null where it stands for none.
SPARQL = {
    "webqsp": (
        ("SELECT DISTINCT ?x WHERE { ns:m.o{o} ns:trade.order.lines ?x . FILTER (?x != ns:m.o{o}) }", "(JOIN (R trade.order.lines) m.o{o})"),
        ("SELECT DISTINCT ?x WHERE { ?x ns:trade.order.customer ns:m.c{c} . ?x ns:trade.order.date ?d . } ORDER BY DESC(xsd:datetime(?d)) LIMIT 5", "(ARGMAX (JOIN trade.order.customer m.c{c}) trade.order.date)"),
        ("SELECT DISTINCT ?x WHERE { { ?x ns:a.b.c ns:m.c{c} } UNION { ?x ns:a.b.d ns:m.c{c} } }", None),
        ("SELECT DISTINCT ?x WHERE { ?x ns:trade.order.customer ns:m.c{c} . OPTIONAL { ?x ns:trade.order.total ?t } }", None),
        ('SELECT DISTINCT ?x WHERE { ?x ns:trade.order.customer ns:m.c{c} . ?x ns:trade.order.date ?n . FILTER (?n > "{y}"^^xsd:dateTime) }', '(AND (JOIN trade.order.customer m.c{c}) (gt trade.order.date "{y}"^^' + XSD + "dateTime))"),
    ),
    "cwq": (
        ("SELECT DISTINCT ?x WHERE { ?x ns:trade.order.customer ?y . ?y ns:trade.customer.nation ns:m.0{c} . }", "(JOIN trade.order.customer (JOIN trade.customer.nation m.0{c}))"),
        ("SELECT ?x WHERE { ?x ns:trade.order.customer ns:m.0{c} . }", None),
        ("SELECT DISTINCT ?x WHERE { ?x ns:trade.order.customer ns:m.0{c} . ?x ns:trade.order.total ?t . } ORDER BY ?t LIMIT 1 OFFSET 1", None),
        ("SELECT DISTINCT ?x WHERE { ?x ns:trade.order.customer ns:m.0{c} . ?x ns:trade.order.lines ns:g.0{o} . }", "(AND (JOIN trade.order.customer m.0{c}) (JOIN trade.order.lines g.0{o}))"),
    ),
    "temporal": (
        ("SELECT ?x WHERE {{\n ns:m.o{o} ns:trade.order.lines ?x .\n}}".replace("{{", "{").replace("}}", "}"), "(JOIN (R trade.order.lines) m.o{o})"),
        ("SELECT ?x WHERE { ns:m.c{c} ns:a.b.c ?x . ?x ns:a.b.date ?d . } ORDER BY ?d LIMIT 1 OFFSET 2", "(ARGMIN (JOIN (R a.b.c) m.c{c}) a.b.date)"),
        ("SELECT ?x WHERE { ?x ns:a.b.c ns:m.c{c} . MINUS { ?x ns:a.b.d ?y } }", None),
        ("", None),
    ),
}
INTERVAL = 'SELECT ?x WHERE { ns:m.o1 ns:trade.order.lines ?x . FILTER(NOT EXISTS {?x ns:trade.line.from ?a} || EXISTS {?x ns:trade.line.from ?b . FILTER(xsd:datetime(?b) <= "1998-12-31"^^xsd:dateTime) }) FILTER(NOT EXISTS {?x ns:trade.line.to ?c} || EXISTS {?x ns:trade.line.to ?d . FILTER(xsd:datetime(?d) >= "1998-01-01"^^xsd:dateTime) }) }'


def _filled(templates, o, c, y):
    t = F.get(F.array(*[F.lit(x) for x in templates]), (o % len(templates)).cast("int"))
    for k, v in (("{o}", o), ("{c}", c), ("{y}", y)):
        t = F.replace(t, F.lit(k), v.cast("string"))
    return t


def _instances(dialect: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), _filled([a for a, _ in SPARQL[dialect]], F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate")).alias("sparql"))
        out = sparql.instances(o, dialect=dialect).drop("sparql")
        return out.withColumn("mids", F.concat_ws(",", F.sort_array("mids"))) if "mids" in out.columns else out

    return run


def _sql_instances(dialect: str) -> str:
    n = len(SPARQL[dialect])
    fill = lambda t: "replace(replace(replace('" + t + "', '{o}', CAST(o_orderkey AS VARCHAR)), '{c}', CAST(o_custkey AS VARCHAR)), '{y}', CAST(year(o_orderdate) AS VARCHAR))"
    cases = " ".join(f"WHEN {i} THEN {fill(b) if b else chr(39) + 'null' + chr(39)}" for i, (_, b) in enumerate(SPARQL[dialect]))
    mids = ", '0' || o_custkey AS m" if dialect == "cwq" else ""
    named = ", 'm.' || m AS mids" if dialect == "cwq" else ""
    return f"WITH x AS (SELECT o_orderkey k, CASE o_orderkey % {n} {cases} END e{mids} FROM orders) SELECT k, e AS \"SExpr\", CASE WHEN e = 'null' THEN 'none' ELSE 'parser' END AS \"SExpr_source\", e <> 'null' ok{named} FROM x"


#: Pairs of expressions with {o} and {c}, and whether they mean the same.
PAIRS = (
    ("(AND (JOIN a.b.c m.{c}) (JOIN a.b.d m.{o}))", "(AND (JOIN a.b.d m.{o}) (JOIN a.b.c m.{c}))", True),
    ("(JOIN a.b.c m.{c})", "(JOIN (R a.b.c) m.{c})", False),
    ("(AND (JOIN a.b.c m.{c}) (AND (JOIN a.b.d m.{o}) (gt a.b.n 5)))", "(AND (AND (gt a.b.n 5) (JOIN a.b.c m.{c})) (JOIN a.b.d m.{o}))", True),
    ("(COUNT (JOIN a.b.c m.{c}))", "(COUNT (JOIN a.b.c m.{c}0))", False),
    ("(ARGMAX (JOIN a.b.c m.{c}) a.b.d)", "(ARGMIN (JOIN a.b.c m.{c}) a.b.d)", False),
)


def _isomorphic(s, d):
    o = table(s, d, "orders")
    pair = [_filled([p[i] for p in PAIRS], F.col("o_orderkey"), F.col("o_custkey"), F.lit(0)).alias(n) for i, n in enumerate("ab")]
    return o.select(F.col("o_orderkey").alias("k"), *pair).select("k", sexpr.same_column(F.col("a"), F.col("b")).alias("same"))


def _numbers(s, d):
    o = table(s, d, "orders")
    raw = F.get(F.array(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" , 5")), F.concat(F.lit("m."), F.col("o_orderkey")), F.lit("½"), F.lit("-1e5"), F.lit("1.2.3"), F.lit("")), (F.col("o_orderkey") % 7).cast("int"))
    rel = F.concat(F.lit("/trade/order_kind/part_"), F.col("o_custkey"))
    form = F.concat(F.lit("JOIN trade.order.date_"), F.col("o_custkey"), F.lit(" m.o1 WITH"))
    return o.select(F.col("o_orderkey").alias("k"), fx.is_number(raw).alias("number"), fx.role_hint(rel).alias("hint"), fx.unsupported(F.when(F.col("o_orderkey") % 2 == 0, form).otherwise(F.lit("(JOIN a m.b)"))).alias("unsupported"), fx.short_relations(form).alias("short"), fx.xml_clean(F.concat(F.lit("a\x00b\x0d\x7fc\x86"), rel)).alias("clean"))


def _entities(s, d):
    c, o, n = (table(s, d, x) for x in ("customer", "orders", "nation"))
    mid = lambda letter, k: F.concat(F.lit(f"m.{letter}"), F.col(k))
    return c.select(mid("c", "c_custkey").alias("mid"), F.col("c_custkey").alias("id")).unionByName(o.where("o_orderstatus = 'F'").select(mid("o", "o_orderkey").alias("mid"), F.col("o_orderkey").alias("id"))).unionByName(n.select(mid("n", "n_nationkey").alias("mid"), F.col("n_nationkey").alias("id")))


def _grounded(s, d):
    return ev.grounded(_beams(s, d), _relations(s, d), _entities(s, d))


def _scopes(s, d):
    o = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    e = o.select("k", F.concat(F.lit("(TC (JOIN trade.line.part m.l"), "k", F.lit(") trade.line.from 1998)")).alias("s_expression"))
    g = triples(s, d)
    # line items are mediators named g.l...; the same facts under m. names of orders
    lines = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lambda rel, f: lines.select(F.concat(F.lit("m.l"), F.col("l_orderkey")).alias("s"), F.lit(rel).alias("p"), F.date_format(f("l_shipdate", "o_orderdate"), "yyyy-MM-dd").alias("o"))
    g = g.select("s", "p", "o").unionByName(named("trade.line.from", F.least)).unionByName(named("trade.line.to", F.greatest))
    return kb.bound_scopes(g, e).select("k", "scope")


def _examples(s, d):
    human = _human(s, d).withColumn("suspicious", F.substring("sample_id", 2, 20).cast("long") % 4 == 0)
    return ds.training_examples(human, _candidates(s, d), suspicious=False)


def _strong(s, d):
    m, e = _index(s, d)
    return gr.strong_surface(table(s, d, "nation").select(F.substring("n_name", 1, 4).alias("mention")), gr.surface_index(m, e), 50, 0.2)


def _zip(s, d):
    a = table(s, d, "orders").select("o_orderkey", "o_custkey")
    b = table(s, d, "customer").select("c_custkey", "c_name")
    return ev.zipped(a, b, F.col("o_orderkey"), F.col("c_custkey"))


QUERIES = {
    **{f"sparql_{k}": _instances(k) for k in SPARQL},
    "isomorphism": _isomorphic,
    "text_forms": _numbers,
    "kb_prominent": lambda s, d: kb.prominent_types(triples(s, d), table(s, d, "customer").select(F.concat(F.lit("m.c"), F.col("c_custkey")).alias("entity")), "trade.customer.nation").select("entity", F.concat_ws(",", "types").alias("types")),
    "kb_bound_scopes": _scopes,
    "mine_total": lambda s, d: _facts(s, d, total=300).select("fact_relation_family", "supporting_row_hash"),
    "fact_totals": lambda s, d: ds.fact_totals(_facts(s, d)),
    "fact_sample": lambda s, d: ds.fact_sample(_facts(s, d), graph=triples(s, d)),
    "review_totals": lambda s, d: ds.review_totals(_candidates(s, d)),
    "verify_totals": lambda s, d: ds.verify_totals(_verified(s, d)),
    "training_summary": lambda s, d: ds.training_summary(_examples(s, d)),
    "sample_totals": lambda s, d: ds.sample_totals(_candidates(s, d), by="topic_entity_mid"),
    "grounding_counters": lambda s, d: ev.grounding_counters(_grounded(s, d)),
    "grounding_failures": lambda s, d: ev.grounding_failures(_grounded(s, d)),
    "hit_rates": lambda s, d: ev.hit_rates(_instances("webqsp")(s, d)),
    "eval_zip": _zip,
    "beam_match": lambda s, d: ev.beam_match(table(s, d, "orders").select(F.concat(F.lit("(A [b"), F.col("o_custkey"), F.lit("])")).alias("label"), F.array(F.concat(F.lit("(A [b"), F.col("o_orderkey"), F.lit("])")), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("(A [b"), F.col("o_custkey"), F.lit("])"))).otherwise("x"), F.when(F.col("o_orderkey") % 5 == 0, "y").otherwise("z")).alias("predict"))),
    "strong_surface": _strong,
    "missing_entities": lambda s, d: gr.missing_entities(table(s, d, "orders").select(F.concat(F.lit("m.c"), F.col("o_custkey") * 2).alias("mid")), table(s, d, "customer").select(F.concat(F.lit("m.c"), F.col("c_custkey")).alias("mid"))),
    "dialogues_all": lambda s, d: tr.all_dialogues(table(s, d, "conversations")),
    "stream_take": lambda s, d: tr.take(table(s, d, "orders").select("o_orderkey", "o_custkey"), 50, F.desc("o_orderkey")),
    "stream_skip": lambda s, d: tr.skip(table(s, d, "orders").select("o_orderkey", "o_custkey"), 200, F.col("o_orderkey")),
}

_SUSPECT = "SELECT qid sid, 'Question: { ' || trim(question) || ' }' i, '(JOIN (R trade.order.lines) m.o' || substr(qid, 2) || ')' o, 'human' src, tt FROM hq WHERE CAST(substr(qid, 2) AS BIGINT) % 4 <> 0"
_PARTS = f"WITH {_BEAMS}, {TRIPLES_SQL}, p AS (SELECT sx, regexp_extract(sx, '[a-z_0-9]+(\\.[a-z_0-9]+){{2,3}}', 0) r, regexp_extract(sx, '[ (]([mg]\\.[^\\s()]+)', 1) m FROM b WHERE {_VALID} AND regexp_matches(sx, '[ (][mg]\\.')), "
_PARTS += "e AS (SELECT 'm.c' || c_custkey mid FROM customer UNION ALL SELECT 'm.o' || o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'm.n' || n_nationkey FROM nation), "
_PARTS += "g AS (SELECT r, m, r IN (SELECT p FROM t) AS rok, m IN (SELECT mid FROM e) AS eok FROM p)"

ORACLES = {
    "training_summary": f"""{_C}, {_sql_questions()}, e AS (SELECT qid sid, 'Question: {{ ' || trim(question) || ' }}' i, '(JOIN (R trade.order.lines) m.o' || substr(qid, 2) || ')' o, 0 r, 'human' src, {_type('question')} tt FROM q WHERE CAST(substr(qid, 2) AS BIGINT) % 4 <> 0
            UNION ALL SELECT sid, 'Question: {{ ' || trim(question) || ' }}', sx, 1, 'synthetic', tt FROM c),
        d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY i, o ORDER BY r, sid) = 1)
        SELECT 'total_examples' metric, '' AS "key", count(*) n FROM d UNION ALL SELECT 'with_metadata', '', count(src) FROM d UNION ALL SELECT 'by_source', src, count(*) FROM d GROUP BY src UNION ALL SELECT 'by_temporal_type', tt, count(*) FROM d GROUP BY tt""",
    "sample_totals": f"{_C} SELECT count(*) total_samples, count(DISTINCT question) unique_questions, count(DISTINCT sx) unique_expressions, count(*) FILTER (topic <> '') non_empty_topic_entities FROM c",
    **{f"sparql_{k}": _sql_instances(k) for k in SPARQL},
    "isomorphism": f"SELECT o_orderkey k, o_orderkey % {len(PAIRS)} IN ({', '.join(str(i) for i, p in enumerate(PAIRS) if p[2])}) AS same FROM orders",
    "text_forms": "SELECT o_orderkey k, o_orderkey % 7 IN (0, 1, 3, 4) AS number, 'part ' || o_custkey hint, o_orderkey % 2 = 0 unsupported, 'JOIN date_' || o_custkey || ' m.o1 WITH' short, 'abc/trade/order_kind/part_' || o_custkey clean FROM orders",
    "kb_prominent": "SELECT 'm.c' || c_custkey entity, 'm.n' || c_nationkey AS types FROM customer",
    "kb_bound_scopes": "SELECT l_orderkey k, 'trade.line.from (from=' || strftime(min(least(l_shipdate, o_orderdate)), '%Y-%m-%d') || ', to=' || strftime(min(greatest(l_shipdate, o_orderdate)), '%Y-%m-%d') || ')' AS scope FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "mine_total": f"{_G} SELECT fam fact_relation_family, h supporting_row_hash FROM f ORDER BY CASE fam WHEN 'order_part' THEN 1 WHEN 'order_supplier' THEN 2 ELSE 3 END, h LIMIT 300",
    "fact_totals": f"{_G} SELECT count(*) total_facts, count(*) FILTER (tl <> '' AND al <> '') with_labels, count(a) with_temporal_start, count(b) with_temporal_end, count(DISTINCT topic) unique_topics, count(DISTINCT ans) unique_answers FROM f",
    "fact_sample": f"{_G} SELECT fam || '-' || h fact_id, fam family, tl topic, al answer, a AS \"start\", b AS \"end\" FROM f ORDER BY 1 LIMIT 10",
    "review_totals": f"""{_C}, i AS (SELECT tt = 'unknown' OR regexp_matches(question, '\\bm\\.[A-Za-z0-9_]+\\b') OR (tt = 'during' AND NOT contains(upper(sx), 'TC')) OR (tt = 'during' AND NOT regexp_matches(question, '\\b\\d{{4}}(-\\d{{2}}-\\d{{2}})?\\b') AND NOT regexp_matches(sx, '\\b\\d{{4}}(-\\d{{2}}-\\d{{2}})?\\b'))
            OR (tt = 'last' AND NOT contains(upper(sx), 'ARGMAX')) OR (tt = 'first' AND NOT contains(upper(sx), 'ARGMIN')) bad FROM c)
        SELECT count(*) total_samples, count(*) FILTER (NOT bad) accepted_samples, count(*) FILTER (bad) rejected_samples, round(count(*) FILTER (NOT bad) / count(*), 4) acceptance_rate FROM i""",
    "verify_totals": f"{_VERIFIED} SELECT count(*) total_candidates, count(*) FILTER (verified) passed, count(*) FILTER (NOT verified) failed, round(100 * count(*) FILTER (verified) / count(*), 1) pass_rate FROM v",
    "grounding_counters": f"{_PARTS} SELECT count(*) total_valid, count(*) FILTER (rok) relations_exact, 0::BIGINT relations_fuzzy, count(*) FILTER (eok) entities_exact, count(*) FILTER (rok AND eok) both_grounded FROM g",
    "grounding_failures": f"{_PARTS} SELECT 'ent:' || m failure, count(*) n FROM g WHERE NOT eok GROUP BY m ORDER BY n DESC, failure LIMIT 15",
    "hit_rates": "SELECT round(avg((o_orderkey % 5 IN (0, 1, 4))::DOUBLE), 6) parsed FROM orders",
    "eval_zip": "WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 pos FROM orders), b AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 pos FROM customer) SELECT * FROM a JOIN b USING (pos)",
    "beam_match": "SELECT round(avg((o_orderkey % 3 = 0 OR o_orderkey = o_custkey)::DOUBLE), 6) exact, 1e0 skeleton FROM orders",
    "strong_surface": f"WITH {_IDX}, q AS (SELECT DISTINCT substr(n_name, 1, 4) mention FROM nation), r AS (SELECT mention, mid, score, CAST(row_number() OVER (PARTITION BY mention ORDER BY score DESC, mid) AS INT) AS \"rank\" FROM q JOIN ix ON lower(mention) = surface) SELECT * FROM r WHERE \"rank\" <= 50 AND (\"rank\" = 1 OR score >= 0.2)",
    "missing_entities": "SELECT DISTINCT 'm.c' || o_custkey * 2 mid FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)",
    "dialogues_all": "WITH g AS (SELECT conv_id, list(text ORDER BY turn, role, text) l FROM conversations GROUP BY conv_id), x AS (SELECT conv_id, l, unnest(range(1, len(l) // 2 + 1)) n FROM g) SELECT conv_id, CAST(n AS INT) n, array_to_string(l[1:2 * n - 2], chr(10)) history, l[2 * n - 1] prompt, l[2 * n] response FROM x",
    "stream_take": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 50",
    "stream_skip": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey OFFSET 200",
}
