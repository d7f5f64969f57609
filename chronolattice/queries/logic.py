"""Queries of the logical-form algebra and of graph access, with DuckDB SQL written apart from the compiler."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolattice.operators import kb
from chronolattice.plans.compiler import Options, compile_expr
from chronolattice.sources.kg import TRIPLES_SQL, cvt_facts, triples

#: name: (expression, options, SQL over t)
FORMS: dict[str, tuple[str, Options, str]] = {
    "join_fwd": ("(JOIN geo.nation.region m.r1)", Options(), "SELECT DISTINCT s x FROM t WHERE p = 'geo.nation.region' AND o = 'm.r1'"),
    "join_rev": ("(JOIN (R trade.order.lines) m.o1)", Options(), "SELECT DISTINCT o x FROM t WHERE p = 'trade.order.lines' AND s = 'm.o1'"),
    "join_2hop": ("(JOIN trade.customer.nation (JOIN geo.nation.region m.r2))", Options(), "SELECT DISTINCT a.s x FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'trade.customer.nation' AND b.p = 'geo.nation.region' AND b.o = 'm.r2' AND a.s <> a.o"),
    "join_rev_sub": ("(JOIN (R trade.line.part) (JOIN (R trade.order.lines) m.o3))", Options(), "SELECT DISTINCT b.o x FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'trade.order.lines' AND a.s = 'm.o3' AND b.p = 'trade.line.part'"),
    "join_literal_prefix": ('(JOIN trade.order.date "1996-03"^^http://www.w3.org/2001/XMLSchema#dateTime)', Options(), "SELECT DISTINCT s x FROM t WHERE p = 'trade.order.date' AND starts_with(o, '1996-03')"),
    "join_literal_exact": ("(JOIN trade.part.size 7^^http://www.w3.org/2001/XMLSchema#integer)", Options(), "SELECT DISTINCT s x FROM t WHERE p = 'trade.part.size' AND o = '7'"),
    "join_literal_lang": ('(JOIN trade.customer.segment "BUILDING"@en)', Options(), "SELECT DISTINCT s x FROM t WHERE p = 'trade.customer.segment' AND starts_with(o, 'BUILDING') AND l = 'en'"),
    "join_class": ("(JOIN type.object.type trade.supplier)", Options(), "SELECT DISTINCT s x FROM t WHERE p = 'type.object.type' AND o = 'trade.supplier'"),
    "and_entity": ("(AND (JOIN trade.customer.nation m.n3) (JOIN trade.customer.segment \"BUILDING\"@en))", Options(), "SELECT s x FROM t WHERE p = 'trade.customer.nation' AND o = 'm.n3' INTERSECT SELECT s FROM t WHERE p = 'trade.customer.segment' AND starts_with(o, 'BUILDING')"),
    "and_class": ("(AND trade.order (JOIN trade.order.customer m.c7))", Options(), "SELECT DISTINCT s x FROM t WHERE p = 'trade.order.customer' AND o = 'm.c7'"),
    "count_distinct": ("(COUNT (JOIN trade.customer.nation (JOIN geo.nation.region m.r0)))", Options(), "SELECT count(DISTINCT a.s) x FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'trade.customer.nation' AND b.p = 'geo.nation.region' AND b.o = 'm.r0'"),
    "argmax": ("(ARGMAX (JOIN trade.order.customer m.c85) trade.order.date)", Options(), "SELECT a.s x FROM t a JOIN t b ON a.s = b.s WHERE a.p = 'trade.order.customer' AND a.o = 'm.c85' AND b.p = 'trade.order.date' ORDER BY b.o DESC, 1 LIMIT 1"),
    "argmin": ("(ARGMIN (JOIN trade.order.customer m.c85) trade.order.total)", Options(), "SELECT a.s x FROM t a JOIN t b ON a.s = b.s WHERE a.p = 'trade.order.customer' AND a.o = 'm.c85' AND b.p = 'trade.order.total' ORDER BY CAST(b.o AS DOUBLE), 1 LIMIT 1"),
    "argmax_reverse": ("(ARGMAX (JOIN geo.nation.region m.r1) (R trade.supplier.nation))", Options(), "SELECT a.s x FROM t a JOIN t b ON a.s = b.o WHERE a.p = 'geo.nation.region' AND a.o = 'm.r1' AND b.p = 'trade.supplier.nation' ORDER BY b.s DESC, 1 LIMIT 1"),
    "argmax_nhop": ("(ARGMAX (JOIN trade.order.customer m.c85) (JOIN trade.order.lines trade.line.to))", Options(), "SELECT a.s x FROM t a JOIN t b ON a.s = b.s JOIN t c ON b.o = c.s WHERE a.p = 'trade.order.customer' AND a.o = 'm.c85' AND b.p = 'trade.order.lines' AND c.p = 'trade.line.to' ORDER BY c.o DESC, 1 LIMIT 1"),
    "arg_class": ("(ARGMAX trade.supplier trade.supplier.balance)", Options(), "SELECT s x FROM t WHERE p = 'trade.supplier.balance' ORDER BY CAST(o AS DOUBLE) DESC, 1 LIMIT 1"),
    "arg_nested": ("(JOIN (R trade.order.lines) (ARGMIN (JOIN trade.order.customer m.c85) trade.order.date))", Options(), "SELECT DISTINCT c.o x FROM t c WHERE c.p = 'trade.order.lines' AND c.s = (SELECT a.s FROM t a JOIN t b ON a.s = b.s WHERE a.p = 'trade.order.customer' AND a.o = 'm.c85' AND b.p = 'trade.order.date' ORDER BY b.o, 1 LIMIT 1)"),
    "arg_global_limit": ("(JOIN (R trade.order.lines) (ARGMIN (JOIN trade.order.customer m.c85) trade.order.date))", Options(global_limit=True), "SELECT c.o x FROM t a JOIN t b ON a.s = b.s JOIN t c ON c.s = a.s WHERE a.p = 'trade.order.customer' AND a.o = 'm.c85' AND b.p = 'trade.order.date' AND c.p = 'trade.order.lines' ORDER BY b.o, 1 LIMIT 1"),
    "cmp_lt": ("(lt trade.part.size 5^^http://www.w3.org/2001/XMLSchema#integer)", Options(), "SELECT DISTINCT s x FROM t WHERE p = 'trade.part.size' AND CAST(o AS INT) < 5"),
    "cmp_le": ("(le trade.part.size 5^^http://www.w3.org/2001/XMLSchema#integer)", Options(), "SELECT DISTINCT s x FROM t WHERE p = 'trade.part.size' AND CAST(o AS INT) <= 5"),
    "cmp_gt": ('(gt trade.order.date "2001"^^http://www.w3.org/2001/XMLSchema#dateTime)', Options(), "SELECT DISTINCT s x FROM t WHERE p = 'trade.order.date' AND o > '2001-01-01'"),
    "cmp_ge": ("(AND (JOIN trade.customer.nation m.n5) (ge trade.customer.balance 5000))", Options(), "SELECT s x FROM t WHERE p = 'trade.customer.nation' AND o = 'm.n5' INTERSECT SELECT s FROM t WHERE p = 'trade.customer.balance' AND CAST(o AS DOUBLE) >= 5000"),
    "cmp_2hop": ("(AND (JOIN trade.order.customer m.c85) (lt (JOIN trade.order.lines trade.line.from) \"1998\"^^http://www.w3.org/2001/XMLSchema#dateTime))", Options(), "SELECT DISTINCT a.s x FROM t a JOIN t b ON a.s = b.s JOIN t c ON b.o = c.s WHERE a.p = 'trade.order.customer' AND a.o = 'm.c85' AND b.p = 'trade.order.lines' AND c.p = 'trade.line.from' AND c.o < '1998-01-01'"),
    "tc_year": ("(JOIN (R trade.line.part) (TC (JOIN (R trade.order.lines) (JOIN trade.order.customer m.c85)) trade.line.from 1998))", Options(), """SELECT DISTINCT d.o x FROM t a JOIN t b ON a.s = b.s JOIN t f ON f.s = b.o JOIN t g ON g.s = b.o JOIN t d ON d.s = b.o
        WHERE a.p = 'trade.order.customer' AND a.o = 'm.c85' AND b.p = 'trade.order.lines' AND f.p = 'trade.line.from' AND g.p = 'trade.line.to' AND d.p = 'trade.line.part' AND f.o <= '1998-12-31' AND g.o >= '1998-01-01'"""),
    "tc_exists_form": ("(JOIN (R trade.line.part) (TC (JOIN (R trade.order.lines) (JOIN trade.order.customer m.c85)) trade.line.from 1998))", Options(tc_form="exists"), """SELECT DISTINCT d.o x FROM t a JOIN t b ON a.s = b.s JOIN t d ON d.s = b.o
        WHERE a.p = 'trade.order.customer' AND a.o = 'm.c85' AND b.p = 'trade.order.lines' AND d.p = 'trade.line.part'
        AND (NOT EXISTS (SELECT 1 FROM t f WHERE f.s = b.o AND f.p = 'trade.line.from') OR EXISTS (SELECT 1 FROM t f WHERE f.s = b.o AND f.p = 'trade.line.from' AND f.o <= '1998-12-31'))
        AND (NOT EXISTS (SELECT 1 FROM t f WHERE f.s = b.o AND f.p = 'trade.line.to') OR EXISTS (SELECT 1 FROM t f WHERE f.s = b.o AND f.p = 'trade.line.to' AND f.o >= '1998-01-01'))"""),
    "tc_now": ("(TC (JOIN (R user.account.events) m.u1) user.event.from NOW)", Options(now="2024-01-15"), """SELECT DISTINCT a.o x FROM t a JOIN t f ON f.s = a.o LEFT JOIN t g ON g.s = a.o AND g.p = 'user.event.to'
        WHERE a.p = 'user.account.events' AND a.s = 'm.u1' AND f.p = 'user.event.from' AND f.o <= '2024-01-15' AND (g.o IS NULL OR g.o >= '2024-01-15')"""),
    "tc_open_end": ("(TC (JOIN (R user.account.events) m.u2) user.event.from 2030)", Options(), "SELECT DISTINCT a.o x FROM t a WHERE a.p = 'user.account.events' AND a.s = 'm.u2' AND NOT EXISTS (SELECT 1 FROM t g WHERE g.s = a.o AND g.p = 'user.event.to')"),
    "excl_default": ("(JOIN trade.customer.nation (JOIN (R trade.customer.nation) m.c12))", Options(), "SELECT DISTINCT b.s x FROM t a JOIN t b ON a.o = b.o WHERE a.p = 'trade.customer.nation' AND a.s = 'm.c12' AND b.p = 'trade.customer.nation' AND b.s <> 'm.c12'"),
    "excl_cwq": ("(JOIN trade.customer.nation (JOIN (R trade.customer.nation) m.c12))", Options(dialect="cwq"), "SELECT DISTINCT b.s x FROM t a JOIN t b ON a.o = b.o WHERE a.p = 'trade.customer.nation' AND a.s = 'm.c12' AND b.p = 'trade.customer.nation'"),
    "lang_filter": ("(JOIN (R rdfs:label) m.n1)", Options(), "SELECT DISTINCT o x FROM t WHERE p = 'rdfs:label' AND s = 'm.n1' AND (l IS NULL OR l LIKE 'en%')"),
}


def _form(text: str, options: Options):
    return lambda spark, sf_dir: compile_expr(triples(spark, sf_dir), text, options)


def _some(spark: SparkSession, *mids: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in mids], "entity string")


def _kb(f):
    return lambda spark, sf_dir: f(triples(spark, sf_dir), spark)


def _nations(graph: DataFrame) -> DataFrame:
    return graph.where("p = 'type.object.type' and o = 'geo.nation'").select(F.col("s").alias("entity"))


QUERIES = {k: _form(e, o) for k, (e, o, _) in FORMS.items()} | {
    "kb_types": _kb(lambda g, s: kb.types(g, _some(s, "m.c1", "m.n1", "m.r1"))),
    "kb_in": _kb(lambda g, s: kb.in_relations(g, _some(s, "m.c1", "m.n1", "m.p1"))),
    "kb_out": _kb(lambda g, s: kb.out_relations(g, _some(s, "m.c1", "m.n1", "m.p1"))),
    "kb_1hop": _kb(lambda g, s: kb.one_hop(g, _some(s, "m.o1", "m.n1"))),
    **{f"kb_2hop_{w}": _kb(lambda g, s, w=w: kb.two_hop(g, _some(s, "m.n1", "m.c4"), w)) for w in ("ii", "io", "oi", "oo")},
    "kb_2hop_light": _kb(lambda g, s: kb.two_hop(g, _some(s, "m.n1", "m.c4"), "oo", kb.NOISE_LIGHT)),
    "kb_2hop_batch": _kb(lambda g, s: kb.two_hop_batch(g, _some(s, "m.r1", "m.c4")).select("entity", F.concat_ws(",", "relations").alias("relations"))),
    "kb_label": _kb(lambda g, s: kb.labels(g, _some(s, "m.n1", "m.r1", "m.o1"))),
    "kb_key": _kb(lambda g, s: kb.by_key(g, "trade.customer.segment", s.createDataFrame([("BUILDING",), ("NONE",)], "key string"))),
    "kb_describe": _kb(lambda g, s: kb.describe(g, _nations(g), ["rdfs:label", "geo.nation.region", "type.object.type"])),
    "kb_freq": _kb(lambda g, s: kb.relation_frequency(g)),
    "kb_freq_prefix": _kb(lambda g, s: kb.relation_frequency(g, "trade.line")),
    "kb_scope": _kb(lambda g, s: kb.temporal_scope(g, g.where("p = 'user.account.events' and s = 'm.u1'").select(F.col("o").alias("entity")), "user.event")),
    "kb_temporal_rels": _kb(lambda g, s: kb.temporal_relations(g, _some(s, "m.o1", "g.e1", "m.c1"))),
    "kb_label_aliases": _kb(lambda g, s: kb.with_label_aliases(g, _nations(g))),
    "kb_cvt_facts": _kb(lambda g, s: cvt_facts(g, "user.account.events", "user.event.kind", "user.event.from", "user.event.to")),
}

_E = "e(entity) AS (VALUES {})"


def _with(sql: str, *mids: str) -> str:
    extra = ", " + _E.format(", ".join(f"('{m}')" for m in mids)) if mids else ""
    return f"WITH {TRIPLES_SQL}{extra} {sql}"


_QUIET = "regexp_matches('http://rdf.freebase.com/ns/' || {c}, '(?i)wikipedia|type\\.object|common\\.topic|_id|#type|#label|/ns/freebase|ns/common\\.|ns/type\\.|ns/kg\\.|ns/user\\.|ns/dataworld\\.{more}') = false"


def _hops(w: str, more: str = "", light: bool = False) -> str:
    n1, f1 = ("o", "s") if w[0] == "i" else ("s", "o")
    n2, f2 = ("o", "s") if w[1] == "i" else ("s", "o")
    m = [" || '#R'" if x == "o" else "" for x in w]
    quiet = " AND ".join(_QUIET.format(c=c, more=more) if not light else f"NOT regexp_matches('http://rdf.freebase.com/ns/' || {c}, '(?i)wikipedia|_id|#type|#label|/ns/freebase|ns/kg\\.|ns/dataworld\\.')" for c in ("a.p", "b.p"))
    back = f" AND b.{f2} <> e.entity" if w[0] != w[1] else ""
    return f"SELECT DISTINCT e.entity, a.p{m[0]} r0, b.p{m[1]} r1 FROM e JOIN t a ON a.{n1} = e.entity AND a.k = 'entity' JOIN t b ON b.{n2} = a.{f1} AND b.k = 'entity' WHERE {quiet}{back}"


ORACLES = {k: f"WITH {TRIPLES_SQL} {q}" for k, (_, _, q) in FORMS.items()} | {
    "kb_types": _with("SELECT DISTINCT s entity, o AS \"type\" FROM t JOIN e ON s = entity WHERE p = 'type.object.type'", "m.c1", "m.n1", "m.r1"),
    "kb_in": _with("SELECT DISTINCT o entity, p relation FROM t JOIN e ON o = entity", "m.c1", "m.n1", "m.p1"),
    "kb_out": _with("SELECT DISTINCT s entity, p relation FROM t JOIN e ON s = entity", "m.c1", "m.n1", "m.p1"),
    "kb_1hop": _with("SELECT o entity, p relation FROM t JOIN e ON o = entity UNION SELECT s, p FROM t JOIN e ON s = entity", "m.o1", "m.n1"),
    **{f"kb_2hop_{w}": _with(_hops(w), "m.n1", "m.c4") for w in ("ii", "io", "oi", "oo")},
    "kb_2hop_light": _with(_hops("oo", light=True), "m.n1", "m.c4"),
    "kb_2hop_batch": _with("SELECT entity, string_agg(r, ',' ORDER BY r) relations FROM (SELECT DISTINCT entity, replace(r, '#R', '') r FROM (SELECT entity, unnest([r0, r1]) r FROM (" + " UNION ALL ".join(_hops(a + b, "|ns/base\\.") for a in "io" for b in "io") + "))) GROUP BY entity", "m.r1", "m.c4"),
    "kb_label": _with("SELECT entity, (SELECT min(o) FROM t WHERE s = entity AND p = 'rdfs:label' AND l = 'en') AS \"label\" FROM e", "m.n1", "m.r1", "m.o1"),
    "kb_key": _with("SELECT entity AS \"key\", coalesce((SELECT min(s) FROM t WHERE p = 'trade.customer.segment' AND o = entity), '') AS entity FROM e", "BUILDING", "NONE"),
    "kb_describe": _with("SELECT 'm.n' || n_nationkey entity, n_name rdfs_label, 'm.r' || n_regionkey region, 'geo.nation' AS \"type\" FROM nation"),
    "kb_freq": _with("SELECT p relation, count(*) n FROM t GROUP BY p"),
    "kb_freq_prefix": _with("SELECT p relation, count(*) n FROM t WHERE starts_with(p, 'trade.line') GROUP BY p"),
    "kb_scope": _with("SELECT 'g.e' || event_id entity, strftime(ts, '%Y-%m-%dT%H:%M:%S') ts_from, strftime(nxt, '%Y-%m-%dT%H:%M:%S') ts_to FROM ev WHERE user_id = 1"),
    "kb_temporal_rels": _with("SELECT DISTINCT s entity, p relation FROM t JOIN e ON s = entity WHERE regexp_matches(p, '(?i)(date|time|from|to|start|end|year)')", "m.o1", "g.e1", "m.c1"),
    "kb_label_aliases": "SELECT 'm.n' || a.n_nationkey entity, 'm.n' || b.n_nationkey alias FROM nation a JOIN nation b USING (n_name)",
    "kb_cvt_facts": _with("SELECT 'm.u' || user_id topic, 'g.e' || event_id cvt, event_type answer, strftime(ts, '%Y-%m-%dT%H:%M:%S') ts_from, strftime(nxt, '%Y-%m-%dT%H:%M:%S') ts_to FROM ev"),
}
