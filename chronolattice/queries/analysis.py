"""Queries of evaluation, grounding, linking and data preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolattice.functions import text as fx
from chronolattice.operators import evaluate as ev
from chronolattice.operators import grounding as gr
from chronolattice.operators import training as tr
from chronolattice.plans import sexpr, sparql
from chronolattice.queries.dataset import _sql_questions, questions
from chronolattice.sources import formats
from chronolattice.sources.kg import TRIPLES_SQL, table, triples
from chronolattice.sources.storage import kept, shared_tables
from chronolattice.sources.surface_cache import cached_surface_index


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """A question a customer: predicted are its orders from 2000 on, gold its orders of status F."""
    o = table(spark, d, "orders").select("o_custkey", F.concat(F.lit(" M.O"), F.col("o_orderkey")).alias("m"), "o_orderstatus", F.year("o_orderdate").alias("y"), "o_orderkey")
    g = o.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("y") >= 2000, F.struct("o_orderkey", "m")))), lambda x: x["m"]).alias("pred"), F.collect_list(F.when(F.col("o_orderstatus") == "F", F.lower(F.trim("m")))).alias("gold"))
    return g.select(F.concat(F.lit("Orders of "), F.col("o_custkey"), F.when(F.col("o_custkey") % 3 == 0, " in 2001?").otherwise("?")).alias("question"), "pred", "gold")


_PAIRS = """o AS (SELECT o_custkey c, 'm.o' || o_orderkey m, o_orderkey k, o_orderstatus s, year(o_orderdate) y FROM orders),
    g AS (SELECT c, coalesce(list(m ORDER BY k) FILTER (y >= 2000), []) p, coalesce(list(m) FILTER (s = 'F'), []) g FROM o GROUP BY c),
    s AS (SELECT 'Orders of ' || c || CASE WHEN c % 3 = 0 THEN ' in 2001?' ELSE '?' END question, (c % 3 = 0 OR c BETWEEN 1000 AND 9999) temporal, len(p) > 0 answered,
          CASE WHEN len(p) + len(g) = 0 THEN 1e0 ELSE 2e0 * len(list_intersect(p, g)) / (len(p) + len(g)) END f1, CASE WHEN len(p) > 0 AND list_contains(g, p[1]) THEN 1e0 ELSE 0e0 END hits1, CASE WHEN list_sort(p) = list_sort(g) THEN 1e0 ELSE 0e0 END acc FROM g)"""

#: Expressions of every kind, some of them broken.
BEAMS = (
    "(JOIN (R trade.order.lines) m.o%s)", "(ARGMAX (JOIN trade.order.customer m.c%s) trade.order.date)", "(ARGMIN (JOIN trade.order.customer m.c%s) trade.order.date", "(TC (JOIN (R trade.order.lines) m.o%s) trade.line.from 1998)", "null", "(COUNT (JOIN trade.customer.nation m.n%s))",
    "(gt trade.part.size %s)", "(AND trade.order (JOIN trade.order.customer m.c%s))", "(FOO m.c%s)", "(ARGMAX (JOIN trade.order.customer m.c%s))",
)


def _beams(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    b = F.transform(F.array(*map(F.lit, BEAMS)), lambda t: F.replace(t, F.lit("%s"), F.col("o_custkey").cast("string")))
    k = (F.col("o_orderkey") % len(BEAMS)).cast("int")
    p = F.array(F.get(b, k), F.get(b, (k + 3) % len(BEAMS)), F.get(b, (k + 4) % len(BEAMS)))
    return ev.ranked(o.select(F.concat(F.lit("q"), F.col("o_orderkey")).alias("question"), p.alias("predictions")))


_BEAMS = "b AS (SELECT o_orderkey, i AS rank, j, replace(list_extract(l, j + 1), '%s', CAST(o_custkey AS VARCHAR)) sx FROM (SELECT o_orderkey, o_custkey, i, (o_orderkey % 10 + [0, 3, 4][i + 1]) % 10 AS j FROM orders, range(3) r(i)), (SELECT [" + ", ".join(f"'{b}'" for b in BEAMS) + "] l))"
#: The expressions of BEAMS that the language has.
_VALID = "j IN (0, 1, 3, 5, 6, 7)"


def _first(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("question"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).alias("rank"), F.array_compact(F.array(F.when(F.col("event_id") % 3 == 0, F.col("event_type")))).alias("answers"))
    return ev.first_executable(e).select("question", "rank", F.get("answers", F.lit(0)).alias("answer"))


def _relations(s, d):
    p = triples(s, d).select("p").distinct()
    # a list as long as the vocabulary, written once: numbers are places in it
    return kept(p.select(fx.slash_path(F.col("p")).alias("path"), F.dense_rank().over(Window.orderBy("p")).alias("rel")))


def _predicted(s, d, unlike="made.up.relation"):
    """A name of a relation for each order: known, in another form, misspelt, or made up."""
    names = [F.lit("trade.order.lines"), F.lit("/geo/nation/region"), F.lit("trade.order.line"), F.lit("trade.ordr.customer"), F.concat(F.lit(unlike), F.col("o_custkey")), F.lit("xx.yy.balance")]
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.get(F.array(*names), (F.col("o_orderkey") % len(names)).cast("int")).alias("relation"))


def _index(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("m.n"), F.col("n_nationkey")).alias("mid"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 10).alias("score"))
    r = table(s, d, "region").select(F.concat(F.lit("m.r"), F.col("r_regionkey")).alias("mid"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 50).alias("score"))
    e = n.unionByName(r)
    m = e.select(F.col("name").alias("surface"), "mid", F.lit(0.9).alias("score")).unionByName(e.select(F.substring("name", 1, 4).alias("surface"), "mid", F.round(F.col("score") / 100, 2).alias("score")))
    return m, e


def _tokens(s, d):
    """Tokens of a question a customer about its nation, with plain tags."""
    n = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = n.select(F.col("c_custkey").alias("qid"), F.split(F.concat(F.lit("who lived in "), F.col("n_name"), F.lit(" near "), F.substring("n_name", 1, 4), F.lit(" in 1998")), " ").alias("w"))
    tag = lambda w: F.when(w.isin("in", "near"), "IN").when(w.isin("who"), "WP").when(w.isin("lived"), "VBD").when(w.rlike(r"^\d+$"), "CD").otherwise("NNP")
    return n.select("qid", F.transform("w", lambda w: F.struct(w.alias("text"), F.lower(w).alias("lemma"), tag(w).alias("pos"))).alias("tokens"))


_IDX = """e AS (SELECT 'm.n' || n_nationkey mid, n_name AS name, n_nationkey + 10 pop FROM nation UNION ALL SELECT 'm.r' || r_regionkey, r_name, r_regionkey + 50 FROM region),
    m AS (SELECT lower(name) surface, mid, 0.9 score FROM e UNION ALL SELECT lower(substr(name, 1, 4)), mid, round(pop / 100, 2) FROM e),
    ix AS (SELECT surface, mid, max(score) score, any_value(name) AS name, any_value(pop) pop FROM m JOIN e USING (mid) GROUP BY surface, mid)"""


_SPANS = """wd AS (SELECT c_custkey qid, string_split('who lived in ' || n_name || ' near ' || substr(n_name, 1, 4) || ' in 1998', ' ') w FROM customer JOIN nation ON c_nationkey = n_nationkey),
    s1 AS (SELECT qid, w, CAST(unnest(range(0, len(w))) AS INT) s FROM wd), s2 AS (SELECT qid, w, s, CAST(unnest(range(s + 1, len(w) + 1)) AS INT) e FROM s1), sp AS (SELECT *, array_to_string(w[s + 1:e], ' ') span FROM s2)"""
#: Links: of single words those that are no part of a run of proper nouns, and all longer runs.
_LINK = f"""{_IDX}, {_SPANS}, pn AS (SELECT *, list_transform(w, lambda x: NOT list_contains(['who', 'lived', 'in', 'near', '1998'], x)) np FROM sp),
    k AS (SELECT qid, s, e, span, mid, score, pop, lower(name) = lower(span) perfect FROM pn JOIN ix ON lower(span) = surface WHERE score >= 0.3 AND (e - s > 1 OR (np[s + 1] AND NOT coalesce(s > 0 AND np[s], FALSE) AND NOT coalesce(np[e + 1], FALSE))))"""


def _linked(s, d):
    m, e = _index(s, d)
    return gr.link(_tokens(s, d), gr.surface_index(m, e))


def _surface(s, d):
    m, e = _index(s, d)
    return gr.top_surface(table(s, d, "nation").select(F.substring("n_name", 1, 4).alias("mention")), gr.surface_index(m, e), 3)


def _nearest(s, d):
    """Every vector whose id is divisible by 100, against all vectors."""
    v = table(s, d, "embeddings")
    labels = v.select(F.col("vec_id").cast("string").alias("label"), F.col("embedding").alias("vector"))
    return gr.nearest(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), labels, 3, 0.0).select("query", "label", "rank")


def _expand(s, d):
    n = table(s, d, "nation")
    c = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.col("n_name"), F.lit("x"), F.lit("y")), F.array(F.lit("p"), F.lit("q")))
    return gr.expand(n.select(F.col("n_nationkey").alias("qid"), c.alias("candidates")), 9).select("qid", "n", F.concat_ws("|", "choice").alias("choice"))


def _candidates(s, d):
    r = triples(s, d).select("p").distinct().select(F.lit("order of customer").alias("text"), F.lit(1).alias("slot"), F.col("p").alias("relation"))
    return gr.relation_candidates(r, 5).select("slot", "relation", "similarity", "rank")


def _retype(s, d):
    t = table(s, d, "part").select(F.concat(F.lit("m.p"), F.col("p_partkey")).alias("s"), F.lit("trade.part.size").alias("p"), F.col("p_size").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    t = t.unionByName(table(s, d, "part").select(F.concat(F.lit("m.p"), F.col("p_partkey")).alias("s"), F.lit("trade.part.brand").alias("p"), F.col("p_brand").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit("en").alias("o_lang")))
    return formats.retype(t, s.createDataFrame([("trade.part.size", "integer"), ("trade.part.brand", "float")], "p string, datatype string"))


def _pack(s, d):
    rows = table(s, d, "customer").select("c_custkey", F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 7).cast("int")), lambda i: F.col("c_custkey") * 10 + i).alias("ids"))
    return tr.pack(rows, 16, F.col("c_custkey")).select("block", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))


def _mix(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("src"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("src"))
    return a, b


def _truncate(s, d):
    l = table(s, d, "orders").select("o_orderkey", F.sequence(F.lit(1), (F.col("o_custkey") % 90 + 1).cast("int")).alias("source_ids"), F.sequence(F.lit(1), (F.col("o_orderkey") % 50 + 1).cast("int")).alias("target_ids"))  # noqa: E741
    return tr.truncate(l, 64).select("o_orderkey", F.size("source_ids").alias("a"), F.size("target_ids").alias("b"))


def _smooth(s, d):
    return tr.smoothed(table(s, d, "events"), "user_id", "event_id", "value")


def _distinct_beams(s, d):
    return ev.distinct_beams(table(s, d, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("text"), F.round("value", 4).alias("score")))


def _overlap(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("label"))
    p = table(s, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("predict"))
    return ev.text_overlap(c.join(p, ["conv_id", "turn"]).select("conv_id", "turn", "label", "predict")).drop("label", "predict")


#: SPARQL of the supported kinds, and the expressions they stand for.
ROUND_TRIPS = (
    ("SELECT DISTINCT ?x WHERE { ns:m.1 ns:a.b.c ?x . FILTER (?x != ns:m.1) }", "(JOIN (R a.b.c) m.1)"),
    ("SELECT DISTINCT ?x WHERE {\n?x ns:a.b.c ?y .\n?y ns:a.b.d ns:m.2 .\n}", "(JOIN a.b.c (JOIN a.b.d m.2))"),
    ("SELECT ?x WHERE { ns:m.1 ns:a.b.c ?x . ?x ns:a.b.date ?d . } ORDER BY DESC(xsd:datetime(?d)) LIMIT 5", "(ARGMAX (JOIN (R a.b.c) m.1) a.b.date)"),
    ("SELECT ?x WHERE { ns:m.1 ns:a.b.c ?x . ?x ns:a.b.date ?d . } ORDER BY ?d LIMIT 1 OFFSET 2", "(ARGMIN (JOIN (R a.b.c) m.1) a.b.date)"),
    ('SELECT DISTINCT ?x WHERE { ?x ns:a.b.c ns:m.3 . ?x ns:a.b.n ?num . FILTER (?num > "1950"^^xsd:dateTime) }', '(AND (JOIN a.b.c m.3) (gt a.b.n "1950"^^http://www.w3.org/2001/XMLSchema#dateTime))'),
)


def _sparql(s, d):
    """SPARQL and the expression that it stands for, of an order's number each."""
    k, n = (F.col("o_orderkey") % len(ROUND_TRIPS)).cast("int"), F.concat(F.lit("m.o"), F.col("o_orderkey"))
    pick = lambda i: F.replace(F.get(F.array(*[F.lit(p[i]) for p in ROUND_TRIPS]), k), F.lit("m.1"), n)
    rows = table(s, d, "orders").select(pick(0).alias("sparql"), pick(1).alias("want"))
    return sparql.converted(rows).select("want", "s_expression", "ok").withColumn("same", F.col("want") == F.col("s_expression"))


def _surface_cached(s, d):
    """The same mentions as ``topk_surface``, by an index that is built, and then read as it was left."""
    folder, (m, e) = shared_tables(s) + "/surface", _index(s, d)
    cached_surface_index(folder, m, e)
    index, built = cached_surface_index(folder, m, e)
    found = gr.top_surface(table(s, d, "nation").select(F.substring("n_name", 1, 4).alias("mention")), index, 3)
    return found.withColumn("built", F.lit(built))


QUERIES = {
    "eval_f1": lambda s, d: ev.scored(_pairs(s, d)).select("question", F.round("f1", 6).alias("f1"), "hits1", "acc"),
    "eval_metrics": lambda s, d: ev.answer_metrics(_pairs(s, d)),
    "eval_rates": lambda s, d: ev.executable_rates(ev.scored(_pairs(s, d)), "answered", "temporal"),
    "op_distribution": lambda s, d: ev.operators(_beams(s, d)),
    "validity": lambda s, d: ev.validity(_beams(s, d)),
    "sexpr_parts": lambda s, d: _beams(s, d).select("question", "rank", F.concat_ws(",", F.sort_array(fx.sexpr_entities(F.col("sexpr")))).alias("entities"), F.concat_ws(",", F.sort_array(fx.sexpr_relations(F.col("sexpr")))).alias("relations")),
    "first_executable": _first,
    "ground_exact": lambda s, d: gr.ground_exact(_predicted(s, d), _relations(s, d)).select("k", "relation", "rel"),
    "ground_fuzzy": lambda s, d: gr.ground_fuzzy(_predicted(s, d, "kkk.jjj.xxx"), _relations(s, d)),
    "ground_entity": lambda s, d: gr.ground_entities(table(s, d, "nation").select(F.concat(F.lit("m.n"), F.col("n_nationkey")).alias("mid")), table(s, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("m.n"), F.col("n_nationkey"))).otherwise(F.concat(F.lit("/m/n"), F.col("n_nationkey"))).alias("mid"), F.col("n_nationkey").alias("id"))),
    "answer_index": lambda s, d: gr.answer_index(table(s, d, "orders").select(F.col("o_custkey").alias("head"), F.lit(1).alias("rel"), F.col("o_orderkey").alias("tail")), table(s, d, "customer").select(F.col("c_custkey").alias("head"), F.lit(1).alias("rel")), table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("m.o"), F.col("o_orderkey")).alias("mid"))).select("head", "rel", F.concat_ws(",", "answers").alias("answers")),
    "topk_surface": _surface,
    "spans": lambda s, d: gr.spans(_tokens(s, d)).select("qid", "start", "end", "span"),
    "link": lambda s, d: _linked(s, d),
    "link_pruned": lambda s, d: gr.prune(gr.drop_subsumed(_linked(s, d)), 2).select("qid", "start", "end", "mid", "rank"),
    "link_by_length": lambda s, d: gr.by_length(_linked(s, d)).select("qid", "start", "end", "mid", "place"),
    "link_dates": lambda s, d: gr.date_mentions(_tokens(s, d)),
    "nonoverlap_sets": lambda s, d: gr.maximal_sets(_linked(s, d)),
    "cosine_nearest": _nearest,
    "expand_product": _expand,
    "relation_candidates": _candidates,
    "retype_literals": _retype,
    "mix_concat": lambda s, d: _mix(s, d)[0].unionByName(_mix(s, d)[1]),
    "mix_interleave": lambda s, d: tr.interleave(*_mix(s, d), F.col("k")),
    "pack_tokens": _pack,
    "truncate_pairs": _truncate,
    "dialogues": lambda s, d: tr.dialogues(table(s, d, "conversations")),
    "train_val_split": lambda s, d: tr.split(table(s, d, "orders").select("o_orderkey"), F.col("o_orderkey"), 0.1),
    "beam_dedup": _distinct_beams,
    "ema": _smooth,
    "preference_accuracy": lambda s, d: tr.preference_accuracy(table(s, d, "lineitem"), "l_discount", "l_tax"),
    "rouge_like": _overlap,
    "sparql_roundtrip": _sparql,
    "surface_cached": _surface_cached,
    "question_signals_join": lambda s, d: ev.first_by_question(questions(s, d), F.col("qid")).select("qid", "q"),
}

_OP = "CASE WHEN sx IS NULL OR sx = '' OR lower(sx) = 'null' THEN 'INVALID' WHEN contains(sx, '(ARGMAX') THEN 'ARGMAX' WHEN contains(sx, '(ARGMIN') THEN 'ARGMIN' WHEN contains(sx, '(TC') THEN 'TC' WHEN contains(sx, '(JOIN') THEN 'JOIN' WHEN regexp_matches(sx, '^\\((gt|ge|lt|le) ') THEN 'COMPARISON' ELSE 'OTHER' END"

ORACLES = {
    "eval_f1": f"WITH {_PAIRS} SELECT question, round(f1, 6) f1, hits1, acc FROM s",
    "eval_metrics": f"WITH {_PAIRS}, x AS (SELECT *, 'all' subset FROM s UNION ALL SELECT *, 'answered' FROM s WHERE answered UNION ALL SELECT *, 'temporal' FROM s WHERE temporal) SELECT subset, count(*) n, count(*) FILTER (answered) answered, round(avg(f1), 6) f1, round(avg(hits1), 6) hits1, round(avg(acc), 6) acc FROM x GROUP BY subset",
    "eval_rates": f"WITH {_PAIRS} SELECT round(avg(answered::DOUBLE), 6) answered, round(avg(temporal::DOUBLE), 6) temporal FROM s",
    "op_distribution": f"WITH {_BEAMS} SELECT 'operator' metric, {_OP} AS \"key\", count(*) n FROM b GROUP BY 2",
    "first_executable": "WITH r AS (SELECT CAST(user_id AS VARCHAR) question, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INT) AS \"rank\", event_type, event_id FROM events) SELECT question, min(\"rank\") AS \"rank\", arg_min(event_type, \"rank\") answer FROM r WHERE event_id % 3 = 0 GROUP BY question",
    # ratios of 17 of 18, 20 of 21, and 10 of 14 and 23 characters; the made-up names share three signs with any
    "ground_fuzzy": f"""WITH {TRIPLES_SQL}, r AS (SELECT p, dense_rank() OVER (ORDER BY p) rel FROM (SELECT DISTINCT p FROM t)),
        f(i, relation, p, score, how) AS (VALUES (0, 'trade.order.lines', 'trade.order.lines', 1.0::DOUBLE, 'exact'), (1, '/geo/nation/region', 'geo.nation.region', 1.0, 'exact'), (2, 'trade.order.line', 'trade.order.lines', 34 / 35, 'fuzzy'), (3, 'trade.ordr.customer', 'trade.order.customer', 40 / 41, 'fuzzy'), (5, 'xx.yy.balance', 'trade.supplier.balance', 20 / 37, 'suffix'))
        SELECT coalesce(f.relation, 'kkk.jjj.xxx' || o_custkey) relation, rel, '/' || replace(f.p, '.', '/') path, score, coalesce(how, 'none') how FROM orders LEFT JOIN f ON i = o_orderkey % 6 LEFT JOIN r ON r.p = f.p""",
    "ground_exact": f"WITH {TRIPLES_SQL}, r AS (SELECT p, dense_rank() OVER (ORDER BY p) rel FROM (SELECT DISTINCT p FROM t)), q AS (SELECT o_orderkey k, ['trade.order.lines', '/geo/nation/region', 'trade.order.line', 'trade.ordr.customer', 'made.up.relation' || o_custkey, 'xx.yy.balance'][o_orderkey % 6 + 1] relation FROM orders) SELECT k, relation, CAST(rel AS INT) rel FROM q LEFT JOIN r ON '/' || replace(p, '.', '/') = CASE WHEN starts_with(relation, '/') THEN relation ELSE '/' || replace(relation, '.', '/') END",
    "ground_entity": "SELECT 'm.n' || n_nationkey mid, n_nationkey id FROM nation",
    "answer_index": "SELECT o_custkey head, 1 rel, string_agg('m.o' || o_orderkey, ',' ORDER BY 'm.o' || o_orderkey) answers FROM orders GROUP BY o_custkey",
    "surface_cached": f"WITH {_IDX}, q AS (SELECT DISTINCT substr(n_name, 1, 4) mention FROM nation) SELECT mention, mid, score, false built, CAST(row_number() OVER (PARTITION BY mention ORDER BY score DESC, mid) AS INT) AS \"rank\" FROM q JOIN ix ON lower(mention) = surface QUALIFY \"rank\" <= 3",
    "sparql_roundtrip": "WITH w AS (SELECT replace(list_extract([" + ", ".join("'" + p[1].replace("'", "''") + "'" for p in ROUND_TRIPS) + f"], CAST(o_orderkey % {len(ROUND_TRIPS)} + 1 AS INT)), 'm.1', 'm.o' || o_orderkey) want FROM orders) SELECT want, want s_expression, true ok, true same FROM w",
    "topk_surface": f"WITH {_IDX}, q AS (SELECT DISTINCT substr(n_name, 1, 4) mention FROM nation) SELECT mention, mid, score, CAST(row_number() OVER (PARTITION BY mention ORDER BY score DESC, mid) AS INT) AS \"rank\" FROM q JOIN ix ON lower(mention) = surface QUALIFY \"rank\" <= 3",
    "link_dates": "SELECT c_custkey qid, 5 + len(string_split(n_name, ' ')) + len(string_split(substr(n_name, 1, 4), ' ')) AS \"at\", '1998' AS \"year\" FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "link": f"WITH {_LINK} SELECT qid, s AS \"start\", e AS \"end\", span, mid, score surface_score, perfect, CAST(pop * CASE WHEN perfect THEN 60 ELSE 1 END AS DOUBLE) score FROM k",
    "link_pruned": f"WITH {_LINK}, z AS (SELECT *, pop * CASE WHEN perfect THEN 60 ELSE 1 END w FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE a.qid = b.qid AND a.mid = b.mid AND b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s AND b.score >= a.score)) SELECT qid, s AS \"start\", e AS \"end\", mid, CAST(row_number() OVER (PARTITION BY qid, s, e ORDER BY w DESC, score DESC, mid) AS INT) AS \"rank\" FROM z QUALIFY \"rank\" <= 2",
    "link_by_length": f"WITH {_LINK} SELECT qid, s AS \"start\", e AS \"end\", mid, CAST(row_number() OVER (PARTITION BY qid ORDER BY length(span) DESC, score DESC, s, mid) AS INT) place FROM k",
    "nonoverlap_sets": f"""WITH RECURSIVE {_LINK}, u AS (SELECT DISTINCT qid, s, e FROM k),
        r(qid, txt, pos) AS (SELECT DISTINCT qid, '', -1 FROM u UNION ALL SELECT r.qid, r.txt || CASE WHEN r.txt = '' THEN '' ELSE ' ' END || u.s || '-' || u.e, u.e FROM r JOIN u ON u.qid = r.qid AND u.s >= r.pos WHERE u.s < (SELECT min(x.e) FROM u x WHERE x.qid = r.qid AND x.s >= r.pos))
        SELECT qid, txt AS spans FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.qid = r.qid AND u.s >= r.pos)""",
    "validity": f"WITH {_BEAMS} SELECT 'validity' metric, CASE WHEN {_VALID} THEN 'valid' ELSE 'invalid' END AS \"key\", count(*) n FROM b GROUP BY 2 UNION ALL SELECT 'operator', {_OP}, count(*) n FROM b GROUP BY 2",
    "sexpr_parts": f"WITH {_BEAMS}, x AS (SELECT 'q' || o_orderkey question, CAST(rank AS INT) AS \"rank\", list_distinct(regexp_extract_all(sx, '[^\\s()]+')) w FROM b) SELECT question, \"rank\", array_to_string(list_sort(list_filter(w, lambda t: regexp_matches(t, '^[mg]\\.'))), ',') entities, array_to_string(list_sort(list_filter(w, lambda t: regexp_matches(t, '^[a-z_0-9]+(\\.[a-z_0-9]+){{2,3}}$'))), ',') relations FROM x",
    "ema": "WITH x AS (SELECT user_id, event_id, value v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) t, count(*) OVER (PARTITION BY user_id) n FROM events), y AS (SELECT *, 1.8 * (1 / (1 + exp(-0.05 * n)) - 0.5) w FROM x) SELECT a.user_id, a.event_id, round(sum((1 - a.w) * pow(a.w, a.t - b.t) * b.v) + max(CASE WHEN b.t = 1 THEN pow(a.w, a.t) * b.v END), 6) smoothed FROM y a JOIN y b ON a.user_id = b.user_id AND b.t <= a.t GROUP BY 1, 2",
    "cosine_nearest": "WITH x AS (SELECT a.vec_id query, CAST(b.vec_id AS VARCHAR) lab, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) s FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0), y AS (SELECT query, lab, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, lab) AS INT) r FROM x WHERE s > 0) SELECT query, lab AS \"label\", r AS \"rank\" FROM y WHERE r <= 3",
    "expand_product": "SELECT n_nationkey qid, n, ['a', 'b'][n // 6 + 1] || '|' || [n_name, 'x', 'y'][n // 2 % 3 + 1] || '|' || ['p', 'q'][n % 2 + 1] choice FROM nation, range(9) r(n)",
    "retype_literals": "SELECT 'm.p' || p_partkey s, 'trade.part.size' p, CAST(p_size AS VARCHAR) o, 'literal' o_kind, 'integer' o_datatype, NULL o_lang FROM part UNION ALL SELECT 'm.p' || p_partkey, 'trade.part.brand', p_brand, 'literal', NULL, 'en' FROM part",
    "mix_concat": "SELECT c_custkey k, 'customer' src FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier",
    "mix_interleave": "WITH a AS (SELECT c_custkey k, 'customer' src, row_number() OVER (ORDER BY c_custkey) * 2 - 2 turn FROM customer), b AS (SELECT s_suppkey k, 'supplier' src, row_number() OVER (ORDER BY s_suppkey) * 2 - 1 turn FROM supplier) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE turn < 2 * least((SELECT count(*) FROM a), (SELECT count(*) FROM b))",
    "pack_tokens": "WITH x AS (SELECT c_custkey c, unnest(range(0, c_custkey % 7 + 1)) i FROM customer), y AS (SELECT c * 10 + i v, row_number() OVER (ORDER BY c, i) - 1 a FROM x) SELECT a // 16 AS block, string_agg(v, ',' ORDER BY a) ids FROM y GROUP BY 1 HAVING count(*) = 16",
    "truncate_pairs": "WITH x AS (SELECT o_orderkey, o_custkey % 90 + 1 p, o_orderkey % 50 + 1 q FROM orders) SELECT o_orderkey, CAST(CASE WHEN p + q <= 64 THEN p ELSE 64 * p // (p + q) END AS INT) a, CAST(CASE WHEN p + q <= 64 THEN q ELSE 64 * q // (p + q) END AS INT) b FROM x",
    "dialogues": "WITH g AS (SELECT conv_id, list(text ORDER BY turn, role, text) l FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(l[1:len(l) - 2], chr(10)) history, l[len(l) - 1] prompt, l[len(l)] response FROM g WHERE len(l) >= 2",
    "beam_dedup": "SELECT user_id question, event_type AS text, max(round(value, 4)) score FROM events GROUP BY user_id, event_type",
    "train_val_split": "SELECT o_orderkey, CASE WHEN CAST('0x' || substr(sha256('42|' || o_orderkey), 1, 8) AS BIGINT) < 429496729 THEN 'val' ELSE 'train' END part FROM orders",
    "spans": f"WITH {_SPANS} SELECT qid, s AS \"start\", e AS \"end\", span FROM sp",
    "relation_candidates": f"WITH {TRIPLES_SQL}, r AS (SELECT DISTINCT p, list_distinct(regexp_split_to_array(lower(p), '[._ ]+')) w FROM t), z AS (SELECT p, round(len(list_intersect(w, ['order', 'of', 'customer'])) / len(list_distinct(list_concat(w, ['order', 'of', 'customer']))), 6) s FROM r) SELECT 1 slot, p relation, s similarity, CAST(row_number() OVER (ORDER BY s DESC, p) AS INT) AS \"rank\" FROM z WHERE s > 0.01 QUALIFY \"rank\" <= 5",
    "preference_accuracy": "SELECT round(avg((l_discount > l_tax)::DOUBLE), 6) accuracy FROM lineitem",
    "question_signals_join": f"WITH {_sql_questions()} SELECT min(qid) qid, lower(trim(question)) q FROM q GROUP BY 2",
}
