"""Queries of the question dataset over the tables seen as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolattice.functions import text as fx
from chronolattice.operators import dataset as ds
from chronolattice.sources.kg import TRIPLES_SQL, row_facts, table, triples

ALL = ("simple", "during", "first", "last", "before", "after")
FAMILIES = ds.families(
    ds.Family("order_part", "trade.order.lines", "trade.line.part", "trade.line.from", "trade.line.to", templates=ALL, role="part"),
    ds.Family("order_supplier", "trade.order.lines", "trade.line.supplier", "trade.line.from", templates=("simple", "first", "last"), role="supplier"),
    ds.Family("account_event", "user.account.events", "user.event.kind", "user.event.from", "user.event.to", "literal", ("simple", "during"), ""),
)


def _facts(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return ds.mine_facts(triples(spark, sf_dir), FAMILIES, facts_of=row_facts(spark, sf_dir), **more)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.generate(_facts(spark, sf_dir, once=False), FAMILIES)


def _flat(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "question", "temporal_type", "temporal_signal", "topic_entity_mid", "s_expression", F.concat_ws(",", "answers").alias("answers"), F.concat_ws(",", "relation_ids").alias("relation_ids"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made from orders: (qid, question, signal)."""
    o = table(spark, sf_dir, "orders").withColumn("y", F.date_format("o_orderdate", "yyyy"))
    words = [F.concat(F.lit(a), F.col("o_custkey").cast("string"), F.lit(b), F.col("y"), F.lit(c)) for a, b, c in QUESTIONS]
    return o.select(F.concat(F.lit("q"), F.col("o_orderkey")).alias("qid"), F.get(F.array(*words), (F.col("o_orderkey") % len(QUESTIONS)).cast("int")).alias("question"), F.when(F.col("o_orderkey") % 5 == 0, "AFTER").otherwise("").alias("signal"))


QUESTIONS = (
    ("Who bought after customer ", " in ", "?"), ("What was the first order of customer ", " before ", "?"), ("When did customer ", " buy the latest part of ", "?"), ("Which orders did customer ", " watch, year ", "?"), ("Name customer ", " - no date at all - and ", " twice"),
    ("What is the earlier one for c", " since ", "?"), ("What year did customer ", " buy, until ", "?"), ("Most recent order of ", " at the time of ", "?"), ("Customer ", " - during the year ", "."), ("Customer ", " by ", "."), ("Order of ", "/", ""),
)


def _sql_questions() -> str:
    cases = " ".join(f"WHEN {i} THEN '{a}' || o_custkey || '{b}' || strftime(o_orderdate, '%Y') || '{c}'" for i, (a, b, c) in enumerate(QUESTIONS))
    return f"q AS (SELECT 'q' || o_orderkey qid, CASE o_orderkey % {len(QUESTIONS)} {cases} END question, CASE WHEN o_orderkey % 5 = 0 THEN 'AFTER' ELSE '' END signal FROM orders)"


def _infer(spark, sf_dir):
    q = questions(spark, sf_dir)
    return q.select("qid", fx.question_type(F.col("question")).alias("temporal_type"), fx.safe_signal(F.col("signal"), F.col("question")).alias("signal"), fx.is_temporal(F.col("question")).alias("temporal"))


def _signals(spark, sf_dir):
    s = fx.temporal_signals(F.col("question"))
    return questions(spark, sf_dir).select("qid", F.size(s).alias("n"), F.concat_ws("|", s).alias("found"))


def _verified(spark, sf_dir):
    return ds.verify_generated(_candidates(spark, sf_dir), triples(spark, sf_dir), FAMILIES, row_facts(spark, sf_dir))


def _human(spark, sf_dir):
    q = questions(spark, sf_dir)
    s = F.concat(F.lit("(JOIN (R trade.order.lines) m.o"), F.substring("qid", 2, 20), F.lit(")"))
    return q.select(F.col("qid").alias("sample_id"), "question", s.alias("s_expression"), F.lit("train").alias("split"), F.lit("human").alias("source"), fx.question_type(F.col("question")).alias("temporal_type"))


def _distribution(c: DataFrame) -> DataFrame:
    return ds.summary(c, temporal_type=F.col("temporal_type"), family=F.col("metadata.fact_relation_family"), template=F.col("metadata.template_id"), decade=fx.decade(fx.year_of(F.col("metadata.temporal_start"))))


def _dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.get(F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy", "yyyy-M", "yyyy-M-d", "yyyy-MM-dd")], F.concat(F.lit("ns:m.o"), F.col("o_orderkey")), F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy"), F.lit('"^^xsd:dateTime'))), (F.col("o_orderkey") % 6).cast("int"))
    return o.select(F.col("o_orderkey").alias("k"), raw.alias("raw")).select("k", fx.padded_date(F.col("raw")).alias("padded"), fx.answer_form(F.col("raw")).alias("form"), fx.is_date(F.col("raw")).alias("is_date"), fx.is_mid(F.col("raw")).alias("is_mid"), fx.decade(fx.year_of(F.col("raw"))).alias("decade"))


def _matches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_custkey").alias("c"))
    pred = F.array(F.concat(F.lit("m.c"), F.col("c")), F.substring("d", 1, 4), F.concat(F.lit(" Name "), F.col("k") % 7))
    gold = F.array(F.concat(F.lit("ns:m.c"), F.col("c") + F.col("k") % 3), F.concat((F.substring("d", 1, 4).cast("int") + F.col("k") % 2).cast("string"), F.lit("-06-01")), F.concat(F.lit("name "), F.col("k") % 5))
    return o.select("k", fx.answers_match(pred, gold).alias("same"))


QUERIES = {
    "mine_range": lambda s, d: _facts(s, d, only=("order_part",)).select("fact_id", "topic_mid", "answer_mid", "answer_label", "temporal_start", "temporal_end", "supporting_row_hash"),
    "mine_point": lambda s, d: _facts(s, d, only=("order_supplier",)).select("topic_mid", "answer_mid", "temporal_start", "temporal_end"),
    "mine_bounds_dedup": lambda s, d: _facts(s, d, only=("account_event",), low=1996, high=2024).select("topic_mid", "answer_mid", "temporal_start", "temporal_end"),
    "mine_capped": lambda s, d: _facts(s, d, cap=50).select("fact_relation_family", "supporting_row_hash"),
    "fact_summary": lambda s, d: ds.summary(_facts(s, d), family=F.col("fact_relation_family"), has_end=F.col("temporal_end").isNotNull()),
    "gen_candidates": lambda s, d: _flat(_candidates(s, d)),
    "infer_type": _infer,
    "signals": _signals,
    "date_forms": _dates,
    "verify_match": _matches,
    "verify_samples": lambda s, d: _verified(s, d).select("sample_id", "verified", "verification_error"),
    "verify_summary": lambda s, d: ds.summary(_verified(s, d), verified=F.col("verified"), reason=F.col("verification_error")),
    "dedup_keep_first": lambda s, d: ds.keep_first(questions(s, d), [F.lower(F.trim("question"))], F.col("qid")).select("qid"),
    "cap_family": lambda s, d: ds.cap_by(questions(s, d).withColumn("t", fx.question_type(F.col("question"))), "t", 20, ds.hashed(42, F.col("qid")), F.col("qid")).select("qid", "t"),
    "filter_chain": lambda s, d: ds.distribution_filter(_candidates(s, d), family=60, kind=80, bucket=100).select("sample_id"),
    "quality_reasons": lambda s, d: ds.review_summary(_candidates(s, d)),
    "validation_issues": lambda s, d: _candidates(s, d).select("sample_id", F.concat_ws("; ", ds.validation_issues()).alias("issues")),
    "export_dedup_cap": lambda s, d: ds.training_examples(_human(s, d), _candidates(s, d), most=100).select("sample_id", "input", "output"),
    "summaries": lambda s, d: _distribution(_candidates(s, d)),
    "relation_inventory": lambda s, d: ds.relation_inventory(_candidates(s, d)),
}

_FACTS = """
    lab AS (SELECT s mid, min(o) lab FROM t WHERE p = 'rdfs:label' AND l = 'en' GROUP BY s),
    f0 AS (SELECT DISTINCT 'order_part' fam, 'm.o' || l_orderkey topic, 'm.p' || l_partkey ans, strftime(least(l_shipdate, o_orderdate), '%Y-%m-%d') a, strftime(greatest(l_shipdate, o_orderdate), '%Y-%m-%d') b, 'trade.order.lines' via, 'trade.line.part' rel, 'trade.line.from' pt FROM li
           UNION SELECT DISTINCT 'order_supplier', 'm.o' || l_orderkey, 'm.s' || l_suppkey, strftime(least(l_shipdate, o_orderdate), '%Y-%m-%d'), NULL, 'trade.order.lines', 'trade.line.supplier', 'trade.line.from' FROM li
           UNION SELECT DISTINCT 'account_event', 'm.u' || user_id, event_type, strftime(ts, '%Y-%m-%d'), strftime(nxt, '%Y-%m-%d'), 'user.account.events', 'user.event.kind', 'user.event.from' FROM ev),
    f AS (SELECT *, substr(sha256(fam || '|' || topic || '|' || ans || '|' || a || '|' || coalesce(b, '')), 1, 12) h, coalesce((SELECT lab FROM lab WHERE mid = topic), topic) tl, coalesce((SELECT lab FROM lab WHERE mid = ans), ans) al FROM f0)"""
_BANK = ", ".join(f"('{f.family}', '{i}', '{t}', '{w}', '{b}', '{f.role or f.to_answer.split('.')[-2]}')" for f in FAMILIES for i, t, w, b in ds.TEMPLATES if t in f.templates)
_TYPE0 = "CASE " + " ".join(f"WHEN regexp_matches(lower(@x@), '{p}')" + (f" AND regexp_matches(lower(@x@), '{fx.YEAR}')" if dated else "") + f" THEN '{n}'" for n, p, dated in fx.TYPES) + " ELSE 'unknown' END"


def _type(x: str) -> str:
    return _TYPE0.replace("@x@", x)


_CANDS = f"""
    fc AS (SELECT *, fam || '-' || h fid FROM f),
    bank(fam, tid, tf, words, how, role) AS (VALUES {_BANK}),
    c0 AS (SELECT * FROM fc JOIN bank USING (fam) QUALIFY row_number() OVER (PARTITION BY fid ORDER BY sha256('42|' || fid || '|' || tid), tid) <= instr('0123456789abcdef', substr(sha256('42|' || fid), 1, 1)) % 3 + 1),
    c1 AS (SELECT *, replace(replace(replace(words, '{{role}}', role), '{{topic_label}}', tl), '{{year}}', substr(a, 1, 4)) question,
        CASE how WHEN 'join' THEN '(JOIN (R ' || rel || ') ' || topic || ')' WHEN 'tc' THEN '(TC (JOIN (R ' || rel || ') ' || topic || ') ' || pt || ' ' || a || ')' ELSE '(' || upper(how) || ' (JOIN (R ' || rel || ') ' || topic || ') ' || pt || ')' END sx FROM c0),
    c AS (SELECT *, 'candidate-' || fid || '-' || tid sid, {_type("question || ' ' || tf || ' ' || sx")} tt FROM c1 QUALIFY row_number() OVER (PARTITION BY question, sx ORDER BY fid, tid) = 1)"""
_G = f"WITH {TRIPLES_SQL}, {_FACTS}"
_C = f"{_G}, {_CANDS}"
_Q = f"WITH {_sql_questions()}"
#: What the graph answers to each candidate, by way of the facts themselves: all answers of its topic, or the open, the
#: earliest or the latest ones; and whether one of them is the candidate's.
_VERIFIED = f"""{_C},
    y AS (SELECT *, substr(b, 1, 4) yb FROM f),
    w AS (SELECT c.sid, c.how, c.ans, list(DISTINCT y.ans) FILTER (c.how <> 'tc' OR (substr(y.a, 1, 4) <= substr(c.a, 1, 4) AND (y.b2 IS NULL OR substr(y.b2, 1, 4) >= substr(c.a, 1, 4)))) alls,
            min_by(y.ans, struct_pack(x := y.a, z := y.ans)) lo, min(y.ans) FILTER (y.a = y.mx) hi
          FROM c JOIN (SELECT fam, topic, rel, ans, a, b2, max(a) OVER (PARTITION BY fam, topic) mx FROM x0) y ON c.fam = y.fam AND c.topic = y.topic GROUP BY ALL),
    v AS (SELECT sid sample_id, CASE how WHEN 'argmin' THEN lo = ans WHEN 'argmax' THEN hi = ans ELSE list_contains(alls, ans) END verified FROM w)"""
_VERIFIED = _VERIFIED.replace("    y AS (SELECT *, substr(b, 1, 4) yb FROM f),\n", """    x0 AS (SELECT 'order_part' fam, 'm.o' || l_orderkey topic, 'trade.line.part' rel, 'm.p' || l_partkey ans, strftime(least(l_shipdate, o_orderdate), '%Y-%m-%d') a, strftime(greatest(l_shipdate, o_orderdate), '%Y-%m-%d') b2 FROM li
           UNION ALL SELECT 'order_supplier', 'm.o' || l_orderkey, 'trade.line.supplier', 'm.s' || l_suppkey, strftime(least(l_shipdate, o_orderdate), '%Y-%m-%d'), strftime(greatest(l_shipdate, o_orderdate), '%Y-%m-%d') FROM li
           UNION ALL SELECT 'account_event', 'm.u' || user_id, 'user.event.kind', event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S'), strftime(nxt, '%Y-%m-%dT%H:%M:%S') FROM ev),
""")
_SIG = fx.SIGNALS[4:]

ORACLES = {
    "verify_samples": f"{_VERIFIED} SELECT sample_id, verified, CASE WHEN verified THEN '' ELSE 'answer_mismatch' END verification_error FROM v",
    "verify_summary": f"{_VERIFIED} SELECT 'verified' metric, CAST(verified AS VARCHAR) AS \"key\", count(*) n FROM v GROUP BY verified UNION ALL SELECT 'reason', CASE WHEN verified THEN '' ELSE 'answer_mismatch' END, count(*) FROM v GROUP BY verified",
    "mine_range": f"{_G} SELECT fam || '-' || h fact_id, topic topic_mid, ans answer_mid, al answer_label, a temporal_start, b temporal_end, h supporting_row_hash FROM f WHERE fam = 'order_part'",
    "mine_point": f"{_G} SELECT topic topic_mid, ans answer_mid, a temporal_start, b temporal_end FROM f WHERE fam = 'order_supplier'",
    "mine_bounds_dedup": f"{_G} SELECT topic topic_mid, ans answer_mid, a temporal_start, b temporal_end FROM f WHERE fam = 'account_event' AND CAST(substr(a, 1, 4) AS INT) BETWEEN 1996 AND 2024 AND (b IS NULL OR CAST(substr(b, 1, 4) AS INT) BETWEEN 1996 AND 2024)",
    "mine_capped": f"{_G} SELECT fam fact_relation_family, h supporting_row_hash FROM f QUALIFY row_number() OVER (PARTITION BY fam ORDER BY h) <= 50",
    "fact_summary": f"{_G} SELECT 'family' metric, fam AS \"key\", count(*) n FROM f GROUP BY fam UNION ALL SELECT 'has_end', CASE WHEN b IS NULL THEN 'false' ELSE 'true' END, count(*) FROM f GROUP BY b IS NULL",
    "gen_candidates": f"{_C} SELECT sid sample_id, question, tt temporal_type, tf temporal_signal, topic topic_entity_mid, sx s_expression, ans answers, via || ',' || rel || ',' || pt relation_ids FROM c",
    "infer_type": f"{_Q} SELECT qid, {_type('question')} temporal_type, CASE WHEN signal <> '' THEN lower(signal) WHEN contains(lower(question), 'before') THEN 'before' WHEN contains(lower(question), 'after') THEN 'after' WHEN contains(lower(question), 'first') OR contains(lower(question), 'earliest') THEN 'first' WHEN contains(lower(question), 'last') OR contains(lower(question), 'latest') THEN 'last' ELSE 'during' END signal, regexp_matches(question, '{fx.TEMPORAL}') temporal FROM q",
    "signals": f"{_Q}, z AS (SELECT qid, regexp_extract_all(question, '(?i){_SIG}', 0) f FROM q) SELECT qid, CAST(len(f) AS INT) n, array_to_string(f, '|') AS found FROM z",
    "date_forms": """WITH r AS (SELECT o_orderkey k, o_orderkey % 6 m, strftime(o_orderdate, '%Y') y, o_orderdate d FROM orders),
        v AS (SELECT *, CASE m WHEN 0 THEN y WHEN 1 THEN strftime(d, '%Y-%m') WHEN 4 THEN 'm.o' || k WHEN 5 THEN y ELSE strftime(d, '%Y-%m-%d') END padded FROM r)
        SELECT k, padded, CASE WHEN m = 1 THEN CASE WHEN month(d) > 9 THEN padded ELSE y || '-' || month(d) END WHEN m = 2 THEN CASE WHEN month(d) > 9 AND day(d) > 9 THEN padded ELSE y || '-' || month(d) || '-' || day(d) END ELSE padded END form,
               m IN (0, 3, 5) OR (m = 1 AND month(d) > 9) OR (m = 2 AND month(d) > 9 AND day(d) > 9) is_date, m = 4 is_mid, CASE WHEN m IN (4, 5) THEN 'unknown' ELSE CAST(year(d) // 10 * 10 AS VARCHAR) || 's' END AS "decade" FROM v""",
    "verify_match": "SELECT o_orderkey k, o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 OR o_orderkey % 7 = o_orderkey % 5 same FROM orders",
    "dedup_keep_first": f"{_Q} SELECT min(qid) qid FROM q GROUP BY lower(trim(question))",
    "cap_family": f"{_Q}, z AS (SELECT qid, {_type('question')} t FROM q) SELECT qid, t FROM z QUALIFY row_number() OVER (PARTITION BY t ORDER BY sha256('42|' || qid), qid) <= 20",
    "filter_chain": f"""{_C}, x0 AS (SELECT *, sha256('42|' || sid) z FROM c WHERE length(trim(question)) >= 10 QUALIFY row_number() OVER (PARTITION BY lower(trim(question)), trim(sx) ORDER BY sid) = 1),
        x1 AS (SELECT * FROM x0 QUALIFY row_number() OVER (PARTITION BY fam ORDER BY z, sid) <= 60), x2 AS (SELECT * FROM x1 QUALIFY row_number() OVER (PARTITION BY tt ORDER BY z, sid) <= 80)
        SELECT sid sample_id FROM x2 QUALIFY row_number() OVER (PARTITION BY substr(a, 1, 3) ORDER BY z, sid) <= 100""",
    "quality_reasons": f"""{_C}, i AS (SELECT sid, list_filter([
            CASE WHEN tt = 'unknown' THEN 'temporal_type is unknown' END, CASE WHEN regexp_matches(question, '\\bm\\.[A-Za-z0-9_]+\\b') THEN 'question still contains raw mids' END,
            CASE WHEN tt = 'during' AND NOT contains(upper(sx), 'TC') THEN 'during sample must use TC operator' END,
            CASE WHEN tt = 'during' AND NOT regexp_matches(question, '\\b\\d{{4}}(-\\d{{2}}(-\\d{{2}})?)?\\b') AND NOT regexp_matches(sx, '\\b\\d{{4}}(-\\d{{2}}(-\\d{{2}})?)?\\b') THEN 'during sample should include a temporal value' END,
            CASE WHEN tt = 'last' AND NOT contains(upper(sx), 'ARGMAX') THEN 'last sample must use ARGMAX' END, CASE WHEN tt = 'first' AND NOT contains(upper(sx), 'ARGMIN') THEN 'first sample must use ARGMIN' END], lambda x: x IS NOT NULL) r FROM c)
        SELECT 'status' metric, CASE WHEN len(r) = 0 THEN 'accepted' ELSE 'rejected' END AS "key", count(*) n FROM i GROUP BY len(r) = 0 UNION ALL (SELECT 'reason', u, count(*) FROM (SELECT unnest(r) u FROM i) GROUP BY u ORDER BY 3 DESC, 2 LIMIT 20)""",
    "validation_issues": f"{_C} SELECT sid sample_id, CASE WHEN tt = 'unknown' THEN 'sparql is required; temporal_type should be resolved before export' ELSE 'sparql is required' END issues FROM c",
    "export_dedup_cap": f"""{_C}, {_sql_questions()}, e AS (SELECT qid sid, 'Question: {{ ' || trim(question) || ' }}' i, '(JOIN (R trade.order.lines) m.o' || substr(qid, 2) || ')' o, 0 r FROM q UNION ALL SELECT sid, 'Question: {{ ' || trim(question) || ' }}', sx, 1 FROM c),
        d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY i, o ORDER BY r, sid) = 1) SELECT sid sample_id, i AS "input", o AS "output" FROM d QUALIFY r = 0 OR row_number() OVER (PARTITION BY r ORDER BY sid) <= 100""",
    "summaries": f"{_C} SELECT CASE grouping(tt) + 2 * grouping(fam) + 4 * grouping(tid) + 8 * grouping(dec) WHEN 14 THEN 'temporal_type' WHEN 13 THEN 'family' WHEN 11 THEN 'template' ELSE 'decade' END metric, coalesce(tt, fam, tid, dec) AS \"key\", count(*) n FROM (SELECT tt, fam, tid, substr(a, 1, 3) || '0s' dec FROM c) GROUP BY GROUPING SETS ((tt), (fam), (tid), (dec))",
    "relation_inventory": f"{_C} SELECT pt relation, count(*) n, 'from' hint FROM c GROUP BY pt",
}
