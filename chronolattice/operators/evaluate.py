"""Evaluation of predicted expressions and answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolattice.functions import text as fx
from chronolattice.operators.grounding import ground_entities, ground_fuzzy
from chronolattice.plans import batch, sexpr
from chronolattice.plans.compiler import Options
from chronolattice.sources.storage import placed


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(question, predictions) from lines of JSON, a JSON list, or a JSON object keyed by id: told by the first sign."""
    head = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
    first = head[0].value.strip() if head else ""
    schema = "question string, predictions array<string>"
    if first.startswith("["):
        return spark.read.schema(schema).json(path, multiLine=True)
    try:
        keyed = not {"question", "predictions", "predict"} & set(json.loads(first))
    except ValueError:
        keyed = first.startswith("{")
    if keyed:
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", f"map<string, struct<{schema.replace(' string', ': string').replace(' array', ': array')}>>")).alias("id", "r")).select("r.*")
    return spark.read.schema(schema).json(path)


def ranked(predictions: DataFrame, top: int | None = None) -> DataFrame:
    """(question, rank, sexpr): beams in order, the first ``top`` of each question."""
    p = F.slice("predictions", 1, top) if top else F.col("predictions")
    return predictions.select("question", F.posexplode(p).alias("rank", "sexpr"))


def valid_expressions(s: Column) -> Column:
    """Whether texts are expressions of the language: parsed, in batches."""

    @F.pandas_udf("boolean")
    def check(x: pd.Series) -> pd.Series:
        return x.map(sexpr.valid)

    return check(s)


def validity(beams: DataFrame) -> DataFrame:
    """(metric, key, n): valid and invalid beams, and beams by operator."""
    b = beams.withColumn("valid", valid_expressions(F.col("sexpr"))).withColumn("op", fx.main_operator(F.col("sexpr")))
    v = b.groupBy(F.when(F.col("valid"), "valid").otherwise("invalid").alias("key")).agg(F.count("*").alias("n")).select(F.lit("validity").alias("metric"), "key", "n")
    return v.unionByName(operators(beams))


def operators(beams: DataFrame) -> DataFrame:
    return beams.groupBy(fx.main_operator(F.col("sexpr")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("operator").alias("metric"), "key", "n")


def first_by_question(gold: DataFrame, pos: Column) -> DataFrame:
    """Gold answers by normalised question; the first of repeated ones wins."""
    g = gold.withColumn("q", F.lower(F.trim("question")))
    return g.withColumn("__n", F.row_number().over(Window.partitionBy("q").orderBy(pos))).where("__n = 1").drop("__n")


def first_executable(beams: DataFrame) -> DataFrame:
    """(question, rank, answers): each question's first beam with answers."""
    got = beams.where(F.size("answers") > 0).groupBy("question").agg(F.min_by(F.struct("rank", "answers"), "rank").alias("b"))
    return got.select("question", "b.rank", "b.answers")


def scored(pairs: DataFrame) -> DataFrame:
    """Rows (question, pred, gold) with f1, hits1, acc, answered and temporal."""
    p, g = F.col("pred"), F.col("gold")
    return pairs.withColumns({"f1": fx.f1(p, g), "hits1": fx.hits_at_1(p, g), "acc": fx.accuracy(p, g), "answered": F.size(p) > 0, "temporal": fx.is_temporal(F.col("question"))})


def answer_metrics(pairs: DataFrame) -> DataFrame:
    """(subset, n, answered, f1, hits1, acc), over all, answered and temporal questions."""
    s = scored(pairs)
    each = s.select("*", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("answered"), "answered"), F.when(F.col("temporal"), "temporal")))).alias("subset"))
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return each.groupBy("subset").agg(F.count("*").alias("n"), F.count_if("answered").alias("answered"), mean("f1"), mean("hits1"), mean("acc"))


def executable_rates(flags: DataFrame, *columns: str) -> DataFrame:
    """The share of rows with each flag."""
    return flags.agg(*[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in columns])


def beam_match(beams: DataFrame) -> DataFrame:
    """(exact, skeleton): shares of questions whose label some beam equals, exactly or but for what stands in brackets."""
    blank = lambda c: F.regexp_replace(c, r"\[.*?\]", "[]")
    exact = F.exists("predict", lambda p: p == F.col("label"))
    loose = F.exists("predict", lambda p: blank(p) == blank(F.col("label")))
    return beams.agg(F.round(F.avg(exact.cast("double")), 6).alias("exact"), F.round(F.avg(loose.cast("double")), 6).alias("skeleton"))


def distinct_beams(beams: DataFrame) -> DataFrame:
    """(question, text, score): each text once a question, with its best score."""
    return beams.groupBy("question", "text").agg(F.max("score").alias("score"))


def report(metrics: DataFrame, title: str) -> str:
    """A Markdown table of a small aggregate."""
    rows = metrics.collect()
    lines = [f"# {title}", "", "| " + " | ".join(metrics.columns) + " |", "|" + "-|" * len(metrics.columns)]
    return "\n".join(lines + ["| " + " | ".join("N/A" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def text_overlap(pairs: DataFrame, label: str = "label", predict: str = "predict") -> DataFrame:
    """Rows with rouge1, rouge2, rougel (f) and bleu4 (add-one smoothed), in percent, over word tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter
        from math import exp, log

        def grams(w: list[str], n: int) -> Counter:
            return Counter(zip(*[w[i:] for i in range(n)], strict=False))

        def f(hit: int, a: int, b: int) -> float:
            return 200.0 * hit / (a + b) if a + b else 0.0

        def lcs(a: list[str], b: list[str]) -> int:
            row = [0] * (len(b) + 1)
            for x in a:
                last = 0
                for j, y in enumerate(b, 1):
                    last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
            return row[-1]

        for b in batches:
            out = []
            for want, got in zip(b[label].fillna(""), b[predict].fillna(""), strict=True):
                w, g = want.split(), got.split()
                ns = [sum((grams(w, n) & grams(g, n)).values()) for n in range(1, 5)]
                size = lambda x, n: max(0, len(x) - n + 1)
                bleu = 0.0
                if g and w:
                    bleu = 100 * exp(sum(log((ns[n - 1] + (n > 1)) / max(1, size(g, n) + (n > 1)) or 1e-9) for n in range(1, 5)) / 4) * min(1.0, exp(1 - len(w) / len(g)))
                out.append((f(ns[0], len(w), len(g)), f(ns[1], size(w, 2), size(g, 2)), f(lcs(w, g), len(w), len(g)), bleu))
            yield b.assign(**{c: [round(r[i], 4) for r in out] for i, c in enumerate(("rouge1", "rouge2", "rougel", "bleu4"))})

    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + ", rouge1 double, rouge2 double, rougel double, bleu4 double"
    return pairs.mapInPandas(run, schema)


def zipped(first: DataFrame, second: DataFrame, order_first: Column, order_second: Column) -> DataFrame:
    """Rows of both that stand at the same place of their orders, side by side; what is longer loses its end."""
    a, b = placed(first, F.lit(1), "pos", order_first), placed(second, F.lit(1), "pos", order_second)
    return a.join(b, "pos")


def components(beams: DataFrame) -> DataFrame:
    """``beams`` with valid, pred_rel and pred_mid: the first relation and entity of an expression that can be read."""
    ok = beams.withColumn("valid", valid_expressions(F.col("sexpr")))
    rel, mid = F.get(fx.sexpr_relations(F.col("sexpr")), F.lit(0)), F.get(fx.sexpr_entities(F.col("sexpr")), F.lit(0))
    ok = ok.withColumn("pred_rel", F.when(F.col("valid"), rel)).withColumn("pred_mid", F.when(F.col("valid"), mid))
    return ok.withColumn("valid", F.col("valid") & F.col("pred_rel").isNotNull() & F.col("pred_mid").isNotNull())


def grounded(beams: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``components`` with how (exact, fuzzy, suffix or none) of the relation and id of the entity. Distinct names are
    grounded, not beams."""
    c = components(beams).where("valid")
    r = ground_fuzzy(c.select(F.col("pred_rel").alias("relation")).distinct(), relations).select(F.col("relation").alias("pred_rel"), "how", F.col("path").alias("grounded_rel"))
    e = ground_entities(c.select(F.col("pred_mid").alias("mid")).distinct(), entities).select(F.col("mid").alias("pred_mid"), F.col("id").alias("grounded_mid"))
    return c.join(r, "pred_rel", "left").join(e, "pred_mid", "left")


def grounding_counters(found: DataFrame) -> DataFrame:
    """One row of counts over ``grounded`` beams."""
    rel, ent = F.coalesce(F.col("how"), F.lit("none")) != "none", F.col("grounded_mid").isNotNull()
    return found.agg(F.count("*").alias("total_valid"), F.count_if(F.col("how") == "exact").alias("relations_exact"), F.count_if(rel & (F.col("how") != "exact")).alias("relations_fuzzy"), F.count_if(ent).alias("entities_exact"), F.count_if(rel & ent).alias("both_grounded"))


def grounding_failures(found: DataFrame, most: int = 15) -> DataFrame:
    """(failure, n): the commonest names that were not found (a top-k report)."""
    rel = F.when(F.coalesce(F.col("how"), F.lit("none")) == "none", F.concat(F.lit("rel:"), F.substring(F.element_at(F.split("pred_rel", r"\."), -1), 1, 40)))
    ent = F.when(F.col("grounded_mid").isNull(), F.concat(F.lit("ent:"), F.substring("pred_mid", 1, 30)))
    return found.select(F.explode(F.array_compact(F.array(rel, ent))).alias("failure")).groupBy("failure").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failure").limit(most)


def hit_rates(converted: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One row: the share of rows with an expression and, given ``answers`` (id, predicted) for rows with id and gold, the
    share whose answers are the gold ones as sets."""
    n = F.round(F.avg(F.col("ok").cast("double")), 6).alias("parsed")
    if answers is None:
        return converted.agg(n)
    j = converted.join(answers, "id", "left")
    same = F.sort_array(F.array_distinct(F.coalesce("predicted", F.array().cast("array<string>")))) == F.sort_array(F.array_distinct("gold"))
    return j.agg(n, F.round(F.avg((F.col("ok") & same).cast("double")), 6).alias("executed"))


def execution_check(graph: DataFrame | Callable, rows: DataFrame, *, key: str = "id", gold: str = "gold", overlap: bool = True, options: Options = Options()) -> DataFrame:
    """``rows`` (key, SExpr, gold: array of answers) with how many answers the expression has and how many of these are gold ones, and
    ``right``: the same answers as sets or, with ``overlap``, one in common. All expressions run together; answers stay rows. Rows
    without an expression ("null", or null) and those whose expression has no answers to give are not right; a null gold is empty, nulls in it are none.
    A count's answer is its text."""
    asked = rows.where("SExpr <> 'null'").select(key, F.col("SExpr").alias("sexpr"))
    found = asked.join(batch.execute(graph, asked, options), "sexpr").groupBy(key, "x").agg(F.lit(1).alias("is_found"))
    want = rows.select(key, F.explode(F.array_distinct(F.array_compact(gold))).alias("x")).groupBy(key, "x").agg(F.lit(1).alias("is_gold"))
    both = found.join(want, [key, "x"], "full").groupBy(key).agg(F.count("is_found").alias("answers"), F.count("is_gold").alias("wanted"), F.count_if(F.col("is_found").isNotNull() & F.col("is_gold").isNotNull()).alias("common"))
    out = rows.join(both, key, "left").fillna(0, ["answers", "wanted", "common"])
    same = (F.col("answers") == F.col("wanted")) & (F.col("common") == F.col("wanted"))
    right = same | (F.col("common") > 0) if overlap else same
    return out.withColumn("right", F.coalesce(F.col("SExpr") != "null", F.lit(False)) & right).drop("wanted")


def conversion_report(checked: DataFrame) -> DataFrame:
    """One row a source of expressions, and one over all (source null): questions, those with an expression, those whose answers are
    right, and both shares."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    has = F.coalesce(F.col("SExpr") != "null", F.lit(False))
    return checked.rollup(F.col("SExpr_source").alias("source")).agg(F.count("*").alias("questions"), F.count_if(has).alias("converted"), F.count_if("right").alias("executed"), share(has).alias("converted_share"), share(F.col("right")).alias("executed_share"))
