"""The question dataset: mine facts, generate candidates, review, verify, cap, export, summarise.

Each step takes and returns DataFrames. What the row-at-a-time original idea of such pipelines does with seeded random
choice is done with keyed hashes here: the same caps, the same result in every run and on any number of machines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolattice.functions import text as fx
from chronolattice.sources.kg import LABEL, cvt_facts
from chronolattice.sources.storage import kept


@dataclass(frozen=True)
class Family:
    """One kind of temporal fact: through a mediator node (to_cvt, to_answer), with an interval or a point in time."""

    family: str
    to_cvt: str
    to_answer: str
    start: str
    end: str | None = None
    answer_type: str = "entity"
    templates: tuple[str, ...] = ("simple",)
    role: str = ""

    def __post_init__(self):
        problems = [r for r in (self.to_cvt, self.to_answer, self.start, self.end) if r and "." not in r]
        if problems:
            raise ValueError(f"relations need dots: {problems}")
        if self.end is None and {"before", "after"} & set(self.templates):
            raise ValueError("before and after need an interval")


def families(*of: Family) -> tuple[Family, ...]:
    if len({f.family for f in of}) != len(of):
        raise ValueError("families need names of their own")
    return of


#: (id, family, words, builder) of question templates: fixed values.
TEMPLATES = (
    ("simple_01", "simple", "What {role} is associated with {topic_label}?", "join"),
    ("simple_02", "simple", "Find the {role} connected to {topic_label}.", "join"),
    ("simple_03", "simple", "Name a {role} related to {topic_label}.", "join"),
    ("simple_04", "simple", "Which {role} has a connection to {topic_label}?", "join"),
    ("during_01", "during", "What {role} was associated with {topic_label} in {year}?", "tc"),
    ("during_02", "during", "Name the {role} linked to {topic_label} as of {year}.", "tc"),
    ("during_03", "during", "In {year}, what {role} was connected to {topic_label}?", "tc"),
    ("first_01", "first", "What was the earliest {role} associated with {topic_label}?", "argmin"),
    ("first_02", "first", "Name the first {role} linked to {topic_label}.", "argmin"),
    ("first_03", "first", "What {role} came first for {topic_label}?", "argmin"),
    ("first_04", "first", "Find the original {role} connected to {topic_label}.", "argmin"),
    ("last_01", "last", "What was the most recent {role} associated with {topic_label}?", "argmax"),
    ("last_02", "last", "Name the latest {role} linked to {topic_label}.", "argmax"),
    ("last_03", "last", "What {role} was most recent for {topic_label}?", "argmax"),
    ("last_04", "last", "Find the last {role} connected to {topic_label}.", "argmax"),
)


def _names(graph: DataFrame) -> DataFrame:
    return graph.where((F.col("p") == LABEL) & (F.col("o_lang") == "en")).select(F.col("s").alias("mid"), F.col("o").alias("label"))


def _labelled(df: DataFrame, names: DataFrame, c: str, name: str, *how: str) -> DataFrame:
    """``df`` with the first label of the node in ``c``, or the node itself."""
    label = names.groupBy(F.col("mid").alias(c)).agg(F.min("label").alias(name))
    return df.join(reduce(DataFrame.hint, how, label), c, "left").withColumn(name, F.coalesce(name, c))


def mine_facts(graph: DataFrame, of: tuple[Family, ...], *, low: int = 1800, high: int = 2025, cap: int | None = None, total: int | None = None, only: tuple[str, ...] | None = None, facts_of: Callable[..., DataFrame] = cvt_facts, once: bool = True) -> DataFrame:
    """Facts of the families: topic and answer differ, years lie within bounds where there are any, each fact once, at
    most ``cap`` a family (those of the smallest hashes) and ``total`` of all (families in their order). ``facts_of`` reads a
    family's facts off the graph, those of several families at once where it can (``together``). Facts of a topic lie together: they are
    dealt once, by topic, for all that follows; labels are joined last, so where none is read none is looked up. Without ``once`` a
    fact that the graph says twice comes twice: ``generate`` makes the same of it and keeps the first of equals anyway."""
    names = _names(graph)
    ok = lambda c: fx.year_of(F.col(c)).isNull() | fx.year_of(F.col(c)).between(low, high)
    chosen = [(i, f) for i, f in enumerate(of) if not only or f.family in only]
    asked = [(f.to_cvt, f.to_answer, f.start, f.end) for _, f in chosen]
    if hasattr(facts_of, "together"):
        facts = facts_of.together(graph, asked).withColumn("__family", F.get(F.array(*[F.lit(i) for i, _ in chosen]), F.col("k")).cast("byte"))
    else:
        facts = reduce(DataFrame.unionByName, [facts_of(graph, *a).withColumn("__family", F.lit(i).cast("byte")) for a, (i, _) in zip(asked, chosen)])
    facts = facts.where("topic != answer").select("__family", F.col("topic").alias("topic_mid"), F.col("answer").alias("answer_mid"), F.substring("ts_from", 1, 10).alias("temporal_start"), F.substring("ts_to", 1, 10).alias("temporal_end"))
    facts = facts.where(ok("temporal_start") & ok("temporal_end"))
    # what shows as blank is no fact's end: nodes that a blank label could be of are few, so facts are not dealt for it
    odd = kept(names.where((F.trim("label") == "") | (F.trim("mid") == "")).select("mid").distinct())
    odd = None if odd.isEmpty() else kept(names.join(odd, "mid", "left_semi").groupBy("mid").agg(F.min("label").alias("label")))
    for c in ("topic_mid", "answer_mid"):
        if odd is None:
            facts = facts.where(F.trim(c) != "")
        else:
            facts = facts.join(odd.select(F.col("mid").alias(c), F.col("label").alias("__label")), c, "left").where(F.trim(F.coalesce("__label", c)) != "").drop("__label")
    facts = facts.select("__family", "topic_mid", "answer_mid", "temporal_start", "temporal_end")
    if cap or total is not None:
        facts = _first_facts(facts, of, min(n for n in (cap, total) if n is not None))
    facts = facts.repartition("topic_mid")
    facts = facts.distinct() if once else facts
    # labels of topics come to where the topics lie: a hash of them, so facts are not sorted for it
    facts = _labelled(_labelled(facts, names, "topic_mid", "topic_label", "shuffle_hash"), names, "answer_mid", "answer_label")
    named = lambda value: F.element_at(F.array(*[F.lit(value(f)) for f in of]), F.col("__family") + 1)
    facts = facts.select(
        named(lambda f: f.family).alias("fact_relation_family"), "topic_mid", named(lambda f: f.to_cvt).alias("anchor_relation"), named(lambda f: f.to_answer).alias("answer_relation"), "answer_mid",
        "temporal_start", "temporal_end", named(lambda f: f.start).alias("retrieved_from_relation"), "topic_label", "answer_label",
    )
    # a short hash is a name: among very many facts different ones may share it, so repeats are told by what it is made of
    facts = facts.withColumn("supporting_row_hash", fx.row_hash(*map(F.col, ("fact_relation_family", "topic_mid", "answer_mid", "temporal_start", "temporal_end"))))
    facts = facts.withColumn("fact_id", F.concat_ws("-", "fact_relation_family", "supporting_row_hash"))
    facts = cap_by(facts, "fact_relation_family", cap, F.col("supporting_row_hash")) if cap else facts
    place = F.array_position(F.array(*[F.lit(f.family) for f in of]), F.col("fact_relation_family"))
    return facts.orderBy(place, "supporting_row_hash").limit(total) if total is not None else facts


def _first_facts(facts: DataFrame, of: tuple[Family, ...], n: int) -> DataFrame:
    """All facts, with their repeats, of at least the first ``n`` hashes of each family, and few others. Least hashes of many groups are
    different hashes, so the n-th of them is no smaller than the n-th of all; no facts are sorted or dealt to find it, but they are
    read once for it and once more."""
    family = F.element_at(F.array(*[F.lit(f.family) for f in of]), F.col("__family") + 1)
    # twelve hexadecimal digits have the order of their number
    hashed_ = facts.withColumn("__hash", F.conv(fx.row_hash(family, *map(F.col, ("topic_mid", "answer_mid", "temporal_start", "temporal_end"))), 16, 10).cast("long"))
    least = hashed_.groupBy("__family", F.pmod(F.xxhash64("__hash"), F.lit(max(4096, 16 * n))).alias("__group")).agg(F.min("__hash").alias("__limit"))
    place = F.row_number().over(Window.partitionBy("__family").orderBy("__limit"))
    limits = kept(least.withColumn("__n", place).where(F.col("__n") == n).select("__family", "__limit"))  # a row a family
    return hashed_.join(F.broadcast(limits), "__family", "left").where(F.col("__limit").isNull() | (F.col("__hash") <= F.col("__limit"))).drop("__hash", "__limit")


def fact_totals(facts: DataFrame) -> DataFrame:
    """One row: facts, those with labels and with either end, distinct topics and answers."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return facts.agg(
        F.count("*").alias("total_facts"), F.count_if(there("topic_label") & there("answer_label")).alias("with_labels"), F.count_if(there("temporal_start")).alias("with_temporal_start"), F.count_if(there("temporal_end")).alias("with_temporal_end"),
        F.count_distinct("topic_mid").alias("unique_topics"), F.count_distinct("answer_mid").alias("unique_answers"),
    )


def fact_sample(facts: DataFrame, n: int = 10, graph: DataFrame | None = None) -> DataFrame:
    """The first facts by id, as a summary shows them (a top-k report). With the ``graph`` they come from, labels are looked up for
    these alone."""
    if graph is not None:
        facts = facts.drop("topic_label", "answer_label")
    first = facts.orderBy("fact_id").limit(n)
    if graph is not None:
        first = _labelled(_labelled(first, _names(graph), "topic_mid", "topic_label"), _names(graph), "answer_mid", "answer_label")
    return first.select("fact_id", F.col("fact_relation_family").alias("family"), F.col("topic_label").alias("topic"), F.col("answer_label").alias("answer"), F.col("temporal_start").alias("start"), F.col("temporal_end").alias("end"))


def cap_by(df: DataFrame, group: str | Column, most: int, *order: Column) -> DataFrame:
    """At most ``most`` rows of each group, the first by ``order``."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def keep_first(df: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def hashed(seed: int, *parts: Column) -> Column:
    """A draw that is the same everywhere: hex text, to order by."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)


def generate(facts: DataFrame, of: tuple[Family, ...], seed: int = 42) -> DataFrame:
    """One to three questions a fact, from the templates of its family; templates with a time need a dated fact. ``facts`` as
    ``mine_facts`` has them of the same families. Repeats are told by a key of 16 bytes (md5) of question and expression, over rows of a fact's own
    columns and a template's number: texts are made for the key and, of what stays, once more."""
    bank = sorted(TEMPLATES)  # so templates' numbers have the order of their names
    dated = F.coalesce(F.col("temporal_start"), F.lit("")).isin("", "2000") == F.lit(False)
    # what a fact draws is an array of its own row: only what is asked becomes rows. A draw is text that ends in its template's character, and what
    # all draws of a fact share are columns: functions over an array's elements, or long code, would not run compiled
    masks = [(f.family, sum(1 << n for n, t in enumerate(bank) if t[1] in f.templates)) for f in of]
    undated = sum(1 << n for n, t in enumerate(bank) if t[1] != "during")
    mask = reduce(lambda out, m: F.when(F.col("fact_relation_family") == m[0], m[1]).otherwise(out), masks, F.lit(0))
    facts = facts.withColumns({
        "__mask": F.when(dated, mask).otherwise(mask.bitwiseAND(undated)), "__drawing": F.concat_ws("|", F.lit(str(seed)), "fact_id", F.lit("")),
        "__many": F.instr(F.lit("0123456789abcdef"), F.substring(hashed(seed, F.col("fact_id")), 1, 1)) % 3 + 1,
    })
    drawn = [F.when(F.col("__mask").bitwiseAND(1 << n) != 0, F.concat(F.sha2(F.concat("__drawing", F.lit(i)), 256), F.lit(chr(ord("0") + n)))).otherwise("") for n, (i, *_) in enumerate(bank)]
    asked = F.slice(F.sort_array(F.array_remove(F.array(*drawn), "")), 1, F.col("__many"))
    # what follows from other columns as a rule is null in the rows that are sorted
    usual = {"topic_label": F.col("topic_mid"), "answer_label": F.col("answer_mid"), "supporting_row_hash": F.substring_index("fact_id", "-", -1)}
    family = F.array_position(F.array(*[F.lit(f.family) for f in of]), F.col("fact_relation_family")) - 1
    c = facts.select("topic_mid", "answer_mid", "temporal_start", "temporal_end", "fact_id", *[F.nullif(F.col(k), v).alias(k) for k, v in usual.items()], family.cast("byte").alias("__family"), F.explode(asked).alias("__draw"))
    c = c.withColumn("__template", (F.ascii(F.substring("__draw", -1, 1)) - ord("0")).cast("byte")).drop("__draw")
    narrow = c.columns

    def worded(df: DataFrame) -> DataFrame:
        of_family = lambda value: F.get(F.array(*[F.lit(value(f)) for f in of]), F.col("__family"))
        of_template = lambda at: F.get(F.array(*[F.lit(t[at]) for t in bank]), F.col("__template"))
        df = df.withColumns({k: F.coalesce(k, v) for k, v in usual.items()}).withColumns({
            "fact_relation_family": of_family(lambda f: f.family), "anchor_relation": of_family(lambda f: f.to_cvt), "answer_relation": of_family(lambda f: f.to_answer), "retrieved_from_relation": of_family(lambda f: f.start), "role": of_family(lambda f: f.role),
            "template_id": of_template(0), "template_family": of_template(1), "words": of_template(2), "builder": of_template(3),
        })
        return df.select("*", fill("words", "role", " ".join(t[2] for t in bank)).alias("question"), build().alias("s_expression"))

    key = F.unhex(F.md5(F.concat_ws("\n", "question", "s_expression")))
    # an expression names its topic, so equal ones are of one topic and lie where its facts lie
    c = worded(c).select(*[k for k in narrow if k not in usual], *[F.nullif(F.col(k), v).alias(k) for k, v in usual.items()], key.alias("__key"))
    c = worded(keep_first(c, [F.col("topic_mid"), F.col("__key")], F.col("fact_id"), F.col("__template")))
    return c.select(
        F.concat_ws("-", F.lit("candidate"), "fact_id", "template_id").alias("sample_id"), "question", F.lit("train").alias("split"), F.lit("synthetic").alias("source"),
        fx.question_type(F.col("question"), F.col("template_family"), F.col("s_expression")).alias("temporal_type"), F.col("template_family").alias("temporal_signal"), F.col("topic_mid").alias("topic_entity_mid"), "s_expression", F.lit("").alias("sparql"),
        F.array("answer_mid").alias("answers"), F.lit("raw").alias("validation_status"), F.lit("SyntheticTemporal").alias("source_dataset"), F.array("anchor_relation", "answer_relation", "retrieved_from_relation").alias("relation_ids"), F.array("topic_mid", "answer_mid").alias("entity_ids"),
        F.struct("template_id", "template_family", "fact_relation_family", "topic_label", "answer_label", "temporal_start", "temporal_end", "supporting_row_hash", F.col("fact_id").alias("mined_fact_id"), F.col("fact_id").alias("source_seed_id")).alias("metadata"),
    )


def fill(words: str, role: str, known: str) -> Column:
    """A template's slots filled from a fact, those that the ``known`` templates have; without a role, the relation's next to last part stands in."""
    named = F.coalesce(F.when(F.col(role) != "", F.col(role)), F.replace(F.element_at(F.split("answer_relation", r"\."), -2), F.lit("_"), F.lit(" ")))
    out = F.replace(F.col(words), F.lit("{role}"), named)
    for slot, v in (("{topic_label}", F.col("topic_label")), ("{answer_label}", F.col("answer_label")), ("{year}", fx.year_of(F.col("temporal_start"), default=2000).cast("string"))):
        out = F.replace(out, F.lit(slot), v) if slot in known else out
    return out


def build() -> Column:
    """The expression of a fact by its template's builder."""
    base = F.format_string("(JOIN (R %s) %s)", "answer_relation", "topic_mid")
    date = F.coalesce(F.when(F.col("temporal_start") != "", F.col("temporal_start")), F.when(F.col("temporal_end") != "", F.col("temporal_end")), F.lit("2000"))
    arg = lambda op: F.concat(F.lit(f"({op} "), base, F.lit(" "), F.col("retrieved_from_relation"), F.lit(")"))
    return F.when(F.col("builder") == "join", base).when(F.col("builder") == "tc", F.concat(F.lit("(TC "), base, F.lit(" "), F.col("retrieved_from_relation"), F.lit(" "), date, F.lit(")"))).when(F.col("builder") == "argmin", arg("ARGMIN")).otherwise(arg("ARGMAX"))


def _issues(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in rules]))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def validation_issues() -> Column:
    """What is wrong with a sample's record (the messages are fixed values)."""
    s = F.col("s_expression")
    return _issues(
        (_blank("sample_id"), "sample_id is required"), (_blank("question"), "question is required"), (_blank("split"), "split is required"), (_blank("temporal_signal"), "temporal_signal is required"),
        (_blank("s_expression") | (s == "null"), "s_expression is missing or null"), (_blank("sparql"), "sparql is required"), (F.size("answers") <= 0, "answers must not be empty"), (F.col("temporal_type") == "unknown", "temporal_type should be resolved before export"),
    )


def review_issues(seed: str = "metadata.source_seed_id", mined: str = "metadata.mined_fact_id") -> Column:
    """Why a synthetic sample would not do (the messages are fixed values)."""
    s, q, up = F.col("s_expression"), F.col("question"), F.upper("s_expression")
    kind = F.col("temporal_type")
    date = r"\b\d{4}(?:-\d{2}-\d{2})?\b"
    return _issues(
        (F.col("source") != "synthetic", "sample source is not synthetic"), (_blank("question"), "question is required"), (_blank("s_expression") | (F.lower(s) == "null"), "s_expression is missing or null"),
        (kind == "unknown", "temporal_type is unknown"), (F.size("answers") <= 0, "answers must not be empty"), (~F.col("topic_entity_mid").startswith("m."), "topic entity mid must look like a Freebase mid"),
        (s.contains("UNKNOWN"), "s_expression contains UNKNOWN placeholder"), (q.rlike(r"\bm\.[A-Za-z0-9_]+\b"), "question still contains raw mids"), (F.size("relation_ids") <= 0, "relation_ids must not be empty"),
        (F.coalesce(F.col(seed), F.lit("")) == "", "missing source_seed_id metadata"), (F.coalesce(F.col(mined), F.lit("")) == "", "missing mined_fact_id metadata"),
        ((kind == "during") & ~up.contains("TC"), "during sample must use TC operator"), ((kind == "during") & ~q.rlike(date) & ~s.rlike(date), "during sample should include a temporal value"),
        ((kind == "last") & ~up.contains("ARGMAX"), "last sample must use ARGMAX"), ((kind == "first") & ~up.contains("ARGMIN"), "first sample must use ARGMIN"),
    )


def reviewed(samples: DataFrame) -> DataFrame:
    """Samples with filter_issues; accepted ones have none."""
    # what is read of the metadata is taken out first, so that the rest of it need not be made
    s = samples.withColumns({"__seed": F.col("metadata.source_seed_id"), "__mined": F.col("metadata.mined_fact_id")})
    s = s.withColumn("filter_issues", review_issues("__seed", "__mined")).drop("__seed", "__mined")
    return s.withColumn("validation_status", F.when(F.size("filter_issues") == 0, "normalized").otherwise("failed"))


def review_summary(samples: DataFrame) -> DataFrame:
    """(metric, key, n): counts of accepted and rejected samples and of the twenty commonest reasons."""
    # samples are read once: they are counted by their lists of reasons, which are few, and all else is made of these
    lists = reviewed(samples).groupBy("filter_issues").agg(F.count("*").alias("n"))
    status = F.struct(F.lit("status").alias("metric"), F.when(F.size("filter_issues") == 0, "accepted").otherwise("rejected").alias("key"))
    reasons = F.transform("filter_issues", lambda x: F.struct(F.lit("reason").alias("metric"), x.alias("key")))
    counts = lists.select("n", F.explode(F.concat(F.array(status), reasons)).alias("x")).groupBy("x.metric", "x.key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("n"), "key"))
    return counts.withColumn("__place", place).where("metric = 'status' or __place <= 20").select("metric", "key", "n")


def review_totals(samples: DataFrame) -> DataFrame:
    """One row: samples, accepted, rejected, and the share accepted."""
    ok = F.size("filter_issues") == 0
    n = reviewed(samples).agg(F.count("*").alias("total_samples"), F.count_if(ok).alias("accepted_samples"), F.count_if(~ok).alias("rejected_samples"))
    return n.withColumn("acceptance_rate", F.when(F.col("total_samples") == 0, 0.0).otherwise(F.round(F.col("accepted_samples") / F.col("total_samples"), 4)))


def verify_totals(verified: DataFrame) -> DataFrame:
    """One row: candidates, passed, failed, and the percentage passed."""
    n = verified.agg(F.count("*").alias("total_candidates"), F.count_if("verified").alias("passed"), F.count_if(~F.col("verified")).alias("failed"))
    return n.withColumn("pass_rate", F.when(F.col("total_candidates") == 0, 0.0).otherwise(F.round(100 * F.col("passed") / F.col("total_candidates"), 1)))


def training_summary(examples: DataFrame) -> DataFrame:
    """(metric, key, n): all examples, those with metadata (a source), and of these by source and type."""
    # examples are read once: they are counted by source and type, which are few, and all else is made of these
    counts = examples.groupBy("source", "temporal_type").agg(F.count("*").alias("n"))
    row = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"))
    every = row("total_examples", F.lit(""))
    told = [row("with_metadata", F.lit("")), row("by_source", F.col("source")), row("by_temporal_type", F.coalesce("temporal_type", F.lit("unknown")))]
    rows = counts.select("n", F.explode(F.when(F.col("source").isNull(), F.array(every)).otherwise(F.array(every, *told))).alias("x"))
    none = examples.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.explode(F.array(every, told[0])).alias("x"))  # totals are there without examples too
    return rows.unionByName(none).groupBy("x.metric", "x.key").agg(F.sum("n").alias("n")).select("metric", "key", "n")


def distribution_filter(samples: DataFrame, *, family: int = 200, kind: int = 500, bucket: int = 300, least: int = 10, seed: int = 42) -> DataFrame:
    """Length, repeats, then caps by family, type and decade, in this order."""
    s = samples.where(F.length(F.trim("question")) >= least)
    s = keep_first(s, [F.lower(F.trim("question")), F.trim("s_expression")], F.col("sample_id"))
    draw = [hashed(seed, F.col("sample_id")), F.col("sample_id")]
    s = cap_by(s, F.coalesce(F.col("metadata.fact_relation_family"), F.lit("unknown")), family, *draw)
    s = cap_by(s, "temporal_type", kind, *draw)
    return cap_by(s, fx.decade(fx.year_of(F.col("metadata.temporal_start"))), bucket, *draw)


def summary(df: DataFrame, **keys: Column) -> DataFrame:
    """(metric, key, n): counts by each of several keys in one pass (grouping sets)."""
    names = list(keys)
    d = df.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in keys.items()])
    g = d.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    which = F.array(*[F.lit(n) for n in names])
    place = F.lit(0)
    key = F.lit(None).cast("string")
    for i, n in enumerate(names):
        on = F.col("g") == sum(1 << (len(names) - 1 - j) for j in range(len(names)) if j != i)
        place, key = F.when(on, i).otherwise(place), F.when(on, F.col(n)).otherwise(key)
    return g.select(F.get(which, place).alias("metric"), key.alias("key"), "n")


def sample_totals(samples: DataFrame, by: str | None = None) -> DataFrame:
    """One row: samples, distinct questions and expressions, and samples with a topic. ``by``: a column that equal expressions share,
    as topic_entity_mid is of what ``generate`` makes: expressions are then told apart where its rows lie, and questions alone are dealt."""
    expressions = F.count_distinct("s_expression")
    if by:
        w = Window.partitionBy(by, "s_expression").orderBy("s_expression")
        samples = samples.select(*dict.fromkeys(("question", "s_expression", "topic_entity_mid", by))).withColumn("__first", F.row_number().over(w))
        expressions = F.count_if((F.col("__first") == 1) & F.col("s_expression").isNotNull())
    return samples.agg(F.count("*").alias("total_samples"), F.count_distinct("question").alias("unique_questions"), expressions.alias("unique_expressions"), F.count_if(~_blank("topic_entity_mid")).alias("non_empty_topic_entities"))


def verify(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """Samples joined with what their expressions answer (sample_id, predicted): verified, reason, and answers replaced by the
    graph's where they match."""
    return _judged(samples.join(answers, "sample_id", "left"))


def _judged(j: DataFrame) -> DataFrame:
    j = j.withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))
    # matching costs far more than all else here, so it is a column, and what follows reads that
    j = j.withColumn("verified", fx.answers_match(F.col("predicted"), F.col("answers")))
    ok = F.col("verified")
    why = F.when(_blank("s_expression"), "conversion_failed").when(F.size("predicted") == 0, "no_results").when(~ok, "answer_mismatch").otherwise("")
    return j.withColumn("verification_error", why).withColumn("answers", F.when(ok, F.col("predicted")).otherwise(F.col("answers"))).withColumn("validation_status", F.when(ok, "executable").otherwise("failed"))


def answer_candidates(graph: DataFrame, samples: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, predicted) of generated samples, all at once: the facts behind (JOIN (R r) e), and of these the open
    interval, the earliest or the latest, as the expression says. Relations are matched as data, not one plan a sample; those that samples can name, where they are
    known beforehand, leave other branches of the graph unread."""
    graph = graph.where(F.col("p").isin(list(relations))) if relations else graph
    rel, ent = fx.sexpr_relations(F.col("s_expression")), fx.sexpr_entities(F.col("s_expression"))
    q = samples.select("sample_id", F.get(rel, F.lit(0)).alias("p"), F.get(ent, F.lit(0)).alias("topic"), F.col("relation_ids")[0].alias("via"), F.get(rel, F.lit(1)).alias("at"), fx.main_operator(F.col("s_expression")).alias("op"), F.regexp_extract("s_expression", r" (\d{4})[0-9-]*\)$", 1).alias("year"))
    hop = graph.select(F.col("s").alias("topic"), F.col("p").alias("via"), F.col("o").alias("cvt")).where("topic is not null")
    value = graph.select(F.col("s").alias("cvt"), F.col("p").alias("p"), F.col("o").alias("x"))
    when = graph.select(F.col("s").alias("cvt"), F.col("p").alias("at"), F.col("o").alias("start"))
    end = when.select("cvt", F.regexp_replace("at", r"\.to$", ".from").alias("at"), F.col("start").alias("stop"), F.col("at").endswith(".to").alias("is_end")).where("is_end").drop("is_end")
    rows = q.join(hop, ["topic", "via"]).join(value, ["cvt", "p"]).join(when, ["cvt", "at"], "left").join(end, ["cvt", "at"], "left")
    inside = (F.col("op") != "TC") | (((F.substring("start", 1, 4) <= F.col("year")) | F.col("start").isNull()) & ((F.substring("stop", 1, 4) >= F.col("year")) | F.col("stop").isNull()))
    w = Window.partitionBy("sample_id")
    rows = rows.where(inside).withColumn("a", F.min(F.struct("start", "x")).over(w)).withColumn("b", F.max("start").over(w))
    rows = rows.withColumn("c", F.min(F.when(F.col("start") == F.col("b"), F.col("x"))).over(w))
    keep = (F.col("op") == "ARGMIN") & (F.col("x") == F.col("a.x")) | (F.col("op") == "ARGMAX") & (F.col("x") == F.col("c")) | ~F.col("op").isin("ARGMIN", "ARGMAX")
    return rows.where(keep).groupBy("sample_id").agg(F.sort_array(F.collect_set("x")).alias("predicted"))


def verify_generated(samples: DataFrame, graph: DataFrame, of: tuple[Family, ...], facts_of: Callable[..., DataFrame] = cvt_facts) -> DataFrame:
    """``verify`` of samples from ``generate``, whose topic_entity_mid is the topic that their expressions name: the same answers as by
    ``answer_candidates`` where a node has one start and one end. What the graph knows of a topic is gathered once (each answer
    with the years of its validity, its first and its last start), and samples meet it where they lie."""
    parts = []
    for i, f in enumerate(of):
        stop = f.start.removesuffix(".from") + ".to" if f.start.endswith(".from") else None
        facts = facts_of(graph, f.to_cvt, f.to_answer, f.start, stop)
        parts.append(facts.select(F.col("topic").alias("topic_entity_mid"), F.lit(i).alias("k"), F.col("answer").alias("x"), F.col("ts_from").alias("start"), F.substring("ts_to", 1, 4).alias("until")))
    known = reduce(DataFrame.unionByName, parts).where("topic_entity_mid is not null").repartition("topic_entity_mid")
    known = known.groupBy("topic_entity_mid", "k", "x", F.substring("start", 1, 4).alias("since"), "until").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    # what a topic's questions may ask of a family is made once a topic, not once a question
    fact = F.struct("x", "since", "until", "lo", "hi")
    known = known.groupBy("topic_entity_mid").agg(*[F.collect_list(F.when(F.col("k") == i, fact)).alias(f"__{i}") for i in range(len(of))])
    answers = lambda a: F.sort_array(F.array_distinct(F.transform(a, lambda e: e.x)))
    first = lambda a: F.array_min(F.transform(a, lambda e: F.struct(e.lo.alias("lo"), e.x.alias("x"))))["x"]
    at_last = lambda a: F.transform(F.filter(a, lambda e: e.hi == F.array_max(F.transform(a, lambda o: o.hi))), lambda e: e.x)
    told = [F.struct(a.alias("facts"), answers(a).alias("all"), F.array_compact(F.array(first(a))).alias("first"), F.array_compact(F.array(F.array_min(at_last(a)))).alias("last")) for a in (F.col(f"__{i}") for i in range(len(of)))]
    known = known.select("topic_entity_mid", F.array(*told).alias("__known"))
    rel, op = fx.sexpr_relations(F.col("s_expression")), fx.main_operator(F.col("s_expression"))
    hops = F.struct(F.get("relation_ids", F.lit(0)), F.get(rel, F.lit(0)), F.coalesce(F.get(rel, F.lit(1)), F.get("relation_ids", F.lit(2))))
    family = reduce(lambda out, e: F.when(hops == F.struct(*map(F.lit, (e[1].to_cvt, e[1].to_answer, e[1].start))), e[0]).otherwise(out), reversed(list(enumerate(of))), F.lit(None).cast("int"))
    j = samples.withColumns({"__k": family, "__op": op, "__year": F.regexp_extract("s_expression", r" (\d{4})[0-9-]*\)$", 1)}).join(known, "topic_entity_mid", "left")
    j = j.withColumn("__known", F.get("__known", "__k"))
    year, got = F.col("__year"), F.col("__known")
    inside = lambda e: (e.since.isNull() | (e.since <= year)) & (e.until.isNull() | (e.until >= year))
    found = F.when(F.col("__op") == "ARGMIN", got["first"]).when(F.col("__op") == "ARGMAX", got["last"]).when(F.col("__op") == "TC", answers(F.filter(got["facts"], inside))).otherwise(got["all"])
    return _judged(j.withColumn("predicted", found).drop("__k", "__op", "__year", "__known"))


#: What a model is asked for, by kind of question.
STANDARD = "Generate a Logical Form query that retrieves the information corresponding to the given question.\n"
TEMPORAL = "Generate a Logical Form query for this temporal question, using TC operators for date constraints and ARGMAX/ARGMIN for ordinal constraints.\n"


def training_examples(human: DataFrame, synthetic: DataFrame, *, most: int | None = None, split: str | None = None, suspicious: bool = True) -> DataFrame:
    """Instruction examples: people's samples before synthetic ones, each (input, output) once, at most ``most`` synthetic ones
    of those that are kept; without ``suspicious``, people's samples whose column of that name is true stay out."""
    if not suspicious:
        human = human.where(~F.coalesce("suspicious", F.lit(False)))
    both = human.select("sample_id", "question", "s_expression", "split", "source", "temporal_type", F.lit(0).alias("rank")).unionByName(synthetic.select("sample_id", "question", "s_expression", "split", "source", "temporal_type", F.lit(1).alias("rank")))
    both = both.where(~_blank("s_expression") & (F.lower("s_expression") != "null"))
    if split:
        both = both.where(F.col("split") == split)
    ask = F.when(F.col("temporal_type") == "unknown", STANDARD).otherwise(TEMPORAL)
    ex = both.select("sample_id", "source", "temporal_type", "rank", ask.alias("instruction"), F.concat(F.lit("Question: { "), F.trim("question"), F.lit(" }")).alias("input"), F.trim("s_expression").alias("output"))
    ex = keep_first(ex, [F.col("input"), F.col("output")], F.col("rank"), F.col("sample_id"))
    if most is not None:
        # only synthetic ones are counted; a limit over a sort keeps the first of each task and then the first of all
        ex = ex.where("rank = 0").unionByName(ex.where("rank = 1").orderBy("sample_id").limit(most))
    return ex


def relation_inventory(samples: DataFrame, ontology: DataFrame | None = None) -> DataFrame:
    """(relation, n, hint): temporal relations by the number of samples that use them, and those of an ontology."""
    r = samples.select(F.explode(F.array_distinct("relation_ids")).alias("relation"))
    if ontology is not None:
        r = r.unionByName(ontology.select("relation"))
    r = r.where(fx.temporal_relation(F.col("relation")))
    return r.groupBy("relation").agg(F.count("*").alias("n")).withColumn("hint", fx.hint_for(F.col("relation")))


def standardise(merged: DataFrame, origin: DataFrame, split: str) -> DataFrame:
    """Samples of annotated questions (ID, question, answer, normed_sexpr, relations, entities), joined with their origin's
    annotations (Id, TemporalSignalNorm, TopicEntityMid, Sparql)."""
    o = origin.select(F.col("Id").cast("string").alias("ID"), "TemporalSignalNorm", "TopicEntityMid", "Sparql")
    j = merged.withColumn("ID", F.col("ID").cast("string")).join(o, "ID", "left")
    signal = fx.safe_signal(F.coalesce("TemporalSignalNorm", F.lit("")), F.col("question"))
    sparql = F.coalesce("Sparql", F.lit(""))
    s = F.coalesce("normed_sexpr", F.lit(""))
    return j.select(F.col("ID").alias("sample_id"), "question", F.lit(split).alias("split"), F.lit("human").alias("source"), fx.question_type(F.col("question"), signal, s, sparql).alias("temporal_type"), signal.alias("temporal_signal"), fx.topic_entity(F.coalesce("TopicEntityMid", F.lit("")), F.col("entities")).alias("topic_entity_mid"), s.alias("s_expression"), sparql.alias("sparql"), F.coalesce("answer", F.array().cast("array<string>")).alias("answers"), F.col("relations").alias("relation_ids"), F.array_union("entities", F.array(fx.topic_entity(F.coalesce("TopicEntityMid", F.lit("")), F.col("entities")))).alias("entity_ids"))


def read_families(spark: SparkSession, path: str) -> tuple[Family, ...]:
    """Families from a YAML or JSON file of dictionaries with ``Family``'s fields."""
    import json

    text = "\n".join(r.value for r in spark.read.text(path).collect())  # a configuration file: a few kilobytes
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    return families(*[Family(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items()}) for f in data["families"]])
