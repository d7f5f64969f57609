"""Logical forms to DataFrame plans.

``compile_expr`` turns an expression over a triple graph into a DataFrame of distinct answers x. Each node becomes filters and
equi-joins on the graph; Catalyst orders and places them. Decisions where the language leaves room:

* ties of ARGMAX and ARGMIN go to the smallest x; a nested one is a plan of its own (``global_limit`` makes its order
  and limit hold for the whole query instead);
* a time constraint looks at a node's validity interval; missing ends are open; ends that cannot be read as a time fail;
  full dates stand for their year; NOW is a parameter;
* answers are never an entity that the query mentions, nor the value of another variable of the same row;
  dialect ``cwq`` excludes entities only where there is no other variable;
* literals: quoted strings and dates match as prefixes, others exactly; a literal is never a subject.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolattice.plans import sexpr
from chronolattice.sources.kg import TYPE


@dataclass(frozen=True)
class Options:
    dialect: str = "default"
    now: str = "2015-08-10"
    global_limit: bool = False
    tc_form: str = "aggregate"  # or "exists": the same answers by four existence tests
    exclusions: bool = True
    language: str | None = "en"


#: Partners of the relations that begin an interval, by their last part (fixed values).
ENDS = {"from": "to", "start_date": "end_date", "from_date": "to_date", "start": "end"}


def end_relation(start: str) -> str:
    head, _, last = start.rpartition(".")
    return f"{head}.{ENDS.get(last, 'to')}"


def time_bounds(time: str, now: str) -> tuple[str, str]:
    """First and last day that a constraint's time means."""
    if time.strip('"').upper().startswith("NOW"):
        return now, now
    year = re.match(r'"?(\d{4})', time)
    if not year:
        raise sexpr.SexprError(f"no year in {time!r}")
    return f"{year[1]}-01-01", f"{year[1]}-12-31"


def instant(c: Column) -> Column:
    """A possibly partial date as a timestamp; null if it is none."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM")), F.try_to_timestamp(c, F.lit("yyyy")))


@dataclass
class Rows:
    """A plan of rows (x, x_kind, x_lang, other variables)."""

    df: DataFrame
    vars: list[str] = field(default_factory=list)
    order: tuple[str, str] | None = None  # column and direction that a global limit keeps


class Compiler:
    def __init__(self, graph: DataFrame, options: Options):
        self.graph, self.options, self.fresh = graph, options, itertools.count()

    def name(self) -> str:
        return f"v{next(self.fresh)}"

    def of(self, p: str, s: str, o: str) -> DataFrame:
        """The pairs of a relation, with the given column names."""
        return self.graph.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o), F.col("o_kind").alias(f"{o}_kind"), F.col("o_lang").alias(f"{o}_lang"), F.col("o_datatype").alias(f"{o}_datatype"))

    def rows(self, e) -> Rows:
        if isinstance(e, str):
            if sexpr.kind(e) == "class":
                return self._entities(self.graph.where((F.col("p") == TYPE) & (F.col("o") == e)))
            raise sexpr.SexprError(f"{e!r} is no set by itself")
        op = e[0]
        if op in sexpr.COMPARE:
            return self._compare(e)
        return getattr(self, f"_{op.lower()}")(*e[1:]) if op not in ("ARGMAX", "ARGMIN") else self._arg(op, *e[1:])

    def _entities(self, found: DataFrame) -> Rows:
        return Rows(found.select(F.col("s").alias("x"), F.lit("entity").alias("x_kind"), F.lit(None).cast("string").alias("x_lang")))

    def _join(self, rel, arg) -> Rows:
        reverse = isinstance(rel, list) and rel[0] == "R"
        p = rel[1] if reverse else rel
        if isinstance(p, list):
            raise sexpr.SexprError("a path of relations stands in comparisons and extremes only")
        if isinstance(arg, str):
            k = sexpr.kind(arg)
            if reverse:
                if k != "entity":
                    raise sexpr.SexprError("a literal or class is never a subject")
                return Rows(self.graph.where((F.col("p") == p) & (F.col("s") == arg)).select(F.col("o").alias("x"), F.col("o_kind").alias("x_kind"), F.col("o_lang").alias("x_lang")))
            return self._entities(self.graph.where((F.col("p") == p) & (self._literal(arg) if k == "literal" else F.col("o") == arg)))
        child = self.rows(arg)
        v = self.name()
        inner = child.df.select(F.col("x").alias(v), *child.vars)
        if reverse:
            pairs = self.of(p, v, "x").drop("x_datatype")
            df = pairs.join(inner, v)
        else:
            df = self.of(p, "x", v).drop(f"{v}_kind", f"{v}_lang", f"{v}_datatype").join(inner, v).withColumns({"x_kind": F.lit("entity"), "x_lang": F.lit(None).cast("string")})
        if not self.options.exclusions and not child.order:  # nobody asks which way an answer was reached
            return Rows(df.select("x", "x_kind", "x_lang").distinct())
        # each way once, whatever the number of edges between its nodes
        return Rows(df.select("x", "x_kind", "x_lang", v, *child.vars).distinct(), [v, *child.vars], child.order)

    def _literal(self, token: str) -> Column:
        m = re.match(r'^"?(.*?)"?(?:@([\w-]+)|\^\^(.*))?$', token, re.S)
        text, lang, datatype = m[1], m[2], m[3] or ""
        prefix = (token.startswith('"') and not datatype) or datatype.endswith("dateTime")
        found = (F.col("o_kind") == "literal") & (F.col("o").startswith(text) if prefix else F.col("o") == text)
        return found & (F.col("o_lang") == lang) if lang else found

    def apart(self, r: Rows) -> DataFrame:
        """Rows whose answer is none of the variables on its way."""
        df = r.df
        if self.options.exclusions:
            for v in r.vars:
                df = df.where(F.col(v).isNull() | (F.col("x") != F.col(v)))
        return df

    def _and(self, a, b, root: bool = False) -> Rows:
        for x, y in ((a, b), (b, a)):
            if isinstance(x, str) and sexpr.kind(x) == "class":
                r = self.rows(y)
                of_class = self.graph.where((F.col("p") == TYPE) & (F.col("o") == x)).select(F.col("s").alias("x"))
                return Rows(r.df.join(of_class, "x", "left_semi"), r.vars, r.order)
        left, right = self.rows(a), self.rows(b)
        if root and not left.order and not right.order:
            # what the right side excludes concerns its own ways only: its answers are enough
            right = Rows(self.apart(right).select("x").distinct())
        if not right.vars and not right.order:  # nothing of the right side is needed but its answers
            return Rows(left.df.join(right.df.select("x"), "x", "left_semi"), left.vars, left.order)
        return Rows(left.df.join(right.df.drop("x_kind", "x_lang"), "x"), left.vars + right.vars, left.order or right.order)

    def _path(self, rel, start: DataFrame, at: str, vars_: list[str]) -> tuple[DataFrame, str, list[str]]:
        """``start`` joined along a relation path from its column ``at``: the frame, the last column, the new variables."""
        if isinstance(rel, list) and rel[0] == "JOIN":
            df, v, more = self._path(rel[1], start, at, vars_)
            return self._path(rel[2], df, v, more)
        v = self.name()
        if isinstance(rel, list):
            pairs = self.of(rel[1], v, at).drop(f"{at}_kind", f"{at}_lang", f"{at}_datatype")
            pairs = pairs.withColumn(f"{v}_datatype", F.lit(None).cast("string"))
        else:
            pairs = self.of(rel, at, v).drop(f"{v}_kind", f"{v}_lang")
        last = [c for c in start.columns if c.endswith("_datatype")]
        return start.drop(*last).join(pairs, at), v, [*vars_, v]

    def _hops(self, rel) -> list:
        """The relations of a path, each with its direction."""
        return self._hops(rel[1]) + self._hops(rel[2]) if isinstance(rel, list) and rel[0] == "JOIN" else [rel]

    def _compare(self, e) -> Rows:
        op, rel, value = e
        first, *rest = self._hops(rel)
        v = self.name()
        if isinstance(first, list):  # x is where the first hop ends
            df = self.graph.where(F.col("p") == first[1]).select(F.col("o").alias("x"), F.col("o_kind").alias("x_kind"), F.col("o_lang").alias("x_lang"), F.col("s").alias(v))
        else:
            df = self.graph.where(F.col("p") == first).select(F.col("s").alias("x"), F.lit("entity").alias("x_kind"), F.lit(None).cast("string").alias("x_lang"), F.col("o").alias(v))
        vars_ = [v]
        for hop in rest:
            df, v, vars_ = self._path(hop, df, v, vars_)
        m = re.match(r'^"?(.*?)"?(?:\^\^(.*))?$', value)
        text, datatype = m[1], m[2] or ""
        if "date" in datatype.lower() or "year" in datatype.lower() or (value.startswith('"') and re.match(r"^\d{4}(-|$)", text)):
            a, b = instant(F.col(v)), instant(F.lit(text))
        elif re.match(r"^[-+]?\d+$", text):
            a, b = F.expr(f"try_cast({v} AS DOUBLE)"), F.lit(int(text)).cast("double")
        elif re.match(r"^[-+]?[\d.]+(?:[eE][-+]?\d+)?$", text):
            a, b = F.expr(f"try_cast({v} AS DOUBLE)"), F.lit(float(text))
        else:
            a, b = F.col(v), F.lit(text)
        test = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]
        return Rows(df.where(test).select("x", "x_kind", "x_lang", *vars_), vars_)

    def _tc(self, child, rel: str, time: str) -> Rows:
        r = self.rows(child)
        lo, hi = (instant(F.lit(t)) for t in time_bounds(time, self.options.now))
        asked = r.df.select("x").distinct()  # ends of other nodes are not looked at
        start, end = (self.graph.where(F.col("p") == p).join(asked, F.col("s") == F.col("x"), "left_semi") for p in (rel, end_relation(rel)))
        if self.options.tc_form == "exists":
            df = r.df
            for found, test in ((start, instant(F.col("o")) <= hi), (end, instant(F.col("o")) >= lo)):
                # one row a node that has such an edge: whether one of them passes
                state = found.groupBy(F.col("s").alias("x")).agg(F.max(F.coalesce(test, F.lit(False))).alias("__ok"))
                df = df.join(state, "x", "left").where("__ok is null or __ok").drop("__ok")
            return Rows(df, r.vars, r.order)
        both = self.graph.where(F.col("p").isin(rel, end_relation(rel))).select(F.col("s").alias("x"), "p", instant(F.col("o")).alias("t")).join(asked, "x", "left_semi")
        first, last = F.col("p") == rel, F.col("p") == end_relation(rel)
        spans = both.groupBy("x").agg(F.count_if(first).alias("__n"), F.min(F.when(first, F.col("t"))).alias("__a"), F.count_if(last).alias("__m"), F.max(F.when(last, F.col("t"))).alias("__b"))
        begun = F.coalesce(F.col("__n"), F.lit(0)) == 0
        open_ = F.coalesce(F.col("__m"), F.lit(0)) == 0
        ok = (begun | F.coalesce(F.col("__a") <= hi, F.lit(False))) & (open_ | F.coalesce(F.col("__b") >= lo, F.lit(False)))
        return Rows(r.df.join(spans, "x", "left").where(ok).drop("__n", "__a", "__m", "__b"), r.vars, r.order)

    def _arg(self, op: str, child, rel, root: bool = False) -> Rows:
        r = self.rows(child)
        df, v, vars_ = self._path(rel, r.df, "x", r.vars)
        r = Rows(df.select("x", "x_kind", "x_lang", *vars_), vars_, (v, op))
        return r if root or self.options.global_limit else Rows(self.best(r.df, v, op))

    @staticmethod
    def best(df: DataFrame, v: str, op: str) -> DataFrame:
        """The row set of the one x with the extreme value: numbers as numbers, all else as text."""
        key = F.struct(F.expr(f"try_cast({v} AS DOUBLE)").alias("n"), F.col(v).alias("t"))
        agg = (F.max if op == "ARGMAX" else F.min)(key)
        g = df.groupBy("x", "x_kind", "x_lang").agg(agg.alias("k"))
        by = [F.col("k.n").desc_nulls_last(), F.col("k.t").desc()] if op == "ARGMAX" else [F.col("k.n").asc_nulls_last(), F.col("k.t").asc()]
        return g.orderBy(*by, "x").limit(1).select("x", "x_kind", "x_lang")

    def answers(self, e) -> DataFrame:
        op = e[0] if isinstance(e, list) else None
        if op == "COUNT":
            return self.answers(e[1]).agg(F.count_distinct("x").alias("x"))
        r = self._arg(op, e[1], e[2], root=True) if op in ("ARGMAX", "ARGMIN") else self._and(e[1], e[2], root=self.options.dialect != "cwq") if op == "AND" else self.rows(e)
        df = self.apart(r)
        if self.options.exclusions:
            if self.options.language:
                spoken = F.coalesce(F.col("x_lang"), F.lit(""))
                df = df.where((F.col("x_kind") != "literal") | (spoken == "") | spoken.startswith(self.options.language))
            named = sexpr.entities(e)
            if named and not (self.options.dialect == "cwq" and r.vars):
                df = df.where(~F.col("x").isin(named))
        if r.order:
            df = self.best(df, *r.order)
        return df.select("x").distinct()


def compile_expr(graph: DataFrame, text, options: Options = Options()) -> DataFrame:
    """The answers of an expression (text or nested lists) as a DataFrame of one column, x."""
    e = sexpr.read(text) if isinstance(text, str) else text
    return Compiler(graph, options).answers(e)


def first_executable(graph: DataFrame, beams: list[str], options: Options = Options(), fetch: int | None = 10_000) -> tuple[str | None, list]:
    """The first of one question's ranked expressions that has answers, and the answers: the first ``fetch`` in order, or all
    of them. A count is an answer, also of none."""
    for text in beams:
        if sexpr.valid(text):
            rows = compile_expr(graph, text, options).sort("x")
            got = [r["x"] for r in (rows.limit(fetch) if fetch is not None else rows).collect()]
            if got:
                return text, got
    return None, []
