"""Families, templates and builders by name, as functions of SQL.

What is registered is callable in the session at once: a family as a table function of its facts between two years, a template as a
function of its slots, a builder as a function of a fact's relations and date; ``mined`` and ``asked`` take a family's name.
These functions are SQL themselves: the optimizer sees through them, and a constant name leaves the branch of its
family alone. ``with_questions`` adds a column for each named template to any table that has the slots: its schema follows
its arguments.

Names are letters, digits and underscores. A name that is registered again stands for the new thing from then on. An unknown family has
no facts; an unknown template, or a table without the slots, is an error when a statement is analysed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from chronolattice.functions import text as fx
from chronolattice.operators.dataset import Family, mine_facts
from chronolattice.sources.kg import cvt_facts

FACT = ("fact_id", "fact_relation_family", "topic_mid", "topic_label", "answer_mid", "answer_label", "answer_relation", "retrieved_from_relation", "temporal_start", "temporal_end")
SLOTS = ("role", "topic_label", "answer_label", "year")
#: The builders that are there from the beginning, over answer_relation, topic_mid, time_relation and date.
BUILDERS = {
    "join": "format_string('(JOIN (R %s) %s)', answer_relation, topic_mid)",
    "tc": "format_string('(TC (JOIN (R %s) %s) %s %s)', answer_relation, topic_mid, time_relation, date)",
    "argmin": "format_string('(ARGMIN (JOIN (R %s) %s) %s)', answer_relation, topic_mid, time_relation)",
    "argmax": "format_string('(ARGMAX (JOIN (R %s) %s) %s)', answer_relation, topic_mid, time_relation)",
}


def _name(name: str) -> str:
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"{name!r} is no name")
    return name


def _text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Registry:
    """The functions of one session over one graph, whose facts ``facts_of`` reads."""

    def __init__(self, spark: SparkSession, graph: DataFrame, facts_of: Callable[..., DataFrame] = cvt_facts):
        self.spark, self.graph, self.facts_of = spark, graph, facts_of
        self.families: dict[str, Family] = {}
        self.templates: dict[str, tuple[str, str, str]] = {}
        for name, body in BUILDERS.items():
            self.builder(name, body)
        self._tables()

    def _define(self, name: str, arguments: str, returns: str, body: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")

    def builder(self, name: str, body: str) -> None:
        """``build_<name>(answer_relation, topic_mid, time_relation, date)``: an expression; ``body`` is SQL over these names."""
        self._define(f"build_{_name(name)}", "answer_relation STRING, topic_mid STRING, time_relation STRING, date STRING", "STRING", body)

    def template(self, name: str, kind: str, words: str, builder: str) -> None:
        """``ask_<name>(role, topic_label, answer_label, year)``: a question. Families ask it whose templates have its ``kind``."""
        body = _text(words)
        for slot in SLOTS:
            body = f"replace({body}, '{{{slot}}}', {slot})"
        self._define(f"ask_{_name(name)}", ", ".join(f"{s} STRING" for s in SLOTS), "STRING", body)
        self.templates[name] = kind, words, _name(builder)
        self._tables()

    def family(self, f: Family) -> None:
        """``mined_<family>(low, high)``: its facts whose years, where there are any, lie between two."""
        view = f"__mined_{_name(f.family)}"
        year = lambda c: fx.year_of(F.col(c))
        facts = mine_facts(self.graph, (f,), low=0, high=9999, facts_of=self.facts_of).select(*FACT, F.lit(f.role).alias("role"), year("temporal_start").alias("start_year"), year("temporal_end").alias("end_year"))
        facts.createOrReplaceTempView(view)
        self.families[f.family] = f
        self._define(f"mined_{f.family}", "low INT, high INT", f"TABLE ({', '.join(f'{c} STRING' for c in FACT)})", f"SELECT {', '.join(FACT)} FROM {view} WHERE {self._between()}")
        self._tables()

    @staticmethod
    def _between() -> str:
        return "(start_year IS NULL OR start_year BETWEEN low AND high) AND (end_year IS NULL OR end_year BETWEEN low AND high)"

    def _tables(self) -> None:
        columns = ", ".join(f"{c} STRING" for c in FACT)
        none = f"SELECT {', '.join(f'CAST(NULL AS STRING) {c}' for c in FACT)} WHERE false"
        mined = [f"SELECT {', '.join(FACT)} FROM __mined_{n} WHERE family = '{n}' AND {self._between()}" for n in self.families]
        self._define("mined", "family STRING, low INT, high INT", f"TABLE ({columns})", " UNION ALL ".join(mined) or none)
        asked = []
        for n, f in self.families.items():
            for t, (kind, _, builder) in self.templates.items():
                if kind in f.templates:
                    slots = "role, topic_label, answer_label, coalesce(CAST(start_year AS STRING), '2000')"
                    date = "coalesce(nullif(temporal_start, ''), nullif(temporal_end, ''), '2000')"
                    asked.append(f"SELECT fact_id, '{t}' template_id, ask_{t}({slots}) question, build_{builder}(answer_relation, topic_mid, retrieved_from_relation, {date}) s_expression FROM __mined_{n} WHERE family = '{n}' AND {self._between()}")
        none = "SELECT CAST(NULL AS STRING) fact_id, CAST(NULL AS STRING) template_id, CAST(NULL AS STRING) question, CAST(NULL AS STRING) s_expression WHERE false"
        self._define("asked", "family STRING, low INT, high INT", "TABLE (fact_id STRING, template_id STRING, question STRING, s_expression STRING)", " UNION ALL ".join(asked) or none)
        self.spark.udtf.register("with_questions", _with_questions({n: w for n, (_, w, _) in self.templates.items()}))


def _with_questions(words: dict[str, str]):
    class WithQuestions:
        def __init__(self):
            self.names = None

        @staticmethod
        def analyze(rows: AnalyzeArgument, templates: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or templates.value is None:
                raise ValueError("with_questions takes a table and the names of templates")
            names = [n.strip() for n in templates.value.split(",") if n.strip()]
            if missing := [n for n in names if n not in words]:
                raise ValueError(f"no template {', '.join(missing)}")
            have = {f.name for f in rows.dataType.fields}
            if lack := [s for n in names for s in SLOTS if "{" + s + "}" in words[n] and s not in have]:
                raise ValueError(f"the table has no column {', '.join(dict.fromkeys(lack))}")
            return AnalyzeResult(T.StructType([*rows.dataType.fields, *[T.StructField(n, T.StringType()) for n in names]]))

        def eval(self, row, templates: str):
            values = row.asDict()
            out = []
            for n in (n.strip() for n in templates.split(",") if n.strip()):
                text = words[n]
                for s in SLOTS:
                    if "{" + s + "}" in text:
                        text = None if values[s] is None else text.replace("{" + s + "}", str(values[s]))
                    if text is None:
                        break
                out.append(text)
            yield (*row, *out)

    return udtf(WithQuestions)
