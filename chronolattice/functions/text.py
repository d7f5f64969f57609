"""Column functions over questions, dates, answers and expressions. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The time signals looked for in questions, in the order in which they are tried.
SIGNALS = r"(?i)(\bbefore\b|\bafter\b|\bduring\b|\bwhen\b|\bfirst\b|\blast\b|\blatest\b|\bearli(?:est|er)\b|\bmost recent\b|\bat the time\b|\bby \d{4}\b|\bin \d{4}\b|\bsince \d{4}\b|\buntil \d{4}\b|\d{4})"
#: What makes a question temporal in evaluations.
TEMPORAL = r"(?i)\b(before|after|during|when|first|last|latest|earliest|most recent|at the time|\d{4})\b"
YEAR = r"\b(1[0-9]{3}|20[0-9]{2})\b"
NAMESPACE = r"^(?:http://rdf\.freebase\.com/ns/|fb:|ns:)"
#: Fixed values: (type, pattern) pairs, tried in order; DURING's first rule needs a year too.
TYPES = (
    ("first", r"argmin|\bfirst\b|\bearliest\b", False),
    ("last", r"argmax|\blast\b|\blatest\b|\bmost recent\b", False),
    ("before", r"\bbefore\b", False),
    ("after", r"\bafter\b|\bsince\b", False),
    ("during", r"\bduring\b|\bwhen\b|\bin\b", True),
    ("during", r"tc|\bduring\b|\bwhen\b", False),
    ("explicit_date", YEAR, False),
    ("temporal_answer", r"\bwhen did\b|\bwhat year\b|\bwhat date\b", False),
)
#: What a text has to contain for a pattern of TYPES to be in it: looked for first, as it costs far less.
WORDS = {
    r"argmin|\bfirst\b|\bearliest\b": ("argmin", "first", "earliest"), r"argmax|\blast\b|\blatest\b|\bmost recent\b": ("argmax", "last", "latest", "most recent"), r"\bbefore\b": ("before",), r"\bafter\b|\bsince\b": ("after", "since"),
    r"\bduring\b|\bwhen\b|\bin\b": ("in", "when"), r"tc|\bduring\b|\bwhen\b": ("tc", "during", "when"), r"\bwhen did\b|\bwhat year\b|\bwhat date\b": ("when did", "what year", "what date"),
}


def temporal_signals(q: Column) -> Column:
    return F.regexp_extract_all(q, F.lit(SIGNALS), F.lit(0))


def is_temporal(q: Column) -> Column:
    return q.rlike(TEMPORAL)


def question_type(*parts: Column) -> Column:
    """The type of a question by the first rule that its text and annotations meet."""
    text = F.lower(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))
    out = None
    for name, pattern, dated in TYPES:
        test = text.rlike(pattern) & text.rlike(YEAR) if dated else text.rlike(pattern)
        test = reduce(lambda a, b: a | b, [text.contains(w) for w in WORDS[pattern]]) & test if pattern in WORDS else test
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def safe_signal(annotated: Column, question: Column) -> Column:
    q = F.lower(question)
    has = lambda *w: reduce(lambda a, b: a | b, [q.contains(x) for x in w])
    guess = F.when(has("before"), "before").when(has("after"), "after").when(has("first", "earliest"), "first").when(has("last", "latest"), "last").otherwise("during")
    return F.coalesce(F.lower(F.when(annotated != "", annotated)), guess)


def bare(v: Column) -> Column:
    """Without namespace, datatype and quotes."""
    v = F.trim(v)
    for _ in range(2):
        v = F.regexp_replace(v, NAMESPACE, "")
    return F.regexp_replace(F.regexp_replace(v, r"\^\^.*$", ""), '^"+|"+$', "")


def padded_date(v: Column) -> Column:
    """Y, Y-M or Y-M-D with two-digit months and days; anything else as it is."""
    b = bare(v)
    part = lambda i: F.regexp_extract(b, r"^(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?", i)
    two = lambda c: F.lpad(c, 2, "0")
    return F.when(part(1) == "", b).when(part(3) != "", F.concat_ws("-", part(1), two(part(2)), two(part(3)))).when(part(2) != "", F.concat_ws("-", part(1), two(part(2)))).otherwise(part(1))


def is_mid(v: Column) -> Column:
    return bare(v).rlike(r"^[mg]\.[a-zA-Z0-9_]+$")


def is_date(v: Column) -> Column:
    return bare(v).rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$")


def label_form(v: Column) -> Column:
    return F.lower(F.trim(bare(v)))


def answer_form(v: Column) -> Column:
    return F.when(is_date(v), padded_date(v)).when(is_mid(v), bare(v)).otherwise(label_form(v))


def answer_set(a: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(a, lambda x: x.isNotNull() & (F.trim(x) != "")), answer_form))


def answers_match(predicted: Column, expected: Column) -> Column:
    """Ids, dates at the year, labels or whole forms in common."""
    p, e = answer_set(predicted), answer_set(expected)
    years = lambda a: F.transform(F.filter(a, is_date), lambda x: F.substring(padded_date(x), 1, 4))
    labels = lambda a: F.transform(a, label_form)
    some = (F.size(predicted) > 0) & (F.size(expected) > 0)
    # most answers are plain ids, whose forms are themselves: one pattern over an array's text tells so, and only others are taken apart
    joined = lambda a: F.array_join(a, "|", "?")
    pieces = lambda a: F.split(F.lower(joined(a)), r"\|")
    plain_ids = lambda a: joined(a).rlike(r"^[mg]\.[a-zA-Z0-9_]+(\|[mg]\.[a-zA-Z0-9_]+)*\z") & (F.size(pieces(a)) == F.size(a))
    ids = F.coalesce(plain_ids(predicted) & plain_ids(expected), F.lit(False))
    same = F.coalesce(F.arrays_overlap(predicted, expected), F.lit(False))  # a text in common is a label in common, whatever it is
    return some & F.when(same, True).when(ids, F.arrays_overlap(pieces(predicted), pieces(expected))).otherwise(F.arrays_overlap(p, e) | F.arrays_overlap(years(predicted), years(expected)) | F.arrays_overlap(labels(predicted), labels(expected)))


def year_of(d: Column, low: int | None = None, high: int | None = None, default: int | None = None) -> Column:
    y = F.when(F.substring(d, 1, 4).rlike(r"^\d{4}$"), F.substring(d, 1, 4).cast("int"))
    if low is not None:
        y = F.when(y.between(low, high), y)
    return F.coalesce(y, F.lit(default)) if default is not None else y


def decade(year: Column, size: int = 10) -> Column:
    return F.coalesce(F.concat((F.floor(year / size) * size).cast("string"), F.lit("s")), F.lit("unknown"))


def row_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 12)


def plain(s: Column) -> Column:
    """Lower-cased, trimmed, without quotes around."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(s)), '^"+|"+$', ""), "^'+|'+$", "")


def plain_set(a: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), plain))


def f1(pred: Column, gold: Column) -> Column:
    """2 tp / (|P| + |G|) over sets; 1 if both are empty."""
    p, g = plain_set(pred), plain_set(gold)
    n = F.size(p) + F.size(g)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(p, g)) / n)


def hits_at_1(pred: Column, gold: Column) -> Column:
    return F.when(F.size(pred) > 0, F.array_contains(plain_set(gold), plain(F.get(pred, F.lit(0)))).cast("double")).otherwise(0.0)


def accuracy(pred: Column, gold: Column) -> Column:
    return (F.sort_array(plain_set(pred)) == F.sort_array(plain_set(gold))).cast("double")


def main_operator(sexpr: Column) -> Column:
    """The operator that an expression is filed under."""
    ops = F.regexp_extract_all(sexpr, F.lit(r"\((JOIN|ARGMAX|ARGMIN|TC|AND|R|gt|ge|lt|le|COUNT|MAX|MIN)\b"), F.lit(1))
    first = F.get(ops, F.lit(0))
    out = F.when(sexpr.isNull() | (sexpr == "") | (F.lower(sexpr) == "null"), "INVALID").when(F.size(ops) == 0, "OTHER")
    for op in ("ARGMAX", "ARGMIN", "TC", "JOIN"):
        out = out.when(F.array_contains(ops, op), op)
    return out.when(first.isin("gt", "ge", "lt", "le"), "COMPARISON").otherwise(first)


def sexpr_tokens(s: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(s, r"([()])", " $1 "), r"\s+"), lambda x: x != "")


def sexpr_entities(s: Column) -> Column:
    return F.array_distinct(F.filter(sexpr_tokens(s), lambda x: x.rlike(r"^[mg]\.")))


def sexpr_relations(s: Column) -> Column:
    return F.array_distinct(F.filter(sexpr_tokens(s), lambda x: x.rlike(r"^[a-z_0-9]+(\.[a-z_0-9]+){2,3}$")))


def slash_path(dotted: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(dotted, F.lit("."), F.lit("/")))


def dotted_path(slashed: Column) -> Column:
    return F.replace(F.regexp_replace(slashed, "^/", ""), F.lit("/"), F.lit("."))


def percentage(n: Column, d: Column) -> Column:
    return F.when(d == 0, "N/A").otherwise(F.format_string("%.1f%%", 100.0 * n / d))


def temporal_relation(r: Column) -> Column:
    """Whether a relation's parts name a time (fixed values)."""
    words = "from to start end date datetime year time".split()
    return F.arrays_overlap(F.split(F.lower(r), r"[._]"), F.array(*map(F.lit, words)))


def without_extras(name: Column) -> Column:
    """An entity's name without a leading article, number suffix and bracketed suffix."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)^the\s+", ""), r"\s+#\d+$", ""), r"\s*\([^()]*\)$", ""))


def typed_literal(token: Column) -> Column:
    """Dates get the date-time datatype."""
    day = token.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$") & (F.substring(token, 1, 4) < "3000")
    return F.when(day, F.concat(token, F.lit("^^http://www.w3.org/2001/XMLSchema#dateTime"))).otherwise(token)


def date_answer(v: Column) -> Column:
    """Undoes how a store completes partial dates."""
    return F.regexp_replace(F.regexp_replace(v, r"^(\d{4}-\d{2}-\d{2}) 05:12:00$", "$1 "), r"^(\d{4})-01-01$|^(\d{4}-\d{2}-\d{2}) $", "$1$2")


def time_constraint(s: Column) -> Column:
    """The relation and time of an expression's time constraint, or its extreme operator."""
    tc = F.regexp_extract(s, r"\(TC \(.*\) ([a-z_0-9.]+) ([^\s()]+)\)", 0)
    rel, time = (F.regexp_extract(s, r"\(TC \(.*\) ([a-z_0-9.]+) ([^\s()]+)\)", i) for i in (1, 2))
    return F.when(tc != "", F.concat_ws(" ", rel, time)).when(s.contains("(ARGMAX"), "latest").when(s.contains("(ARGMIN"), "earliest")


#: Fixed value: characters that XML does not hold.
ILLEGAL = r"[\x00-\x08\x0B-\x1F\x7F-\x84\x86-\x9F\uD800-\uDFFF\uFDD0-\uFDDF\uFFFE\uFFFF]"


def xml_clean(s: Column) -> Column:
    return F.regexp_replace(s, ILLEGAL, "")


def is_number(s: Column) -> Column:
    """Whether a text is a decimal number (a comma with a blank beside it counts as the point) or one sign that stands for one."""
    t = F.trim(F.regexp_replace(s, " , |, | ,", "."))
    return t.rlike(r"(?i)^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?(inf|infinity|nan)$") | s.rlike(r"^\p{N}$")


def role_hint(relation: Column) -> Column:
    """The last part of a relation's path, in words."""
    return F.replace(F.element_at(F.split(F.rtrim(relation, F.lit("/")), r"[./]"), -1), F.lit("_"), F.lit(" "))


def unsupported(sexpr: Column) -> Column:
    """Whether an expression holds one of the operators that are never executed, anywhere in its text (fixed values)."""
    return sexpr.rlike("OR|WITH|PLUS")


def short_relations(textual: Column) -> Column:
    """A textual form with the last part of each relation only; entities and typed literals stay."""
    tokens = F.transform(F.split(textual, " "), lambda t: F.when(t.startswith("m.") | t.contains("XMLSchema") | ~t.contains("."), t).otherwise(F.element_at(F.split(t, r"\."), -1)))
    return F.array_join(tokens, " ")


def hint_for(relation: Column, hints: tuple[str, ...] = ("from", "to", "start", "end", "date", "year", "time", "datetime")) -> Column:
    """The first hint, in order, that is a part of a relation's name (fixed values)."""
    parts = F.split(F.lower(relation), r"[._]")
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, hints)), lambda h: F.array_contains(parts, h)), F.lit(0)), F.lit("sexpr_context"))


def topic_entity(annotated: Column, entities: Column) -> Column:
    """The annotated entity unless it is a placeholder, else the first mentioned."""
    return F.coalesce(F.when((annotated != "") & (annotated != "m.placeholder"), annotated), F.get(entities, F.lit(0)), F.lit(""))


def normalised_answers(answers: Column) -> Column:
    """Strings of structs (AnswerArgument, EntityName, value): the first that is there."""
    return F.filter(F.transform(answers, lambda a: F.coalesce(a["AnswerArgument"], a["EntityName"], a["value"])), lambda x: x.isNotNull())
