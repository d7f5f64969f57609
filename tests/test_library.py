import gzip
import json

import pytest
from pyspark.sql import functions as F

from chronolattice.functions import text as fx
from chronolattice.operators import dataset as ds
from chronolattice.operators import evaluate as ev
from chronolattice.operators import grounding as gr
from chronolattice.operators import training as tr
from chronolattice.sources import formats
from chronolattice.streaming import events as stream


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.mark.parametrize(
    ("question", "want"),
    [("What was the first film?", "first"), ("Latest album", "last"), ("Who ruled before him?", "before"), ("who came since then", "after"), ("who led in 1999", "during"), ("watch it", "during"), ("team 1999", "explicit_date"), ("what year was it", "temporal_answer"), ("hello", "unknown")],
)
def test_question_types(spark, question, want):
    assert one(spark, x=fx.question_type(F.lit(question))).x == want


def test_answer_matching(spark):
    m = lambda p, g: one(spark, x=fx.answers_match(F.array(*map(F.lit, p)), F.array(*map(F.lit, g)))).x
    assert m(["2010"], ["2010-01-01"]) and m(["ns:m.02gjb"], ["m.02gjb"]) and m([" Los Angeles "], ["los angeles"])
    assert not m(["2011"], ["2010-01-01"]) and not m(["m.1"], ["m.2"])


def test_scores(spark):
    f = lambda p, g: one(spark, x=fx.f1(F.array(*map(F.lit, p)).cast("array<string>"), F.array(*map(F.lit, g)).cast("array<string>"))).x
    assert f([], []) == 1.0 and f(["a"], []) == 0.0 and f(["A", "b"], ["a"]) == pytest.approx(2 / 3)


def test_hash_is_stable(spark):
    r = one(spark, a=fx.row_hash(F.lit("x"), F.lit(None).cast("string")), b=fx.row_hash(F.lit("x"), F.lit("")))
    assert r.a == r.b and len(r.a) == 12


def test_relation_words(spark):
    t = lambda r: one(spark, x=fx.temporal_relation(F.lit(r))).x
    assert t("a.b.from") and t("a.b.start_date") and not t("people.customer.tomato")


@pytest.mark.parametrize(("raw", "want"), [("1996-01-01", "1996"), ("1906-04-18 05:12:00", "1906-04-18"), ("1906-04-18", "1906-04-18"), ("x", "x")])
def test_dates_of_a_store(spark, raw, want):
    assert one(spark, x=fx.date_answer(F.lit(raw))).x == want


def test_families():
    with pytest.raises(ValueError):
        ds.Family("x", "nodots", "a.b.c", "a.b.d")
    with pytest.raises(ValueError):
        ds.Family("x", "a.b.c", "a.b.c", "a.b.d", templates=("before",))
    f = ds.Family("x", "a.b.c", "a.b.c", "a.b.d")
    with pytest.raises(ValueError):
        ds.families(f, f)


def test_training_examples(spark):
    cols = "sample_id string, question string, s_expression string, split string, source string, temporal_type string"
    human = spark.createDataFrame([("h1", "Q", "(JOIN a.b.c m.1)", "train", "human", "first"), ("h2", "Q2", "null", "train", "human", "first")], cols)
    synth = spark.createDataFrame([(f"s{i}", "Q" if i == 0 else f"Q{i}", "(JOIN a.b.c m.1)", "train", "synthetic", "last") for i in range(5)], cols)
    got = sorted(r.sample_id for r in ds.training_examples(human, synth, most=2).collect())
    assert got == ["h1", "s1", "s2"]


def test_standardise(spark):
    merged = spark.createDataFrame([(1, "Who was first?", ["m.9"], None, ["a.b.from"], ["m.1"])], "ID int, question string, answer array<string>, normed_sexpr string, relations array<string>, entities array<string>")
    origin = spark.createDataFrame([(1, None, "m.placeholder", None)], "Id int, TemporalSignalNorm string, TopicEntityMid string, Sparql string")
    r = ds.standardise(merged, origin, "train").first()
    assert (r.temporal_type, r.temporal_signal, r.topic_entity_mid) == ("first", "first", "m.1")


@pytest.mark.parametrize("form", ["lines", "list", "object"])
def test_prediction_files(spark, tmp_path, form):
    rows = [{"question": "a", "predictions": ["x", "y"]}, {"question": "b", "predictions": []}]
    text = "\n".join(map(json.dumps, rows)) if form == "lines" else json.dumps(rows, indent=1) if form == "list" else json.dumps({"1": rows[0], "2": rows[1]})
    (tmp_path / "p.json").write_text(text)
    assert sorted((r.question, r.predictions) for r in ev.load_predictions(spark, str(tmp_path / "p.json")).collect()) == [("a", ["x", "y"]), ("b", [])]


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "t.gz", "wt") as f:
        f.write('<http://rdf.freebase.com/ns/m.1>\t<http://rdf.freebase.com/ns/a.b.c>\t"12"\t.\nns:m.1\tns:a.b.d\t"hi"@en\t.\nm.1\ta.b.e\tm.2\t.\n')
    got = formats.retype(formats.read_triple_text(spark, str(tmp_path / "t.gz")), spark.createDataFrame([("a.b.c", "integer")], "p string, datatype string"))
    assert sorted(tuple(r) for r in got.collect()) == [("m.1", "a.b.c", "12", "literal", "integer", None), ("m.1", "a.b.d", "hi", "literal", None, "en"), ("m.1", "a.b.e", "m.2", "entity", None, None)]
    (tmp_path / "d.txt").write_text("/a/b\t0\nbad line\n/c/d\t7\n")
    assert sorted(map(tuple, formats.read_dictionary(spark, str(tmp_path / "d.txt"), "path", "rel").collect())) == [("/a/b", 0), ("/c/d", 7)]
    (tmp_path / "l.csv").write_text("m.1,Ootaki\\, Yuuko,3\n")
    assert formats.read_labels(spark, str(tmp_path / "l.csv")).first().label == "Ootaki, Yuuko"


def test_expand_limits(spark):
    s = spark.createDataFrame([(1, [["a", "b"], ["c"], ["d", "e", "f"]])], "qid int, candidates array<array<string>>")
    assert [tuple(r.choice) for r in gr.expand(s, 4).orderBy("n").collect()] == [("a", "c", "d"), ("a", "c", "e"), ("a", "c", "f"), ("b", "c", "d")]


def test_maximal_sets(spark):
    rows = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 3, 4)], "qid int, start int, end int")
    assert sorted(r.spans for r in gr.maximal_sets(rows).collect()) == ["0-2 3-4", "1-3 3-4"]


def test_overlap_metrics(spark):
    r = ev.text_overlap(spark.createDataFrame([("a b c d", "a b c d"), ("a b", "c")], "label string, predict string")).collect()
    assert (r[0].rouge1, r[0].rouge2, r[0].rougel) == (100.0, 100.0, 100.0) and r[0].bleu4 == pytest.approx(100) and r[1].rouge1 == 0.0


def test_smoothing(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "g int, step int, v double")
    got = [r.smoothed for r in tr.smoothed(rows, "g", "step", "v").orderBy("step").collect()]
    import math

    w, last, want = 1.8 * (1 / (1 + math.exp(-0.2)) - 0.5), 0.0, []
    for v in range(4):
        last = last * w + (1 - w) * v
        want.append(round(last, 6))
    assert got == want


def test_stream(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    counts = stream.windowed_counts(stream.read(spark, str(tmp_path / "in"), df.schema))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == df.count()
    assert stream.as_triples(df).count() == 3 * df.count()


def test_report(spark):
    assert "| a | 1 |" in ev.report(spark.createDataFrame([("a", 1)], "key string, n int"), "T")


def test_places_and_packs(spark):
    from chronolattice.operators import training as tr
    from chronolattice.sources.storage import placed

    rows = spark.createDataFrame([(i, list(range(i * 10, i * 10 + i % 4))) for i in range(200)], "k int, ids array<int>").repartition(7)
    flat = [x for i in range(200) for x in range(i * 10, i * 10 + i % 4)]
    at = {r.k: r.at for r in placed(rows, F.size("ids"), "at", F.col("k")).collect()}
    assert at == {i: sum(j % 4 for j in range(i)) for i in range(200)}
    for n in (1, 2, 7, 64):
        got = {r.block: list(r.ids) for r in tr.pack(rows, n, F.col("k")).collect()}
        assert got == {b: flat[b * n : b * n + n] for b in range(len(flat) // n)}


def test_files_of_stages(spark, tmp_path):
    from chronolattice.sources.formats import load_if_there, write_stages

    paths = write_stages({"facts": spark.range(3), "failed": spark.range(0)}, str(tmp_path))
    got = load_if_there(spark, {"facts": (paths[0], spark.read.json), "none": (str(tmp_path / "none"), spark.read.json)})
    assert got["facts"].count() == 3 and got["none"] is None


def test_many_spans(spark):
    from chronolattice.operators.grounding import maximal_sets

    linked = spark.createDataFrame([(1, i, i + 1) for i in range(40)] + [(1, 0, 40), (2, 0, 2), (2, 1, 3), (2, 2, 4), (2, 5, 6)], "qid int, start int, end int")
    got = sorted((r.qid, r.spans) for r in maximal_sets(linked).collect())
    assert got == sorted([(1, " ".join(f"{i}-{i + 1}" for i in range(40))), (1, "0-40"), (2, "0-2 2-4 5-6"), (2, "1-3 5-6")])
