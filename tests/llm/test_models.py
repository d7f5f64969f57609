"""The classifier's scores and the robust estimates recomputed plainly; the pipeline on odd tables."""

import math
import zlib

import numpy as np
import pytest
from test_edges import COLUMNS, TEXTS, prose

from chronolattice.llm import outliers
from chronolattice.llm.outliers import chi_square_tail, quality_rules
from chronolattice.llm.quality_mil import classify_quality, encode, train
from chronolattice.llm import grams as g

SF = "/root/testdata/sf0.001"


def test_scores_recomputed(spark):
    import pyarrow as pa

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train(docs, labels)
    w = {k: v.astype(float) for k, v in model.w.items()}
    some = [(r.doc_id, r.text or "") for r in docs.where("doc_id % 40 = 0").collect()]
    got = {r.doc_id: r for r in classify_quality(docs, labels).collect()}
    for i, t in some:
        data, at = g.texts(pa.array([t]))
        x, per = encode(data, at, 0, 1)
        logits, parts = [], []
        for row in x.astype(float):  # one passage after another
            z = np.clip((row - model.mean) * model.scale, -8, 8)
            h = np.tanh(z @ w["E"] + w["e"])
            logits.append(float((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"]))
            parts.append(float(h @ w["c"]))
        e = [math.exp(v - max(logits)) for v in logits]
        s = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(e, parts)) / sum(e) + float(w["b"][0]))))
        assert len(logits) == got[i].n_passages and got[i].score == pytest.approx(s, abs=2e-4)
    # labels of held-out rows are not looked at, and what was learned holds on them
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.quality is not None]
    right = [got[r.doc_id].predicted == r.quality for r in held if r.doc_id in got]
    assert len(right) > 20 and sum(right) > 0.9 * len(right)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    other = train(docs, turned)
    assert all((other.w[k] == model.w[k]).all() for k in model.w)


def plain_mcd(x, share=0.75, steps=5, floor=0.15):
    """The estimate of one group, by the definition: start from medians, then keep the nearest share again and again."""
    scale, n = outliers.SCALE, len(x)
    step = scale // 20

    def at(col, q):
        v = np.sort(np.floor(col / step))
        return (v[max(0, math.ceil(q * n) - 1)] + 0.5) * step

    m = np.array([at(x[:, i], 0.5) for i in range(x.shape[1])])
    l = np.diag([max((at(x[:, i], 0.75) - at(x[:, i], 0.25)) / 1.349, 0.1 * scale) for i in range(x.shape[1])])  # noqa: E741
    d2 = lambda rows: (np.linalg.solve(l, (rows - m).T) ** 2).sum(axis=0)
    for _ in range(steps):
        bins = np.floor(np.log(d2(x) + 1e-6) * outliers.BINS)
        inner = x[bins <= np.sort(bins)[max(0, math.ceil(share * n) - 1)]]
        m = inner.mean(axis=0)
        l = np.linalg.cholesky((inner - m).T @ (inner - m) / len(inner) + np.eye(x.shape[1]) * (floor * scale) ** 2)  # noqa: E741
    return d2


def test_verdict_recomputed(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(420):
        lang, source = ("en", "a") if i < 150 else ("en", "b") if i < 290 else ("en", None) if i < 300 else ("fr", f"s{i % 9}") if i < 400 else ("de", "x")
        t = prose(i, int(rng.integers(60, 160)))
        t = t.replace(" ", " # $ ") if i % 37 == 0 else "\n".join([t] * 3) if i % 41 == 0 else t
        rows.append((i, t, lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    stats = outliers.vectors(outliers.text_statistics(docs, "text")).select("doc_id", "x0", "x1", "x2", "x3", "x4").collect()
    x = {r.doc_id: np.array([r.x0, r.x1, r.x2, r.x3, r.x4], float) for r in stats}
    good = [r for r in rows if not got[r[0]].base_failed]
    cutoff = chi_square_tail(5, 1e-7) * 9
    size = lambda *k: sum(r[2:] == k for r in good)
    judged = 0
    for lang, source in {r[2:] for r in rows}:
        if size(lang, source) >= 50:
            pool = [r for r in good if r[2:] == (lang, source)]
        elif sum(r[2] == lang for r in good) >= 50:
            pool = [r for r in good if r[2] == lang]
        else:
            pool = good
        d2 = plain_mcd(np.array([x[r[0]] for r in pool]))
        for r in rows:
            if r[2:] == (lang, source):
                v = float(d2(x[r[0]][None])[0])
                assert got[r[0]].distance == pytest.approx(math.sqrt(v), abs=2e-3)
                assert got[r[0]].kept == (not got[r[0]].base_failed and v <= cutoff)
                judged += 1
    assert judged == len(rows) and 0 < sum(not r.kept and not r.base_failed for r in got.values()) < 60


def test_pipeline_on_odd_tables(spark):
    import corpus_pipeline

    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else f"s{n % 3}", None, 3, 0.1, "n", "x", "d", "t", 5, "g", "m", "k", 1) for n, (i, t) in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for table in (docs, docs.limit(0)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, SF)
            if n < 4:
                assert out.columns == docs.columns
                table = spark.createDataFrame(out.collect(), docs.schema)
        kept = table.count()
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == kept
        place = 0
        for r in sorted(out.collect(), key=lambda r: r.start):
            assert r.start == place
            place += r.n_tokens
