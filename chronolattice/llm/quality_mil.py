"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded (character-class pairs, hashed words and a few
ratios, then one tanh layer); attention weights are softmax(w . (tanh(V h) * sigmoid(U h))) over a document's
passages; the score is a logistic function of the weighted sum. Only documents have labels: which passages matter
is learned with the rest.

Training takes at most ``sample`` labelled documents of each class (those with the smallest hash of their id) of at most
``sample_passages`` passages each, on the driver, by Adam on whole batches; this bounds what is collected. Scoring reads all
of every text.

Never inputs of a score: labels, language, source, id. Held-out rows (crc32 of the id as text, modulo 3, is 1) are
never trained on.

Defined results: a null or empty text is one passage without anything in it; a null id counts as empty text in the
hash (not held out); several labels of an id: each labelled row counts; null labels are left out; without labels of both
classes the score is the share of label 1 (0.5 without any); other columns are passed over (``score`` and ``keep_good`` drop
those named like a result); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolattice.llm import grams as g
from chronolattice.llm.contexts import batch_of

PASSAGE, CLASSES, WORDS, HIDDEN = 600, 16, 256, 16
DIMS = CLASSES * CLASSES + WORDS + 4


def _classes() -> np.ndarray:
    t = np.full(256, 9, np.uint8)  # other signs
    t[128:192], t[192:] = 14, 15
    for i, chars in enumerate(("bcdfghjklmnpqrstvwxyz", "aeiou", "BCDFGHJKLMNPQRSTVWXYZ", "AEIOU", "0123456789", " \t\r\v\f", "\n", ".", ",;:")):
        t[[ord(c) for c in chars]] = i
    for i, chars in ((10, "!?"), (11, "|"), (12, "#*$%&<>"), (13, "'\"()-")):
        t[[ord(c) for c in chars]] = i
    return t


CLASS = _classes()


def encode(data: np.ndarray, at: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of rows [a, b), and the number of passages of each row (1 at least)."""
    lo, hi = int(at[a]), int(at[b])
    size = np.diff(at[a : b + 1])
    per = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(per) - per
    row = np.repeat(np.arange(b - a), size)
    where = np.arange(hi - lo) - np.repeat(at[a:b] - lo, size)
    where //= PASSAGE
    where += first[row]
    n = int(per.sum())
    x = np.zeros((n, DIMS), np.float32)
    total = np.bincount(where, minlength=n).astype(np.float32)
    if hi - lo > 1:
        c = CLASS[data[lo:hi]].astype(np.int64)
        pair = c[:-1] * CLASSES + c[1:]
        same = row[1:] == row[:-1]
        k = CLASSES * CLASSES
        x[:, :k] = np.bincount(where[:-1][same] * k + pair[same], minlength=n * k).reshape(n, k)
        starts, ends, counts = g.words(data, at, a, b)
        if len(starts):
            name = g.names(g.prefix(g.LOWER[data[lo:hi]]), starts - lo, ends - lo)
            home = where[starts - lo]
            x[:, k : k + WORDS] = np.bincount(home * WORDS + (name >> g.U(56)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
            words = np.bincount(home, minlength=n).astype(np.float32)
            again = np.concatenate(([False], (name[1:] == name[:-1]) & (home[1:] == home[:-1])))
            order = np.lexsort((name, home))
            new = np.concatenate(([True], (name[order][1:] != name[order][:-1]) | (home[order][1:] != home[order][:-1])))
            kinds = np.bincount(home[order][new], minlength=n).astype(np.float32)
            x[:, :k] /= np.maximum(total, 1)[:, None]
            x[:, k : k + WORDS] /= np.maximum(words, 1)[:, None]
            x[:, -4] = np.bincount(home[again], minlength=n) / np.maximum(words, 1)
            x[:, -3] = kinds / np.maximum(words, 1)
            x[:, -2] = np.log1p(words)
        else:
            x[:, :k] /= np.maximum(total, 1)[:, None]
    x[:, -1] = np.log1p(total)
    return np.sqrt(x), per


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray] | None
    prior: float

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention logits and contributions of encoded passages."""
        h = np.tanh(((x - self.mean) * self.scale) @ self.w["E"] + self.w["e"])
        gate = np.tanh(h @ self.w["V"]) / (1 + np.exp(-(h @ self.w["U"])))
        return gate @ self.w["a"], h @ self.w["c"]

    def score(self, x: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents, and the place of the passage that weighs most in each."""
        if self.w is None:
            return np.full(len(per), self.prior), np.zeros(len(per), np.int64)
        logit, part = self.passages(x)
        first = np.cumsum(per) - per
        top = np.maximum.reduceat(logit, first)
        e = np.exp(logit - np.repeat(top, per))
        s = np.add.reduceat(e * part, first) / np.add.reduceat(e, first) + self.w["b"]
        best = np.array([int(np.argmax(logit[f : f + p])) for f, p in zip(first.tolist(), per.tolist(), strict=True)])
        return 1 / (1 + np.exp(-np.clip(s.astype(np.float64).ravel(), -30, 30))), best


def fit(x: np.ndarray, per: np.ndarray, y: np.ndarray, *, steps: int = 150, rate: float = 0.02, decay: float = 1e-3, seed: int = 3) -> Model:
    """Gated attention, trained by Adam; classes weigh the same."""
    y = y.astype(np.float32)
    prior = float(y.mean()) if len(y) else 0.5
    mean, std = (x.mean(0), x.std(0)) if len(x) else (np.zeros(DIMS, np.float32), np.ones(DIMS, np.float32))
    scale = (1 / np.maximum(std, 0.02)).astype(np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model(mean, scale, None, prior)
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    w = {"E": draw(DIMS, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, HIDDEN), "U": draw(HIDDEN, HIDDEN), "a": draw(HIDDEN), "c": draw(HIDDEN), "b": np.zeros(1, np.float32)}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    z = np.clip((x - mean) * scale, -8, 8)
    first, doc = np.cumsum(per) - per, np.repeat(np.arange(len(per)), per)
    weight = np.where(y > 0.5, 0.5 / max(prior, 1e-6), 0.5 / max(1 - prior, 1e-6)).astype(np.float32) / len(y)
    for t in range(1, steps + 1):
        h = np.tanh(z @ w["E"] + w["e"])
        tv, su = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        logit, part = (tv * su) @ w["a"], h @ w["c"]
        e = np.exp(logit - np.maximum.reduceat(logit, first)[doc])
        att = e / np.add.reduceat(e, first)[doc]
        s = np.add.reduceat(att * part, first) + w["b"]
        ds = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * weight
        d_part = att * ds[doc]
        d_logit = d_part * (part - (s - w["b"])[doc])
        d_gate = d_logit[:, None] * w["a"]
        d_v, d_u = d_gate * su * (1 - tv * tv), d_gate * tv * su * (1 - su)
        d_h = d_part[:, None] * w["c"] + d_v @ w["V"].T + d_u @ w["U"].T
        d_h *= 1 - h * h
        grad = {"E": z.T @ d_h, "e": d_h.sum(0), "V": h.T @ d_v, "U": h.T @ d_u, "a": (tv * su).T @ d_logit, "c": h.T @ d_part, "b": ds.sum(keepdims=True)}
        for k, p in w.items():
            q = grad[k] + (decay * p if k in "EVU" else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.99 * v[k] + 0.01 * q * q
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return Model(mean, scale, w, prior)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = g.texts(batch.column(0))
            for a, b in g.chunks(at):
                x, per = encode(data, at, a, b)
                cut = np.cumsum(per)
                rows = [r.astype(np.float16).tobytes() for r in np.split(x, cut[:-1])]
                yield batch_of("x binary, y int", b - a, x=pa.array(rows, pa.binary()), y=batch.column(1).slice(a, b - a))

    return docs.mapInArrow(run, "x binary, y int")


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = 1500, sample_passages: int = 64) -> Model:
    """Fits on at most ``sample`` documents of each label that are not held out."""
    lab = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where(~held_out(F.col("i")) & F.col("y").isin(0, 1))
    order = F.xxhash64(F.col("i").cast("string"))
    picked = lab.where("y = 1").orderBy(order, "i").limit(sample).unionByName(lab.where("y = 0").orderBy(order, "i").limit(sample))
    t = F.coalesce(F.col(text), F.lit(""))
    both = docs.select(F.col(doc_id).alias("i"), t.alias("t")).where(F.octet_length("t") <= PASSAGE * sample_passages).join(picked, "i").select("t", "y", "i")
    rows = _features(both.repartition(8, "i").sortWithinPartitions("i", "y", "t").select("t", "y")).collect()
    if not rows:
        return fit(np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.zeros(0))
    bags = sorted((bytes(r["x"]), r["y"]) for r in rows)
    per = np.array([len(x) // (2 * DIMS) for x, _ in bags])
    x = np.frombuffer(b"".join(x for x, _ in bags), np.float16).reshape(-1, DIMS).astype(np.float32)
    return fit(x, per, np.array([y for _, y in bags]))


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, with score, n_passages and top_passage (the one of most attention, from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(c for c in keep if c not in ("score", "n_passages", "top_passage"))
    fields = [f for c in keep for f in docs.schema if f.name == c]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double", "n_passages long", "top_passage long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = g.texts(batch.column(0))
            s, n, top = [], [], []
            for a, b in g.chunks(at, g.CHUNK // 2):
                x, per = encode(data, at, a, b)
                x, p = (np.clip((x - shared.value.mean) * shared.value.scale, -8, 8) / shared.value.scale + shared.value.mean, per)
                one, best = shared.value.score(x, p)
                s.append(one), n.append(p), top.append(best)
            cols = [np.round(np.concatenate(s), 6), np.concatenate(n), np.concatenate(top)] if s else [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(1 + i) for i in range(len(keep))] + [pa.array(c) for c in cols], [*keep, "score", "n_passages", "top_passage"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("__t"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, out)


def classify_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = 1500) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, top_passage) of every row."""
    model = train(docs, labels, text=text, doc_id=doc_id, label=label, sample=sample)
    s = score(docs.withColumnRenamed(doc_id, "doc_id") if doc_id != "doc_id" else docs, model, text=text)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_passage")


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = 1500) -> DataFrame:
    """``docs``, all its columns, without the rows that the classifier rejects; they are scored where they are read."""
    model = train(docs, labels, text=text, doc_id=doc_id, label=label, sample=sample)
    # columns go by number meanwhile, so that none of theirs meets one of the score's
    held = [f"__c{i}" for i in range(len(docs.columns))]
    rows = score(docs.toDF(*held), model, text=held[docs.columns.index(text)], keep=tuple(held))
    return rows.where("score >= 0.5").select(*held).toDF(*docs.columns)
