"""Whitening, spelling variants and near embeddings against brute force, on odd tables."""

import collections
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from chronolattice.llm import whitening as wh
from chronolattice.llm.projection_forest import near_embeddings
from chronolattice.llm.spelling import near_pairs, spelling_variants
from chronolattice.llm.whitening import whiten

VECTORS = "vec_id long, embedding array<double>, label int, d int, x string, v string, n string, rid long, w string, count long, core string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", "v", "n", 7, "w", 3, "c") for i, v in rows], VECTORS).repartition(5)


# whitening


def test_error_free_sums():
    rng = np.random.default_rng(3)
    a, b = (rng.normal(size=50) * 10.0 ** rng.integers(-12, 12, 50) for _ in range(2))
    s, e = wh.two_sum(a, b)
    assert all(Fraction(x) + Fraction(y) == Fraction(p) + Fraction(q) for x, y, p, q in zip(a, b, s, e, strict=True))
    x = rng.normal(size=(1001, 3)) * 1e8
    h, l = wh.centred(x, (np.full(3, 1e8), np.full(3, 1e-9)))
    got = wh.outer_sum(h, l)
    exact = [[Fraction(p) + Fraction(q) for p, q in zip(r, s, strict=True)] for r, s in zip(h.tolist(), l.tolist(), strict=True)]
    for i in range(3):
        for j in range(i, 3):
            want = sum(r[i] * r[j] for r in exact)
            have = Fraction(float(got[i][0][j - i])) + Fraction(float(got[i][1][j - i]))
            assert abs(have - want) <= abs(want) * Fraction(1, 10**28)


def brute_whitening(vectors, most):
    """Covariance in whole fractions; an eigen-solve in doubles of its nearest matrix."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, int((e > d * 2.0**-52 * e[0]).sum()))
    y = np.array([[float(Fraction(n * r[i] - s[i], n)) for i in range(d)] for r in x])
    return y @ q[:, :k] / np.sqrt(e[:k]), (e / np.trace(v))[:k], [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]


@pytest.mark.parametrize("most", [2, 32])
def test_whitening(spark, most):
    rng = np.random.default_rng(1)
    good = [(rng.normal(size=6) @ rng.normal(size=(6, 6)) * 3).tolist() for _ in range(300)]
    good += [good[0], good[1]]
    ids = [None, *range(1, 300), 0, 5]
    bad = [None, [], [1.0], [1.0] * 5 + [None], [1.0] * 5 + [math.nan], [1.0] * 5 + [math.inf], [1.0] * 5 + [2.0**46], [0.5] * 7]
    got = whiten(table(spark, [*zip(ids, good, strict=True), *[(1000 + i, v) for i, v in enumerate(bad)]]), most=most).collect()
    want, share, deviation = brute_whitening(good, most)
    k = want.shape[1]
    assert len(got) == len(good) * k and {r["n"] for r in got} == {len(good)}
    assert {r["vec_id"] for r in got} == set(ids)
    assert all(abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in got)
    by = collections.defaultdict(dict)
    for r in got:
        by[r["component"]].setdefault(r["vec_id"], []).append((r["whitened"], int(r["deviation"])))
    for c in range(k):
        at = max(range(len(good)), key=lambda i: abs(want[i, c]))
        sign = math.copysign(1, by[c + 1][ids[at]][0][0] * want[at, c]) if ids.count(ids[at]) == 1 else None
        for sign in (sign,) if sign else (1, -1):
            off = max(min(abs(w - sign * want[i, c]) for w, _ in by[c + 1][ids[i]]) for i in range(len(good)))
            if off < 1e-8:
                break
        assert off < 1e-8
        assert all(deviation[i] in [v for _, v in by[c + 1][ids[i]]] for i in range(len(good)))


def test_whitening_of_little(spark):
    assert whiten(table(spark, []).limit(0)).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = whiten(table(spark, [(i, [float(i), 7.0]) for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 9 and all(abs(r["explained"] - 1) < 1e-12 for r in flat)


def test_large_deviations(spark):
    """Past a long they are whole still; past 38 digits they are null."""
    rows = [(i, [2.0**39 * (i % 7), 2.0**40 * (i % 5)]) for i in range(40)]
    want = brute_whitening([v for _, v in rows], 2)[2]
    assert {r["vec_id"]: int(r["deviation"]) for r in whiten(table(spark, rows)).collect()} == dict(enumerate(want))


# spelling


def brute_words(rows):
    count = collections.Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            count[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    return {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if apart_by_one(w, x)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = {}
    for w in n:
        r = w
        while r in form:
            r = form[r]
        out[w] = (form.get(w), r, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def misspelt(rng, word):
    k, at = rng.integers(3), rng.integers(len(word))
    return word[:at] + ("" if k == 0 else "q" if k == 1 else "q" + word[at]) + word[at + 1 :]


@pytest.mark.parametrize("large", [2, 128])
def test_spelling(spark, large):
    rng = np.random.default_rng(7)
    base = ["gouverneur", "Überraschung", "straßenbahn", "abababab", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "x" * 700, "x" * 701, "naïvement", "a×b÷cdefg"]
    texts = [" ".join(w for w in base for _ in range(30)), None, "", "short words are no use", "GOUVERNEUR gouverneur, straßenbahn"]
    texts += [" ".join(misspelt(rng, w) for w in base * 3) * 2 for _ in range(6)]
    texts += [" ".join(["gouverneur"] * 12) + " gouvernqeur" * 12 + " gouverneurs gouverneurs" + " zgouverneurs" * 2]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "w", 1, "r") for i, t in rows], "doc_id long, text string, word string, n long, d string").repartition(3)
    got = spelling_variants(docs, large=large).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute_variants(rows)
    assert len(got) == len({r["word"] for r in got})
    assert spelling_variants(docs.limit(0)).collect() == []


def test_pairs_once(spark):
    """Words of few letters share nearly all: each pair comes once a direction, whatever blocks were cut."""
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 11))) for _ in range(500)})
    got = near_pairs(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long"), large=3).collect()
    pairs = [(r["word"], r["other"]) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if apart_by_one(a, b)}
    assert all(words[r["n"]] == r["word"] and words[r["other_n"]] == r["other"] for r in got)


# near embeddings


def brute_links(rows, least):
    fit = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in fit}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    near = {i: [j for j in fit if j != i and len(unit[i]) == len(unit[j]) and (rows[i][1] == rows[j][1] or unit[i] @ unit[j] >= least)] for i in fit}
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(near.get(todo.pop(), ())) - seen
            seen |= new
            todo += new
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((name, len(near.get(i, ())), low, name == low))
    return out


def around(rng, x, cosine):
    p = rng.normal(size=len(x))
    p -= (p @ x) * x
    return (cosine * x + math.sqrt(1 - cosine * cosine) * p / np.linalg.norm(p)).tolist()


@pytest.mark.parametrize("kind", [{}, {"leaf": 64, "bucket": 100, "sample": 400}, {"hot": 1.0, "leaf": 200}])
def test_near_embeddings(spark, kind):
    rng = np.random.default_rng(11)
    unit = lambda: (lambda x: x / np.linalg.norm(x))(rng.normal(size=24))
    vectors = [unit().tolist() for _ in range(500)]
    middle = unit()
    vectors += [around(rng, middle, c) for c in rng.uniform(0.985, 0.9999, 150)]  # a hot core, and what is just outside
    vectors += [around(rng, middle, c) for c in rng.uniform(0.86, 0.98, 40)]
    vectors += [around(rng, np.array(v), 0.97) for v in vectors[:60]]
    vectors += [vectors[3]] * 40 + [[4 * c for c in vectors[5]]]
    odd = [None, [], [0.0] * 24, [1.0, None] * 12, [math.nan] * 24, [math.inf] * 24, [1.0, 2.0], [2.0, 4.0], [1e300] * 24, [2e300] * 24]
    rows = [(None if i % 97 == 5 else i, v) for i, v in enumerate([*odd, *vectors])] + [(7, vectors[8]), (7, None)]
    got = near_embeddings(table(spark, rows), **kind).collect()
    want = brute_links(rows, 0.95)
    key = lambda r: tuple((c is None, c) for c in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert near_embeddings(table(spark, rows).limit(0), **kind).collect() == []


def test_recall_at_the_threshold(spark):
    """Pairs just over the threshold: more than 0.99 are found (0.9 is asked for)."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(6000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(6000 + i, around(rng, v, 0.951)) for i, v in enumerate(a)]
    got = near_embeddings(table(spark, rows), leaf=32).collect()
    linked = sum(r["n_links"] for r in got)
    assert 0.99 * 12_000 <= linked <= 12_000 and all(r["component_id"] % 6000 == r["vec_id"] % 6000 for r in got)
