"""The mix against arithmetic on the driver: targets, quotas of the tree, bounds, every row, equal reruns."""

import collections
import re
from fractions import Fraction

import numpy as np
import pytest

from chronolattice.llm import mixture
from chronolattice.llm.mixture import mix_sources, mix_takes, mixed_documents, shard_quota, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights, most):
    """Fill all free sources at one rate until one is full; go on with the others. Exact fractions."""
    free, full = {i for i, s in enumerate(sizes) if s}, {}
    while free:
        left = sum(sizes) - sum(full.values())
        rate = Fraction(left, sum(weights[i] for i in free))
        over = {i for i in free if rate * weights[i] > most * sizes[i]}
        if not over:
            return [full.get(i, rate * weights[i] if i in free else Fraction(0)) for i in range(len(sizes))]
        full |= {i: Fraction(most * sizes[i]) for i in over}
        free -= over
    return [full.get(i, Fraction(0)) for i in range(len(sizes))]


def test_targets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        sizes = [int(x) for x in rng.integers(0, 10 ** rng.integers(1, 6), rng.integers(1, 9))]
        weights = [1 + i % 3 for i in range(len(sizes))]
        assert targets(sizes, weights, 3) == pytest.approx([float(x) for x in brute_targets(sizes, weights, 3)])


def test_tree_deals_every_block_once():
    for quota, shards in (([5, 0, 100, 3], 7), ([1], 4), ([40_000_000, 860_000_000], 16), ([9, 9], 1)):
        got = [shard_quota(np.array(quota), shards, k, 3) for k in range(shards)]
        place = np.zeros(len(quota), int)
        for start, n in got:  # runs of a source follow one another without gap
            assert (start == place).all()
            place = place + n
        assert place.tolist() == quota
        sizes = [int(n.sum()) for _, n in got]
        assert max(sizes) - min(sizes) <= max(2, shards.bit_length())
    with pytest.raises(ValueError):
        shard_quota(np.array([mixture.BLOCKS, 1]), 2, 0, 3)


def test_draws_follow_the_distribution_and_the_seed():
    # seven blocks of eleven: the mean of source 0 is 7 * 4 / 11, the variance that of a hypergeometric draw
    got = np.array([mixture._draw(s, (0, 2), np.array([4, 7]), 7)[0] for s in range(4000)])
    assert abs(got.mean() - 28 / 11) < 0.06 and abs(got.var() - 7 * (4 / 11) * (7 / 11) * (4 / 10)) < 0.06
    big = {tuple(mixture._draw(s, (0, 2), np.array([400_000_000, 500_000_000]), 450_000_000)) for s in range(5)}
    assert len(big) == 5 and all(sum(x) == 450_000_000 for x in big)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(f"w{k}" for k in rng.integers(0, 99, rng.integers(0, 60))), f"s{min(4, int(rng.integers(0, 9)))}", "en", {"a": 1}) for i in range(900)]
    rows += [(1, "a b c", "s1", "en", None), (1, "a b c", "s1", "de", None), (1, "a b c", None, "de", None), (None, "x y", "s2", None, None), (None, None, "s2", None, None), (5000, "", "none", "en", None)]
    rows += [(None, "one more time", "s3", "en", None)] * 40
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, m map<string,int>").repartition(5)


def test_mix_against_brute_force(table):
    rows, docs = table
    size = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    names = [*sorted(x for x in sizes if x is not None), None]
    want = dict(zip(names, brute_targets([sizes[n] for n in names], [1 + i % 3 for i in range(len(names))], 3), strict=True))
    takes = mix_takes(docs, untaken=True, bucket_docs=20).collect()
    taken, per, places = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for r in takes:
        taken[r.s] += r.words
        per[r.id, r.s, r.key, r.order] += r.words
        assert r.source_size == sizes[r.s] and r.target == pytest.approx(float(want[r.s]))
        if r.shard is not None:
            places[r.s, r["pass"], r.bucket].add(r.shard)
    assert all(abs(taken[s] - want[s]) < 1 for s in names)
    assert len(per) == len(rows)  # a row for every row, equal ones included
    by = {(r.id, r.s, r.key, r.order): r.size for r in takes}
    assert all(per[k] <= 3 * by[k] for k in by) and all(len(x) == 1 for x in places.values())  # a block is in one shard
    # of all rows, only one a source may be taken in part
    assert all(sum(0 < per[k] % by[k] for k in by if k[1] == s and by[k]) <= 1 for s in names)


def test_mix_keeps_rows_and_reruns_agree(table):
    rows, docs = table
    one = collections.Counter((r.doc_id, r.text, r.source, r.lang, r.mix.words, r.mix.shard, r.mix.slot) for r in mix_sources(docs, bucket_docs=20).collect())
    two = collections.Counter((r.doc_id, r.text, r.source, r.lang, r.mix.words, r.mix.shard, r.mix.slot) for r in mix_sources(docs.repartition(3, "lang"), bucket_docs=20).collect())
    assert one == two
    assert {k[3] for k in one if k[0] == 1 and k[1] == "a b c"} == {"en", "de"}
    out = mixed_documents(docs, bucket_docs=20)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in out.collect()) == sum(k[4] * n for k, n in one.items())
    assert collections.Counter(r.mix.shard for r in mix_sources(docs, seed=9).collect()) != collections.Counter(r.mix.shard for r in mix_sources(docs, seed=8).collect())


def test_own_folder(spark):
    import os

    from chronolattice.llm.cluster import clean, own_dir, written

    kept = written(spark.range(3), "numbers")
    assert kept.count() == 3 and own_dir(spark).endswith(spark.sparkContext.applicationId)
    assert os.listdir(own_dir(spark).removeprefix("file://"))
    clean(spark)
    assert not os.path.exists(own_dir(spark).removeprefix("file://"))
