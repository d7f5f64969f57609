"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One inserted, deleted or replaced code point leaves a half of a word intact. So every word stands twice in one sorted
dictionary: by its first half, written forward, and by its second half, written backward. Words that share a half
form a run of the sorted dictionary, a block; a task scans its range of blocks in order and compares inside each. Where
a block is large, its words go on to the next round: the half where they may differ is cut in two once more, and again
one of its halves is intact. So blocks shrink by rounds (as many as the logarithm of the longest word), none is ever
held or compared whole, and no pair is lost. Blocks whose open part is one code point wide cannot be cut; the alphabet
bounds them.

A window [lo, hi) of a word of ``length`` code points says where the edit is: all before lo and from hi on is shared. A
word takes part by itself (role short) and as the longer word of a pair (role long, ``length`` less by one, one code point
more in the window). Every pair has one place (the differing code point, or the last place where the insertion can be
said to be) and so meets in one window of a round: no pair is counted twice.

Keys that hold a large share of a round's rows are found beforehand by counts over buckets (few numbers a task) and their
words go on without being dealt to one task.

Defined results: a null text has no words; a null doc_id counts as an empty one in the name of an occurrence; rows that
repeat count again; ties go to the smallest word in code-point order; other columns are passed over; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolattice.llm.cluster import partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of pairs that are held at once.
LETTERS = 1 << 22
ROWS = "word string, n long, length int, long boolean, lo int, hi int"
FOUND = f"kind int, {ROWS}, other string, other_n long"


def words(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shortest: int = 7, fewest: int = 2, drop_one_in: int = 31) -> DataFrame:
    """(word, n): the dictionary. Runs of letters are lower-cased in A-Z; of those whose name's crc32 ``drop_one_in``
    divides, one code point goes (planted misspellings). Words have ``shortest`` code points and ``fewest`` occurrences at least."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("r"))
    runs = runs.select("d", F.when(F.col("r").rlike("[A-Z]"), F.translate("r", UPPER, LOWER)).otherwise(F.col("r")).alias("r"))
    runs = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "r")))
    at = "cast(h % length(r) as int)"
    word = F.when(F.col("h") % drop_one_in == 0, F.expr(f"concat(left(r, {at}), substring(r, {at} + 2))")).otherwise(F.col("r"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row's two halves of its window: the edit in the first one, or in the second."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))).alias("half")
    return rows.select("word", "n", "length", "long", half).select("word", "n", "length", "long", "half.lo", "half.hi")


def _key() -> Column:
    """The shared parts: what is before the window forward, what is after it backward, then the window itself. Letters
    come after the signs between them, so all that share a beginning stand together in the order of keys."""
    after = F.expr("reverse(substring(word, hi + 1 + cast(long as int)))")
    return F.concat(F.expr("left(word, lo)"), F.lit(" "), after, F.lit(" "), "length", F.lit(" "), "lo")


def _crowded(rows: DataFrame, large: int) -> list[str]:
    """The keys that hold more than one in ``most`` rows: at most that many, found by counts over buckets, then over the keys of
    the few buckets that can hold one."""
    most = max(256, partitions(rows.sparkSession))
    bucket = F.pmod(F.xxhash64("key"), F.lit(16 * most))
    counts = rows.groupBy(bucket.alias("b")).count().collect()  # as many rows as buckets at most
    bar = max(large, sum(r["count"] for r in counts) // most)
    full = [r["b"] for r in counts if r["count"] > bar]
    if not full:
        return []
    return [r["key"] for r in rows.where(bucket.isin(full)).groupBy("key").count().where(F.col("count") > bar).collect()]


def _candidates(short: np.ndarray, block: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in blocks (short with a later short, short with long), some ``most`` at a time; short rows stand first in
    their block."""
    ends = np.flatnonzero(np.r_[block[1:] != block[:-1], True]) + 1
    end = ends[np.searchsorted(ends, np.arange(len(block)), side="right")]
    first = np.flatnonzero(short)
    count = end[first] - first - 1
    if not count.any():
        return
    cuts = np.searchsorted(np.cumsum(count), np.arange(most, count.sum() + most, most), side="left") + 1
    for a, b in zip(np.r_[0, cuts[:-1]], cuts, strict=True):
        c = count[a:b]
        i = np.repeat(first[a:b], c)
        yield i, i + 1 + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)


def _near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows of letters, y as long as x or longer by one: whether they are one edit apart, and its place."""
    n = x.shape[1]
    same = x == y[:, :n]
    before = np.where(same.all(1), n, same.argmin(1))  # letters shared from the front
    if y.shape[1] == n:
        return same.sum(1) == n - 1, before
    back = x[:, ::-1] == y[:, :0:-1]
    after = np.where(back.all(1), n, back.argmin(1))
    return before + after >= n, before


def _scan(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Near words inside whole blocks, each pair in both directions."""
    for length, of in rows.groupby("length", sort=False):
        of = of.sort_values(["block", "long"], kind="stable")
        block, long, lo, hi = (of[c].to_numpy() for c in ("block", "long", "lo", "hi"))
        word, n = of["word"].to_numpy(), of["n"].to_numpy()
        width = int(length) + 1
        # letters of the alphabet have one byte in Latin-1; short words end in an empty one
        letters = np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in word), np.uint8).reshape(-1, width)
        for i, j in _candidates(~long, block, max(1, LETTERS // width)):
            for other in (False, True):
                p, q = i[long[j] == other], j[long[j] == other]
                if not len(p):
                    continue
                y = letters[q] if other else letters[q, :length]
                ok, at = _near(letters[p, :length], y)
                # an insertion after the last letter belongs to the last window
                ok &= (at >= lo[p]) & ((at < hi[p]) | ((at == length) & (hi[p] == length)))
                a, b = np.r_[p[ok], q[ok]], np.r_[q[ok], p[ok]]
                if len(a):
                    yield pd.DataFrame({"kind": 0, "word": word[a], "n": n[a], "length": length, "long": False, "lo": 0, "hi": 0, "other": word[b], "other_n": n[b]})


def _scanned(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Walks a sorted range of the dictionary: pairs (kind 0) of blocks of at most ``most`` rows or that cannot be cut, and the
    rows of the others (kind 1). A large block passes by; only its first rows are held until it has proved large."""
    def closed(done: pd.DataFrame) -> Iterator[pd.DataFrame]:
        size = done.groupby("block")["block"].transform("size").to_numpy()
        cut = (size > most) & ((done["hi"] - done["lo"]).to_numpy() > 1)
        if cut.any():
            yield passed(done[cut])
        yield from _scan(done[~cut])

    def passed(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.drop(columns=["key", "block"]).assign(kind=1, other=None, other_n=None)

    held, large = None, None  # rows of the block that is open, or the key of one that is known to be large
    number = 0
    order = [c.split()[0] for c in FOUND.split(", ")]
    for rows in batches:
        if not len(rows):
            continue
        if large is not None:
            ends = (rows["key"] != large).to_numpy()
            stop = int(ends.argmax()) if ends.any() else len(rows)
            if stop:
                yield passed(rows[:stop].assign(block=0))[order]
            rows = rows[stop:]
            if not len(rows):
                continue
            large = None
        rows = pd.concat([held, rows], ignore_index=True) if held is not None else rows.reset_index(drop=True)
        rows["block"] = number + (rows["key"] != rows["key"].shift()).cumsum()
        number = int(rows["block"].iloc[-1])
        open_ = rows["block"] == number
        for out in closed(rows[~open_]):
            yield out[order]
        held = rows[open_]
        if len(held) > most and held["hi"].iloc[0] - held["lo"].iloc[0] > 1:
            yield passed(held)[order]
            held, large = None, rows["key"].iloc[-1]
        else:
            held = held.drop(columns="block")
    if held is not None:
        for out in closed(held.assign(block=number)):
            yield out[order]


def near_pairs(dictionary: DataFrame, large: int = 128) -> DataFrame:
    """(word, n, other, other_n) for words (word, n) of letters in Latin-1, each once, that are one edit apart: each pair in both
    directions. Blocks of more than ``large`` rows are cut."""
    whole = [F.struct(F.length("word").alias("length"), F.lit(False).alias("long")), F.struct((F.length("word") - 1).alias("length"), F.lit(True).alias("long"))]
    rows = dictionary.select("word", "n", F.explode(F.array(*whole)).alias("r")).select("word", "n", "r.length", "r.long", F.lit(0).alias("lo"), F.col("r.length").alias("hi"))
    rows, pairs = rows.where("length > 0"), None
    while True:
        keyed = _halved(rows).withColumn("key", _key())
        crowded = _crowded(keyed, large)
        here = F.col("key").isin(crowded) & (F.col("hi") - F.col("lo") > 1) if crowded else F.lit(False)
        dealt = keyed.where(~here).repartitionByRange("key").sortWithinPartitions("key").mapInPandas(lambda b: _scanned(b, large), FOUND)
        if crowded:
            dealt = dealt.unionByName(keyed.where(here).drop("key").withColumns({"kind": F.lit(1), "other": F.lit(None).cast("string"), "other_n": F.lit(None).cast("long")}))
        found = written(dealt, "near")
        near = found.where("kind = 0").select("word", "n", "other", "other_n")
        pairs = near if pairs is None else pairs.unionByName(near)
        rows = found.where("kind = 1").select("word", "n", "length", "long", "lo", "hi")
        if rows.isEmpty():
            return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last. A form has ten times its word's count, so
    no way is longer than a long has digits, and five doublings follow any; rounds end when nothing moves."""
    way = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(5):
        step = way.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        moved = way.join(step, way["root"] == step["__at"], "left")
        way = written(moved.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        if way.where("moved").isEmpty():
            break
        way = way.drop("moved")
    return way.select("word", "root")


def spelling_variants(docs: DataFrame, *, times: int = 10, large: int = 128, text: str = "text", doc_id: str = "doc_id", **dictionary) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the dictionary of ``docs`` (see ``words``). A word's form is its
    near word of the largest count, if that is ``times`` the word's own."""
    found = written(words(docs, text=text, doc_id=doc_id, **dictionary), "words")
    best = near_pairs(found, large).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    joined = written(found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")), "forms")
    last = roots(joined.where("f is not null").select("word", "f.form"))
    return joined.join(last, "word", "left").select("word", "f.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "f.form_n")
