"""Grounding of relations and entities, surface index and entity linking."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolattice.functions import text as fx
from chronolattice.sources.storage import kept


def ground_exact(predicted: DataFrame, relations: DataFrame) -> DataFrame:
    """``predicted`` (relation) with rel: the number of its slash form in ``relations`` (path, rel), or of the form as it is.
    Both are plain joins, so a number 0 is a number like any other."""
    slash = relations.select(F.col("path").alias("__a"), F.col("rel").alias("__x"))
    raw = relations.select(F.col("path").alias("__b"), F.col("rel").alias("__y"))
    j = predicted.join(slash, fx.slash_path(F.col("relation")) == F.col("__a"), "left").join(raw, F.col("relation") == F.col("__b"), "left")
    return j.withColumn("rel", F.coalesce("__x", "__y")).drop("__a", "__b", "__x", "__y")


def _blocks(rows: DataFrame, key: str, each: int) -> tuple[DataFrame, int]:
    """``rows`` with a block number by a hash of ``key``, and the number of blocks: of some ``each`` rows, however many."""
    n = max(1, -(-rows.count() // each))
    return rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n))), n


class Paths:
    """An index of paths by characters and length. The ratio of two texts is twice the characters matched over all
    characters; no more can be matched than the two have in common, whatever their order, so that bounds the ratio."""

    def __init__(self, paths: list[str]):
        self.paths = paths
        self.length = np.array([len(p) for p in paths], np.int64)
        self.at = {c: i for i, c in enumerate(sorted(set("".join(paths))))}
        self.counts = np.zeros((len(paths), len(self.at)), np.int32)
        self.ends: dict[str, list[int]] = {}
        for i, p in enumerate(paths):
            for c in p:
                self.counts[i, self.at[c]] += 1
            self.ends.setdefault(p.rsplit("/", 1)[-1], []).append(i)

    def bounds(self, want: str, among: np.ndarray) -> np.ndarray:
        own = np.zeros(len(self.at), np.int32)
        for c in want:
            if c in self.at:
                own[self.at[c]] += 1
        used = np.flatnonzero(own)  # only the characters that the text has
        return 2.0 * np.minimum(self.counts[np.ix_(among, used)], own[used]).sum(1) / np.maximum(1, self.length[among] + len(want))

    def best(self, want: str, among: np.ndarray, least: float) -> tuple[tuple[float, str] | None, int]:
        """The most similar path (of equals the greatest) of at least ``least``, and how many were compared: those with the largest
        bounds, until no bound reaches what was found."""
        # shorter or longer texts cannot reach the ratio
        n = self.length[among]
        among = among[2.0 * np.minimum(n, len(want)) >= least * (n + len(want))]
        bound = self.bounds(want, among)
        found, tried = None, 0
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < (least if found is None else found[0]):
                break
            tried += 1
            path = self.paths[among[i]]
            score = SequenceMatcher(None, path, want).ratio()
            if score >= least and (found is None or (score, path) > found):
                found = score, path
        return found, tried


def most_similar(asked: DataFrame, relations: DataFrame, cutoff: float, suffix_cutoff: float, each: int) -> DataFrame:
    """(relation, fuzzy, score, path, compared): each asked relation's most similar path, and the most similar of those with its last
    part; ``compared`` counts exact ratios. The dictionary is a list of names, as long as a schema; ``each`` of them at most
    go to all tasks at a time, a longer list in several passes over what is asked."""
    parts = max(1, -(-relations.count() // each))
    passes = []
    for k in range(parts):
        names = relations.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == k).select("path").distinct()
        index = asked.sparkSession.sparkContext.broadcast(Paths(sorted(r["path"] for r in names.collect())))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            ix = index.value
            every = np.arange(len(ix.paths))
            for b in batches:
                out = []
                for r in b["relation"]:
                    want = "/" + r.strip("/").replace(".", "/")
                    same = np.array(ix.ends.get(want.rsplit("/", 1)[-1], []), np.int64)
                    for how, among, least in ((1, every, cutoff), (0, same, suffix_cutoff)):
                        got, tried = ix.best(want, among, least)
                        out.append((r, how, *(got or (None, None)), tried))
                yield pd.DataFrame(out, columns=["relation", "fuzzy", "score", "path", "compared"])

        passes.append(asked.select("relation").mapInPandas(run, "relation string, fuzzy int, score double, path string, compared long"))
    return reduce(DataFrame.unionByName, passes)


def ground_fuzzy(predicted: DataFrame, relations: DataFrame, cutoff: float = 0.6, suffix_cutoff: float = 0.5, each: int = 50_000) -> DataFrame:
    """(relation, rel, path, score, how): exact where possible, else the most similar path (Ratcliff-Obershelp ratio), else
    the most similar of those that share the last part; of equals the greatest path. Paths that cannot be the most similar
    by what characters they have are not compared. Null relations ground to nothing."""
    relations = kept(relations.select("path", "rel"))
    exact = kept(ground_exact(predicted.select("relation").distinct(), relations))
    near = most_similar(exact.where("rel is null and relation is not null").select("relation").repartition("relation"), relations, cutoff, suffix_cutoff, each)
    best = near.where("path is not null").groupBy("relation").agg(F.max(F.struct("fuzzy", "score", "path")).alias("b"))
    found = best.select("relation", "b.*").join(relations, "path").select("relation", F.col("rel").cast("long").alias("rel"), "path", "score", F.when(F.col("fuzzy") == 1, "fuzzy").otherwise("suffix").alias("how"))
    known = exact.where("rel is not null").join(relations, "rel").select("relation", F.col("rel").cast("long").alias("rel"), "path", F.lit(1.0).alias("score"), F.lit("exact").alias("how"))
    return predicted.select("relation").join(known.unionByName(found), "relation", "left").withColumn("how", F.coalesce("how", F.lit("none")))


def ground_entities(predicted: DataFrame, entities: DataFrame) -> DataFrame:
    """``predicted`` (mid) with id: of the dotted form in ``entities`` (mid, id), then of the slash form."""
    a = entities.select(F.col("mid").alias("__a"), F.col("id").alias("__x"))
    b = entities.select(F.col("mid").alias("__b"), F.col("id").alias("__y"))
    j = predicted.join(a, F.col("mid") == F.col("__a"), "left").join(b, fx.slash_path(F.col("mid")) == F.col("__b"), "left")
    return j.withColumn("id", F.coalesce("__x", "__y")).drop("__a", "__b", "__x", "__y")


def answer_index(triples: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(head, rel, answers): distinct named tails of the pairs (head, rel), sorted. One scan and a semi-join."""
    t = triples.join(pairs.select("head", "rel").distinct(), ["head", "rel"], "left_semi").join(names.select(F.col("id").alias("tail"), "mid"), "tail")
    return t.groupBy("head", "rel").agg(F.sort_array(F.collect_set("mid")).alias("answers"))


def normal_name(c: Column) -> Column:
    """Lower case, word and sign tokens parted by single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"([^\w\s])", " $1 "), r"\s+", " "))


def surface_index(surface_map: DataFrame, entities: DataFrame) -> DataFrame:
    """(surface, mid, score, name, popularity): forms of known entities; a form of one entity once, with its best score."""
    s = surface_map.select(normal_name(F.col("surface")).alias("surface"), "mid", "score").groupBy("surface", "mid").agg(F.max("score").alias("score"))
    return s.join(entities.select("mid", "name", F.col("score").alias("popularity")), "mid")


def missing_entities(surface_map: DataFrame, entities: DataFrame) -> DataFrame:
    return surface_map.select("mid").distinct().join(entities, "mid", "left_anti")


def top_surface(mentions: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """(mention, mid, score, rank): the k best entities of each mention."""
    m = mentions.select("mention", normal_name(F.col("mention")).alias("surface")).distinct().join(index, "surface")
    n = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "mid"))
    return m.withColumn("rank", n).where(F.col("rank") <= k).select("mention", "mid", "score", "rank")


def strong_surface(mentions: DataFrame, index: DataFrame, k: int = 50, least: float = 0.001) -> DataFrame:
    """What stands in for labels that name nothing: of the k best entities of a mention the first, and others of ``least``."""
    return top_surface(mentions, index, k).where((F.col("rank") == 1) | (F.col("score") >= least))


def spans(questions: DataFrame, longest: int | None = None) -> DataFrame:
    """(qid, start, end, part, before, after, span): all runs of tokens, with the tags around them; ``questions`` has qid and tokens (structs of text, lemma, pos)."""
    q = questions.select("qid", "tokens", F.posexplode("tokens").alias("start", "__t"))
    last = F.size("tokens") if longest is None else F.least(F.size("tokens"), F.col("start") + longest)
    q = q.select("qid", "start", "tokens", F.explode(F.sequence(F.col("start") + 1, last)).alias("end"))
    part = F.slice("tokens", F.col("start") + 1, F.col("end") - F.col("start"))
    around = [F.get("tokens", i)["pos"].alias(n) for i, n in ((F.col("start") - 1, "before"), (F.col("end"), "after"))]
    return q.select("qid", "start", "end", part.alias("part"), *around, F.concat_ws(" ", F.transform(part, lambda t: t["text"])).alias("span"))


#: Lemmas that name nothing by themselves, and the tags that a name's words may have.
IGNORED = ("be", "of", "the", "and", "or", "a")
TAGS = r"^(UH|\.|TO|PRP.?|#|FW|IN|VB.?|RB|CC|HYPH|WP|XX|NNP.?|NN.?|JJ.?|CD|DT|MD|POS)$"


def can_name(part: Column, before: Column, after: Column) -> Column:
    """Whether a run of tokens may name an entity, given the tags around it: some lemma counts, the first one too (but for
    'the'); one word is a noun, adjective or foreign and no part of a longer run of proper nouns; several have tags that
    names have."""
    lemma, pos = F.transform(part, lambda t: t["lemma"]), F.transform(part, lambda t: t["pos"])
    only, first = F.element_at(pos, 1), F.element_at(lemma, 1)
    counts = F.exists(lemma, lambda x: ~x.isin(*IGNORED)) & (~first.isin(*IGNORED) | (first == "the"))
    proper = lambda c: F.coalesce(c, F.lit("")).startswith("NNP")
    single = only.rlike("^(N|J|FW$|XX$)") & ~(proper(only) & (proper(before) | proper(after)))
    return counts & F.when(F.size(part) == 1, single).otherwise(F.forall(pos, lambda p: p.rlike(TAGS)))


def link(questions: DataFrame, index: DataFrame, *, least: float = 0.3, longest: int | None = None) -> DataFrame:
    """(qid, start, end, span, mid, surface_score, perfect, score): entities of all spans. A perfect match of the main name
    weighs sixty times."""
    s = spans(questions, longest).where(can_name(F.col("part"), F.col("before"), F.col("after"))).withColumn("surface", normal_name(F.col("span")))
    j = s.join(index, "surface").where(F.col("score") >= least)
    perfect = normal_name(fx.without_extras(F.col("name"))) == normal_name(fx.without_extras(F.col("span")))
    return j.select("qid", "start", "end", "span", "mid", F.col("score").alias("surface_score"), perfect.alias("perfect"), (F.col("popularity") * F.when(perfect, 60).otherwise(1)).cast("double").alias("score"))


def drop_subsumed(linked: DataFrame) -> DataFrame:
    """Without links whose span lies in a longer span of the same entity with a surface score at least as high."""
    o = linked.select(F.col("qid").alias("q"), F.col("mid").alias("m"), F.col("start").alias("a"), F.col("end").alias("b"), F.col("surface_score").alias("c"))
    inside = (F.col("a") <= F.col("start")) & (F.col("b") >= F.col("end")) & (F.col("b") - F.col("a") > F.col("end") - F.col("start"))
    return linked.join(o, (F.col("qid") == F.col("q")) & (F.col("mid") == F.col("m")) & inside & (F.col("c") >= F.col("surface_score")), "left_anti")


def prune(linked: DataFrame, k: int = 7) -> DataFrame:
    """The k best entities of each span."""
    n = F.row_number().over(Window.partitionBy("qid", "start", "end").orderBy(F.desc("score"), F.desc("surface_score"), "mid"))
    return linked.withColumn("rank", n).where(F.col("rank") <= k)


def by_length(linked: DataFrame) -> DataFrame:
    """``linked`` with place: links of a question by the length of the mention, then by surface score, the best first."""
    n = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.length("span")), F.desc("surface_score"), "start", "mid"))
    return linked.withColumn("place", n)


def date_mentions(questions: DataFrame) -> DataFrame:
    """(qid, at, year): numbers of four digits."""
    q = questions.select("qid", F.posexplode("tokens").alias("at", "t"))
    return q.where((F.col("t.pos") == "CD") & F.col("t.text").rlike(r"^\d{4}$")).select("qid", "at", F.col("t.text").alias("year"))


def maximal_sets(linked: DataFrame) -> DataFrame:
    """(qid, spans): all sets of spans that do not overlap and to which none can be added. A set grows by spans between
    which and its end no other fits, so nothing is tried in vain; rows leave as they are found."""
    per = linked.select("qid", F.struct("start", "end").alias("s")).distinct().groupBy("qid").agg(F.sort_array(F.collect_set("s")).alias("s"))

    def sets(v: list[tuple[int, int]]) -> Iterator[str]:
        stack = [((), -1)]
        while stack:
            chosen, at = stack.pop()
            later = [x for x in v if x[0] >= at]
            if not later:
                yield " ".join(f"{a}-{b}" for a, b in chosen)
            first = min((b for _, b in later), default=0)
            stack += [((*chosen, x), x[1]) for x in later if x[0] < first]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, ss in zip(b.qid, b.s, strict=True):
                for text in sets([(int(x["start"]), int(x["end"])) for x in ss]):
                    out.append((q, text))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["qid", "spans"])
                        out = []
            yield pd.DataFrame(out, columns=["qid", "spans"])

    types = dict(linked.dtypes)
    return per.mapInPandas(run, f"qid {types['qid']}, spans string")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _likest(k: int, least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best of one block of labels for each query of one block of queries. Vectors of other lengths, of zeros only and with a
    component that is null or no number are like none; products are of double precision, 256 queries at a time."""

    def units(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length of the vectors: the places of those that can be compared, and the vectors, each of length 1."""
        rows = [None if v is None else np.array(v, np.float64) for v in vectors.to_pylist()]
        out = {}
        for d in sorted({len(v) for v in rows if v is not None}):
            at = np.array([i for i, v in enumerate(rows) if v is not None and len(v) == d])
            x = np.stack([rows[i] for i in at]) if d else np.zeros((len(at), 0))
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            out[d] = at[ok], x[ok] / norm[ok, None]
        return out

    def run(q: pa.Table, l: pa.Table) -> pa.Table:  # noqa: E741
        names, asked, them = l["label"].to_pylist(), units(q["v"]), units(l["vector"])
        who, what, how = [], [], []
        for d in asked.keys() & them.keys():
            (qi, x), (li, y) = asked[d], them[d]
            for s in range(0, len(qi) if len(li) else 0, 256):
                z = x[s : s + 256] @ y.T
                z = np.sign(z) * np.floor(np.abs(z) * 1e6 + 0.5) / 1e6
                edge = np.partition(z, max(0, z.shape[1] - k), axis=1)[:, max(0, z.shape[1] - k)]
                for i, row in enumerate(z):
                    best = np.flatnonzero((row >= edge[i]) & (row > least)).tolist()
                    if len(best) > k:  # equal ones: the first by label
                        best = heapq.nsmallest(k, best, key=lambda j: (-row[j], names[li[j]] is not None, names[li[j]]))  # noqa: B023  # called at once
                    who += [int(qi[s + i])] * len(best)
                    what += [int(li[j]) for j in best]
                    how += row[best].tolist()
        return pa.table({"query": q["query"].take(pa.array(who, pa.int64())), "label": l["label"].take(pa.array(what, pa.int64())), "similarity": pa.array(how, pa.float64())})

    return run


def nearest(queries: DataFrame, labels: DataFrame, k: int = 1, least: float = 0.2, each: int = 2048) -> DataFrame:
    """(query, label, similarity, rank): the k labels most similar to each query vector, above ``least``. A stated set of
    queries against all labels, block by block: a block of queries meets a block of labels in one task, as a product of matrices,
    and leaves its k best before anything is ranked. All pairs are compared, so the work is as large as both sides multiplied."""
    left, m = _blocks(queries.select("query", F.col("vector").alias("v")), "query", each)
    right, n = _blocks(labels.select("label", "vector"), "label", each)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    q, l = left.select("query", "v", F.col("block").alias("i"), every(n).alias("j")), right.select("label", "vector", every(m).alias("i"), F.col("block").alias("j"))  # noqa: E741
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    s = q.groupBy("i", "j").cogroup(l.groupBy("i", "j")).applyInArrow(_likest(k, least), f"query {kind(queries, 'query')}, label {kind(labels, 'label')}, similarity double")
    s = s.withColumn("similarity", F.round("similarity", 6))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "label"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k)


def expand(slots: DataFrame, most: int = 10_000) -> DataFrame:
    """(qid, n, choice): combinations of one candidate a slot in the order of nested loops, at most ``most``; ``slots`` has qid
    and candidates (array of arrays). The n-th is spelled out of n, so no product is ever built."""
    sizes = F.transform("candidates", lambda c: F.size(c).cast("bigint"))
    total = F.aggregate(sizes, F.lit(1).cast("bigint"), lambda a, b: F.least(a * b, F.lit(1 << 40).cast("bigint")))
    s = slots.withColumn("__z", sizes).withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(total, F.lit(most)) - 1)))
    after = lambda i: F.aggregate(F.slice("__z", i + 2, F.size("__z")), F.lit(1).cast("bigint"), lambda a, b: F.least(a * b, F.lit(1 << 40).cast("bigint")))
    pick = F.transform("candidates", lambda c, i: F.get(c, ((F.floor(F.col("n") / after(i))) % F.size(c)).cast("int")))
    return s.where(total > 0).select("qid", "n", pick.alias("choice"))


def relation_candidates(pairs: DataFrame, k: int = 15, least: float = 0.01) -> DataFrame:
    """(slot, relation, similarity): the k relations most similar to each slot's words, by shared words over all words."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[._ ]+"))
    both = F.size(F.array_intersect(words(F.col("text")), words(F.col("relation"))))
    sim = F.round(both / F.size(F.array_union(words(F.col("text")), words(F.col("relation")))), 6)
    s = pairs.withColumn("similarity", sim).where(F.col("similarity") > least)
    n = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("similarity"), "relation"))
    return s.withColumn("rank", n).where(F.col("rank") <= k)
