"""Set-based access to a triple graph: every function takes all entities at once and joins them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolattice.sources.kg import LABEL, TYPE
from chronolattice.sources.storage import kept

#: Parts of relation names that two-hop searches leave out, and the lighter and stricter sets.
NOISE = ("wikipedia", "type.object", "common.topic", "_id", "#type", "#label", "/ns/freebase", "ns/common.", "ns/type.", "ns/kg.", "ns/user.", "ns/dataworld.")
NOISE_LIGHT = ("wikipedia", "_id", "#type", "#label", "/ns/freebase", "ns/kg.", "ns/dataworld.")
NOISE_STRICT = (*NOISE, "ns/base.")
#: The pairs of suffixes under which scopes are looked for, in order.
SCOPES = (("from", "to"), ("start_date", "end_date"), ("from_date", "to_date"), ("start", "end"))


def types(graph: DataFrame, entities: DataFrame) -> DataFrame:
    t = graph.where(F.col("p") == TYPE).select(F.col("s").alias("entity"), F.col("o").alias("type"))
    return t.join(entities, "entity", "left_semi").distinct()


def in_relations(graph: DataFrame, entities: DataFrame) -> DataFrame:
    return graph.where("o_kind = 'entity'").select(F.col("o").alias("entity"), F.col("p").alias("relation")).join(entities, "entity", "left_semi").distinct()


def out_relations(graph: DataFrame, entities: DataFrame) -> DataFrame:
    return graph.select(F.col("s").alias("entity"), F.col("p").alias("relation")).join(entities, "entity", "left_semi").distinct()


def one_hop(graph: DataFrame, entities: DataFrame) -> DataFrame:
    return in_relations(graph, entities).unionByName(out_relations(graph, entities)).distinct()


def quiet(relation: Column, noise: tuple[str, ...] = NOISE) -> Column:
    """Whether a relation is none of the noise."""
    import re

    full = F.concat(F.lit("http://rdf.freebase.com/ns/"), relation)
    return ~full.rlike("(?i)" + "|".join(map(re.escape, noise)))


def _edges(graph: DataFrame, noise: tuple[str, ...] | None, roles: DataFrame | None) -> DataFrame:
    """Edges between entities. The noise is a filter on the relation itself: where that is a literal of a branch it is
    decided when the plan is made, and the branch goes or stays as a whole."""
    edges = graph.where("o_kind = 'entity'")
    edges = edges.where(quiet(F.col("p"), noise)) if noise else edges
    if roles is not None:
        # the name is kept from folding, so that the semi-join keeps its key
        edges = edges.withColumn("p", F.concat(F.col("p"), F.substring("s", 1, 0))).join(roles.select(F.col("relation").alias("p")), "p", "left_semi")
    return edges.select("s", "p", "o")


def _hops(edges: DataFrame, near: str, far: str, name: str, ways: str) -> DataFrame:
    """Hops into (i) or out of (o) the nearer node, with the relation's name; those out of it carry #R."""
    parts = []
    for way in dict.fromkeys(ways):
        a, b = ("o", "s") if way == "i" else ("s", "o")
        mark = F.concat(F.col("p"), F.lit("#R")) if way == "o" else F.col("p")
        parts.append(edges.select(F.col(a).alias(near), mark.alias(name), F.col(b).alias(far)))
    return reduce(DataFrame.unionByName, parts)


def _two_hops(edges: DataFrame, entities: DataFrame, first: str, second: str) -> DataFrame:
    """(entity, r0, r1) of all paths whose hops have these ways. Of the nodes a second hop reaches only the least and the
    greatest are kept: they tell whether one is not where the path began.

    What is asked for, and what the first hop reaches, is kept as a table: while that is small the plan of the next hop sends
    it to all tasks, and the graph's edges are filtered where they are read."""
    # inner joins with distinct keys: a semi-join would be planned anew in every branch of the union
    asked = kept(entities.select("entity").distinct())
    one = kept(_hops(edges, "entity", "x1", "r0", first).join(asked, "entity").distinct())
    two = _hops(edges, "x1", "x2", "r1", second).join(kept(one.select("x1").distinct()), "x1")
    two = two.groupBy("x1", "r1").agg(F.min("x2").alias("least"), F.max("x2").alias("most"))
    same = F.col("r0").endswith("#R") == F.col("r1").endswith("#R")
    both = one.join(two, "x1").where(same | (F.col("least") != F.col("entity")) | (F.col("most") != F.col("entity")))
    return both.select("entity", "r0", "r1").distinct()


def two_hop(graph: DataFrame, entities: DataFrame, pattern: str, noise: tuple[str, ...] | None = NOISE, roles: DataFrame | None = None) -> DataFrame:
    """(entity, r0, r1): pairs of relations on two-hop paths. pattern: two letters, i for a hop into the nearer node, o for one
    out of it. Hops that leave the nearer node carry #R; where the ways differ the path does not end where it began."""
    return _two_hops(_edges(graph, noise, roles), entities, pattern[0], pattern[1])


def two_hop_batch(graph: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, relations): all relations on two-hop paths of each entity, the four patterns at once."""
    found = _two_hops(_edges(graph, NOISE_STRICT, None), entities, "io", "io")
    each = found.select("entity", F.explode(F.array(*[F.regexp_replace(c, "#R$", "") for c in ("r0", "r1")])).alias("r")).distinct()
    return each.groupBy("entity").agg(F.sort_array(F.collect_set("r")).alias("relations"))


def labels(graph: DataFrame, entities: DataFrame, lang: str = "en") -> DataFrame:
    """(entity, label): the smallest label in a language, null if there is none."""
    l = graph.where((F.col("p") == LABEL) & (F.col("o_lang") == lang)).groupBy(F.col("s").alias("entity")).agg(F.min("o").alias("label"))  # noqa: E741
    return entities.join(l, "entity", "left")


def by_key(graph: DataFrame, relation: str, keys: DataFrame) -> DataFrame:
    """(key, entity): the smallest entity with a key, '' if there is none."""
    k = graph.where(F.col("p") == relation).groupBy(F.col("o").alias("key")).agg(F.min("s").alias("entity"))
    return keys.join(k, "key", "left").select("key", F.coalesce("entity", F.lit("")).alias("entity"))


def describe(graph: DataFrame, entities: DataFrame, relations: list[str]) -> DataFrame:
    """One column for each of the relations, with the smallest value."""
    g = graph.where(F.col("p").isin(relations)).select(F.col("s").alias("entity"), "p", "o").join(entities, "entity", "left_semi")
    return g.groupBy("entity").agg(*[F.min(F.when(F.col("p") == r, F.col("o"))).alias(r.rsplit(".", 1)[-1].replace(":", "_")) for r in relations])


def relation_frequency(graph: DataFrame, prefix: str = "") -> DataFrame:
    return graph.where(F.col("p").startswith(prefix)).groupBy(F.col("p").alias("relation")).agg(F.count("*").alias("n"))


def temporal_scope(graph: DataFrame, entities: DataFrame, prefix: str) -> DataFrame:
    """(entity, ts_from, ts_to): the interval under the first pair of suffixes that has a value."""
    found = []
    for i, (a, b) in enumerate(SCOPES):
        g = graph.where(F.col("p").isin(f"{prefix}.{a}", f"{prefix}.{b}")).select(F.col("s").alias("entity"), "p", "o")
        found.append(g.groupBy("entity").agg(F.min(F.when(F.col("p") == f"{prefix}.{a}", F.col("o"))).alias("f"), F.min(F.when(F.col("p") == f"{prefix}.{b}", F.col("o"))).alias("t")).withColumn("prio", F.lit(i)))
    best = reduce(DataFrame.unionByName, found).groupBy("entity").agg(F.min(F.struct("prio", F.struct("f", "t").alias("v"))).alias("m"))
    return entities.join(best, "entity", "left").select("entity", F.col("m.v.f").alias("ts_from"), F.col("m.v.t").alias("ts_to"))


def temporal_relations(graph: DataFrame, entities: DataFrame, most: int = 50) -> DataFrame:
    """(entity, relation): relations whose name has a time word, the first ``most`` of each entity by name."""
    r = out_relations(graph, entities).where(F.col("relation").rlike("(?i)(date|time|from|to|start|end|year)"))
    return r.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("relation"))).where(F.col("n") <= most).drop("n")


def with_label_aliases(graph: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, alias): entities that share an English label, an entity itself among them."""
    l = graph.where((F.col("p") == LABEL) & (F.col("o_lang") == "en")).select("s", "o")  # noqa: E741
    return l.select(F.col("s").alias("entity"), "o").join(entities, "entity", "left_semi").join(l.select(F.col("s").alias("alias"), "o"), "o").select("entity", "alias").distinct()


def prominent_types(graph: DataFrame, entities: DataFrame, relation: str = "kg.object_profile.prominent_type") -> DataFrame:
    """(entity, types): what a graph names as an entity's prominent types, sorted."""
    t = graph.where((F.col("p") == relation) & (F.col("o_kind") == "entity")).select(F.col("s").alias("entity"), "o")
    return t.join(entities.select("entity").distinct(), "entity").groupBy("entity").agg(F.sort_array(F.collect_set("o")).alias("types"))


def bound_scopes(graph: DataFrame, expressions: DataFrame, column: str = "s_expression") -> DataFrame:
    """``expressions`` with scope: of a time constraint, its relation and the interval that the graph holds for the first
    entity under the relation's stem ("r (from=..., to=...)"); null where there is none. All expressions at once."""
    tc = r"TC\s+\([^)]+\)\s+(\S+)\s+(\S+)"
    e = expressions.withColumn("__r", F.nullif(F.regexp_extract(column, tc, 1), F.lit(""))).withColumn("__e", F.nullif(F.regexp_extract(column, r"(m\.[a-zA-Z0-9_]+)", 1), F.lit("")))
    e = e.withColumn("__stem", F.regexp_replace("__r", r"\.(from|to|start_date|end_date|start|end)$", ""))
    wanted = e.where("__r is not null and __e is not null").select("__e", "__stem").distinct()
    g = graph.join(wanted.select("__e").distinct(), F.col("s") == F.col("__e")).select(F.col("__e").alias("__g"), "p", "o")
    found = []
    for i, (a, b) in enumerate(SCOPES):
        ends = g.withColumn("__tail", F.element_at(F.split("p", r"\."), -1)).where(F.col("__tail").isin(a, b))
        ends = ends.withColumn("__of", F.regexp_replace("p", r"\.[^.]*$", ""))
        v = ends.join(wanted, (F.col("__g") == F.col("__e")) & (F.col("__of") == F.col("__stem")))
        v = v.groupBy("__e", "__stem").agg(F.min(F.when(F.col("__tail") == a, F.col("o"))).alias("f"), F.min(F.when(F.col("__tail") == b, F.col("o"))).alias("t"))
        found.append(v.withColumn("prio", F.lit(i)))
    best = reduce(DataFrame.unionByName, found).groupBy("__e", "__stem").agg(F.min(F.struct("prio", "f", "t")).alias("m"))
    ends = F.concat_ws(", ", F.concat(F.lit("from="), F.col("m.f")), F.concat(F.lit("to="), F.col("m.t")))
    return e.join(best, ["__e", "__stem"], "left").withColumn("scope", F.when(F.col("m").isNotNull(), F.concat("__r", F.lit(" ("), ends, F.lit(")")))).select(*expressions.columns, "scope")
