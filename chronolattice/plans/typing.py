"""Types of the parts of an expression, by the domains and ranges of its relations.

Every part that stands for nodes has a type: a class, or a kind of literal. A relation says what is on its two sides, an AND that both
parts are of one type, a class that its members are of it; these flow up and down until nothing changes, so an entity gets its type from
where it stands, too. Of a class and one above it the narrower one holds; types that are neither the same nor above each other
are a conflict, which is reported, and the first by name stands. What no relation says anything of stays unknown (``?``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolattice.plans import sexpr
from chronolattice.sources.kg import TYPE

NUMBER = "integer"
#: So many first letters of a node's name are looked at to tell kinds of nodes apart.
HEAD = 3


@dataclass
class Roles:
    """What relations lead from and to, and the classes above each class: as long as a schema."""

    domain: dict[str, str]
    range: dict[str, str]
    above: dict[str, frozenset[str]] = field(default_factory=dict)

    def narrower(self, a: str, b: str) -> str | None:
        """The one of two types that is the other, or is below it."""
        return a if a == b or b in self.above.get(a, ()) else b if a in self.above.get(b, ()) else None


class Typing:
    def __init__(self, e, roles: Roles):
        self.roles, self.parent, self.known, self.conflicts = roles, [], {}, []
        self.at: dict[int, int] = {}  # type variable of each part, by its identity
        self.leaves: list[tuple[str, int]] = []
        self.e = e
        self.top = self.visit(e)

    def fresh(self) -> int:
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def find(self, v: int) -> int:
        while self.parent[v] != v:
            self.parent[v] = self.parent[self.parent[v]]
            v = self.parent[v]
        return v

    def says(self, v: int, kind: str | None) -> None:
        """v is of a type."""
        v = self.find(v)
        if kind is None:
            return
        if v not in self.known:
            self.known[v] = kind
        elif (both := self.roles.narrower(self.known[v], kind)) is not None:
            self.known[v] = both
        else:
            self.conflicts.append(tuple(sorted((self.known[v], kind))))
            self.known[v] = min(self.known[v], kind)

    def same(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[b] = a
            self.says(a, self.known.pop(b, None))
        return a

    def leaf(self, token: str) -> int:
        v, k = self.fresh(), sexpr.kind(token)
        if k == "class":
            self.says(v, token)
        elif k == "literal" and "^^" in token:
            self.says(v, token.rsplit("#", 1)[-1].rsplit("^^", 1)[-1])
        return v

    def hop(self, rel, start: int) -> int:
        """The far end of a relation, or a path of them."""
        if isinstance(rel, list) and rel[0] == "JOIN":
            return self.hop(rel[2], self.hop(rel[1], start))
        back = isinstance(rel, list)
        p, end = rel[1] if back else rel, self.fresh()
        self.says(end if back else start, self.roles.domain.get(p))
        self.says(start if back else end, self.roles.range.get(p))
        return end

    def visit(self, e) -> int:
        if isinstance(e, str):
            return self.leaf(e)
        op = e[0]
        if op == "JOIN":
            v, child = self.fresh(), self.visit(e[2])
            if e[1] == TYPE:  # the class of its members is their type
                self.says(v, e[2] if isinstance(e[2], str) else None)
            else:
                self.same(self.hop(e[1], v), child)
            self.note(e[2], child)
        elif op == "AND":
            a, b = self.visit(e[1]), self.visit(e[2])
            v = self.same(a, b)
            self.note(e[1], a)
            self.note(e[2], b)
        elif op == "COUNT":
            self.note(e[1], self.visit(e[1]))
            v = self.fresh()
            self.says(v, NUMBER)
        elif op in sexpr.COMPARE:
            v = self.fresh()
            value = self.leaf(e[2])
            end = self.hop(e[1], v)
            # a year or a number stands beside a fuller kind of the same value
            if self.find(value) not in self.known:
                value = self.same(end, value)
            self.note(e[2], value)
        else:
            v = self.visit(e[1])
            self.hop(e[2], v)
            self.note(e[1], v)
        self.note(e, v)
        return v

    def note(self, part, v: int) -> None:
        if isinstance(part, list):
            self.at[id(part)] = v
        else:
            self.leaves.append((part, v))

    def type_of(self, v: int) -> str:
        return self.known.get(self.find(v), "?")

    def text(self) -> str:
        """The expression with the type of each part in brackets; relations carry domain and range."""
        leaves = iter(self._in_order(self.e))

        def write(x) -> str:
            if isinstance(x, list):
                if x[0] == "R":
                    return f"(R {relation(x[1])})"
                return f"({x[0]}[{self.type_of(self.at[id(x)])}] " + " ".join(path(y) if i in ways(x[0]) else write(y) if isinstance(y, list) else leaf(y, x[0], i) for i, y in enumerate(x[1:], 1)) + ")"
            return leaf(x, "", 0)

        def relation(p: str) -> str:
            return f"{p}[{self.roles.domain.get(p, '?')}>{self.roles.range.get(p, '?')}]"

        def path(rel) -> str:
            return relation(rel) if isinstance(rel, str) else f"(R {relation(rel[1])})" if rel[0] == "R" else f"(JOIN {path(rel[1])} {path(rel[2])})"

        def ways(op: str) -> tuple[int, ...]:
            return (1,) if op == "JOIN" or op in sexpr.COMPARE else (2,) if op in ("ARGMAX", "ARGMIN", "TC") else ()

        def leaf(token: str, op: str, i: int) -> str:
            return token if op == "TC" and i == 3 else f"{token}[{self.type_of(next(leaves)[1])}]"

        return write(self.e)

    def _in_order(self, e) -> list[tuple[str, int]]:
        """Leaves as they are written: parts are noted from the inside out, so each is looked up where it stands."""
        noted: dict[str, list[int]] = {}
        for token, v in self.leaves:
            noted.setdefault(token, []).append(v)
        out = []

        def walk(x) -> None:
            if isinstance(x, str):
                out.append((x, noted[x].pop(0)))
                return
            for i, y in enumerate(x[1:], 1):
                if i == 1 and (x[0] == "JOIN" or x[0] in sexpr.COMPARE) or i == 2 and x[0] in ("ARGMAX", "ARGMIN", "TC") or i == 3 and x[0] == "TC":
                    continue
                walk(y)

        walk(e)
        return out


def typed(text: str, roles: Roles) -> tuple[str | None, str | None, str]:
    """(the form with types, the answers' type, conflicts) of an expression; nulls for what is none."""
    try:
        t = Typing(sexpr.read(text), roles)
    except (sexpr.SexprError, RecursionError):
        return None, None, ""
    return t.text(), t.type_of(t.top), "; ".join(sorted({f"{a} and {b}" for a, b in t.conflicts}))


def relation_roles(graph: DataFrame) -> DataFrame:
    """(relation, domain, range): the classes that most subjects and objects of each relation have (of equally many the first by name);
    for literals their datatype, or ``string``.

    Nodes that have no class cannot add to a count. Where names say by their first letters what they are of, edges of such nodes
    (mediators, for the most part) leave before they are dealt by node; which first letters there are is a list as short as an alphabet."""
    classes = graph.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("class"))
    edges = graph.where(F.col("p") != TYPE).select(F.col("p").alias("relation"), "s", "o", "o_kind", "o_datatype")

    def most(pairs: DataFrame, name: str) -> DataFrame:
        counts = pairs.groupBy("relation", "class").agg(F.count("*").alias("n"))
        return counts.groupBy("relation").agg(F.min(F.struct((-F.col("n")).alias("less"), "class"))["class"].alias(name))

    heads = F.broadcast(classes.select(F.left("node", F.lit(HEAD)).alias("__head")).distinct())

    def of(end: DataFrame) -> DataFrame:
        """(relation, class) of each edge's end that has one."""
        return end.join(heads, F.left("node", F.lit(HEAD)) == F.col("__head")).select("relation", "node").join(classes, "node").select("relation", "class")

    domain = most(of(edges.select("relation", F.col("s").alias("node"))), "domain")
    entity = of(edges.where("o_kind = 'entity'").select("relation", F.col("o").alias("node")))
    literal = edges.where("o_kind = 'literal'").select("relation", F.coalesce("o_datatype", F.lit("string")).alias("class"))
    names = edges.select("relation").distinct()
    return names.join(domain, "relation", "left").join(most(entity.unionByName(literal), "range"), "relation", "left")


def typed_forms(rows: DataFrame, roles: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """``rows`` (with sexpr) with typed, answer_type and conflicts. ``roles`` (relation, domain, range) and ``above`` (class, super) are a schema,
    which goes to all tasks."""
    r = roles.collect()
    up: dict[str, set[str]] = {}
    for x in above.collect() if above is not None else ():
        up.setdefault(x["class"], set()).add(x["super"])
    for _ in up:  # all that is above what is above
        for c in up:
            up[c] |= {s for x in list(up[c]) for s in up.get(x, ())}
    known = Roles({x["relation"]: x["domain"] for x in r if x["domain"]}, {x["relation"]: x["range"] for x in r if x["range"]}, {c: frozenset(s) for c, s in up.items()})

    @F.pandas_udf("typed string, answer_type string, conflicts string")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([typed(t, known) if t is not None else (None, None, "") for t in x], columns=["typed", "answer_type", "conflicts"])

    return rows.withColumn("__t", run(F.col("sexpr"))).select(*rows.columns, "__t.*")
