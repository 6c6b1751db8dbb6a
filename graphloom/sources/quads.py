"""The generic back-end: a table of quads (s, p, o as terms and text, g as text; NULL names the default graph)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import IRI, TERM_TYPE, Val, as_term, constant
from graphloom.plans import algebra as A
from graphloom.plans.solutions import Info, Solutions, column

SCHEMA = f"s {TERM_TYPE}, p string, o {TERM_TYPE}, g string"


@dataclass(frozen=True)
class QuadSource:
    """A dataset. default: graphs whose union is the default graph (None among them: the unnamed one); named: those that GRAPH
    sees (None: all named ones). union: the default graph is the union of all graphs. order: patterns are joined by how many of their
    places are fixed (fixed), as they are written (written), or by the rows expected from weights, those of predicates (weighted)."""

    quads: DataFrame
    default: tuple[str | None, ...] = (None,)
    named: tuple[str, ...] | None = None
    union: bool = False
    order: str = "fixed"
    weights: tuple[tuple[str, int], ...] = ()

    @staticmethod
    def empty(spark: SparkSession) -> QuadSource:
        return QuadSource(spark.createDataFrame([], SCHEMA))

    def dataset(self, default: list[str], named: list[str]) -> QuadSource:
        """FROM and FROM NAMED."""
        return replace(self, default=tuple(default), named=tuple(named), union=False) if default or named else self

    def in_graph(self, graph: A.Node | None) -> DataFrame:
        """Triples of a graph; a set, so those of several graphs are merged."""
        if isinstance(graph, A.Var):
            named = self.quads.filter(F.col("g").isNotNull())
            return named if self.named is None else named.filter(F.col("g").isin(list(self.named)))
        if isinstance(graph, A.Iri):
            return self.quads.filter(F.col("g") == graph.value) if self.named is None or graph.value in self.named else self.quads.limit(0)
        if self.union:
            return self.quads.select("s", "p", "o").distinct()
        if self.default == (None,):
            return self.quads.filter(F.col("g").isNull())
        names = [x for x in self.default if x is not None]
        found = F.col("g").isin(names) if names else F.lit(False)
        found = found | F.col("g").isNull() if None in self.default else found
        return self.quads.filter(found).select("s", "p", "o").distinct()

    def graphs(self) -> DataFrame:
        return self.in_graph(A.Var("g")).select("g").distinct()

    def nodes(self, graph: A.Node | None) -> DataFrame:
        rows = self.in_graph(graph)
        return rows.select(F.col("s").alias("n")).unionAll(rows.select(F.col("o").alias("n"))).distinct()

    def star(self, triples: list[A.Triple], graph: A.Node | None) -> list[Solutions]:
        """A scan for each pattern, the most selective first; fixed places become filters that reach the files."""
        return [self.scan(t, graph) for t in self.ranked(triples)]

    def ranked(self, triples: list[A.Triple]) -> list[A.Triple]:
        if self.order == "written":
            return list(triples)
        fixed = [[not isinstance(n, A.Var) for n in (t.s, t.o, t.p)] for t in triples]
        if self.order == "fixed":
            return [t for _, t in sorted(zip(fixed, triples, strict=True), key=lambda x: x[0], reverse=True)]
        of = dict(self.weights)
        all_, least = sum(of.values()), min(of.values(), default=0)

        def expected(t: A.Triple, f: list[bool]) -> float:
            n = of.get(t.p.value, least) if isinstance(t.p, A.Iri) else all_
            return n ** (1.0, 0.5, 0.0)[f[0] + f[1]]  # a fixed end leaves the square root, two leave a row

        return [t for _, t in sorted(zip((expected(t, f) for t, f in zip(triples, fixed, strict=True)), triples, strict=True), key=lambda x: x[0])]

    def weighted(self, most: int = 1000) -> QuadSource:
        """This source with the rows of its most frequent predicates as weights; one that isn't among them weighs like the least."""
        rows = self.quads.groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").limit(most).collect()
        return replace(self, order="weighted", weights=tuple((r["p"], r["n"]) for r in rows))

    def scan(self, t: A.Triple, graph: A.Node | None) -> Solutions:
        rows, cols, info = self.in_graph(graph), {}, {}
        places: list[tuple[A.Node, Column, Info]] = [(t.s, F.col("s"), Info("term")), (t.p, F.col("p"), Info("iri", "")), (t.o, F.col("o"), Info("term"))]
        if isinstance(graph, A.Var):
            places.append((graph, F.col("g"), Info("iri", "")))
        condition: Column | None = None

        def also(c: Column) -> None:
            nonlocal condition
            condition = c if condition is None else condition & c

        for node, col, kind in places:
            if isinstance(node, A.Var):
                if node.name in cols:
                    a, b = Val(info[node.name].kind, cols[node.name], info[node.name].extra), Val(kind.kind, col, kind.extra)
                    also(a.col == b.col if a.kind == b.kind else as_term(a).col == as_term(b).col)
                else:
                    cols[node.name], info[node.name] = col, kind
            elif kind.kind == "iri":
                also(col == (node.value if isinstance(node, A.Iri) else F.lit(None)))
            else:
                v = as_term(constant(node)).col
                if isinstance(node, A.Iri):  # plain comparisons of fields can be pushed down
                    also((col["kind"] == IRI) & (col["lex"] == node.value))
                elif isinstance(node, A.Literal) and not node.lang:
                    also((col["kind"] == 2) & (col["lex"] == node.value) & (col["dt"] == node.datatype))
                else:
                    also(col == v)
        if condition is not None:
            rows = rows.filter(condition)
        return Solutions(rows.select(*(c.alias(column(n)) for n, c in cols.items())), info)

