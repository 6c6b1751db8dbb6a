"""DESCRIBE: eight ways to choose the triples that describe a resource."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import BLANK, IRI, as_term, constant, term_struct
from graphloom.plans import algebra as A
from graphloom.staging import kept

if TYPE_CHECKING:
    from graphloom.plans.compiler import Compiler

WAYS = ("cbd", "symmetric", "subject", "object", "simple", "labelled", "minimal-spanning", "named-graph")


def triples_of(c: Compiler) -> DataFrame:
    s = c.source.star([A.Triple(A.Var("s"), A.Var("p"), A.Var("o"))], None)[0].terms()
    return s.df.select(F.col("`?s`").alias("s"), F.col("`?p`").alias("p"), F.col("`?o`").alias("o"))


def resources(c: Compiler, q: A.Query) -> DataFrame:
    """(n) the nodes to describe."""
    from graphloom.plans.compiler import Context

    names = [n.name for n in q.describe if isinstance(n, A.Var)]
    out = c.spark.range(1).select(F.explode(F.array(*(as_term(constant(n)).col for n in q.describe if not isinstance(n, A.Var)))).alias("n")) if any(not isinstance(n, A.Var) for n in q.describe) else None
    if names:
        s = c.select(replace(q, form="SELECT", projection=[(n, None) for n in names]), Context())
        for n in names:
            part = s.df.select(as_term(s.val(n)).col.alias("n")).filter(F.col("n").isNotNull())
            out = part if out is None else out.unionAll(part)
    return out.distinct()


def describe(c: Compiler, q: A.Query, way: str = "cbd") -> DataFrame:
    """cbd: outgoing triples, and those of blank nodes reached; symmetric: also incoming ones; subject, object: only outgoing or
    incoming; simple: both; labelled: outgoing ones and the rdfs:label of the blank nodes they name; minimal-spanning: both ways through blank nodes;
    named-graph: what the graphs of those names hold."""
    if way not in WAYS:
        raise ValueError(f"no way {way} to describe")
    all_ = triples_of(c)
    front = kept(resources(c, q), "described")

    if way == "named-graph":
        held = c.source.star([A.Triple(A.Var("s"), A.Var("p"), A.Var("o"))], A.Var("g"))[0].terms().df
        found = held.join(front.select(F.col("n").alias("?g")), "?g", "left_semi")
        return found.select(*(F.col(f"`?{x}`").alias(x) for x in "spo")).distinct()

    def leaving(nodes: DataFrame) -> DataFrame:
        return all_.join(nodes, all_["s"] == nodes["n"], "left_semi")

    def coming(nodes: DataFrame) -> DataFrame:
        return all_.join(nodes, all_["o"] == nodes["n"], "left_semi")

    out = coming(front) if way == "object" else leaving(front)
    if way in ("simple", "symmetric", "minimal-spanning"):
        out = out.unionAll(coming(front))
    seen = front
    while way in ("cbd", "symmetric", "minimal-spanning"):
        ends = out.select(F.col("o").alias("n"))
        if way == "minimal-spanning":
            ends = ends.unionAll(out.select(F.col("s").alias("n")))
        front = kept(ends.filter(F.col("n.kind") == BLANK).distinct().join(seen, "n", "left_anti"), "described")
        if front.isEmpty():
            break
        seen = kept(seen.unionAll(front), "described")
        out = kept(out.unionAll(leaving(front) if way != "minimal-spanning" else leaving(front).unionAll(coming(front))).distinct(), "description")
    if way == "labelled":
        names = out.select(F.col("o").alias("n")).filter(F.col("n.kind") == BLANK).distinct()
        labels = all_.filter(F.col("p.lex") == A.RDFS + "label")
        out = out.unionAll(labels.join(names, labels["s"] == names["n"], "left_semi"))
    return out.distinct()


def iri(text: str):  # noqa: ANN201
    return term_struct(IRI, F.lit(text))
