"""Inference: schema entailment (sub-classes, sub-properties, domain, range), SKOS hierarchies, and N3 rules to a fixpoint."""

from __future__ import annotations

import itertools
import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import IRI, LITERAL, term_struct
from graphloom.operators.paths import closure
from graphloom.plans import algebra as A
from graphloom.plans.compiler import Compiler, Context
from graphloom.plans.parser import Parser
from graphloom.sources.quads import QuadSource
from graphloom.staging import kept

SKOS = "http://www.w3.org/2004/02/skos/core#"


def _pairs(schema: DataFrame, predicate: str) -> DataFrame:
    """(a, b) texts of IRIs of a schema predicate."""
    return schema.filter((F.col("p") == predicate) & (F.col("s.kind") == IRI) & (F.col("o.kind") == IRI)).select(F.col("s.lex").alias("a"), F.col("o.lex").alias("b")).distinct()


def _closed(pairs: DataFrame) -> DataFrame:
    """Transitive closure of a schema hierarchy."""
    return kept(closure(pairs, None, None, 1, None).distinct(), "hierarchy")


def rdfs(data: QuadSource, schema: QuadSource | None = None) -> QuadSource:
    """data with what the schema's sub-properties, domains, ranges and sub-classes entail. Hierarchies are closed once; after
    that each rule is one join, in the order in which they feed each other."""
    q = data.quads
    s = (schema or data).quads
    lower, upper = _closed(_pairs(s, A.RDFS + "subPropertyOf")), _closed(_pairs(s, A.RDFS + "subClassOf"))
    more = q.join(lower, q["p"] == lower["a"]).select("s", F.col("b").alias("p"), "o", "g")
    q = kept(q.unionAll(more).distinct(), "inferred")
    domain, range_ = _pairs(s, A.RDFS + "domain"), _pairs(s, A.RDFS + "range")
    typed = [q.join(domain, q["p"] == domain["a"]).select("s", F.lit(A.RDF + "type").alias("p"), term_struct(IRI, F.col("b")).alias("o"), "g"), q.filter(F.col("o.kind") != LITERAL).join(range_, F.col("p") == range_["a"]).select(F.col("o").alias("s"), F.lit(A.RDF + "type").alias("p"), term_struct(IRI, F.col("b")).alias("o"), "g")]
    q = kept(q.unionAll(typed[0]).unionAll(typed[1]).distinct(), "inferred")
    types = q.filter((F.col("p") == A.RDF + "type") & (F.col("o.kind") == IRI))
    classes = types.join(upper, F.col("o.lex") == upper["a"]).select("s", "p", term_struct(IRI, F.col("b")).alias("o"), "g")
    for pairs, name in ((lower, "subPropertyOf"), (upper, "subClassOf")):
        q = q.unionAll(pairs.select(term_struct(IRI, F.col("a")).alias("s"), F.lit(A.RDFS + name).alias("p"), term_struct(IRI, F.col("b")).alias("o"), F.lit(None).cast("string").alias("g")))
    return replace(data, quads=kept(q.unionAll(classes).distinct(), "inferred"))


def skos(data: QuadSource) -> QuadSource:
    """broader and narrower as inverses, their transitive forms, and related as symmetric."""
    q = data.quads
    for a, b in (("broader", "narrower"), ("narrower", "broader"), ("related", "related")):
        q = q.unionAll(q.filter(F.col("p") == SKOS + a).select(F.col("o").alias("s"), F.lit(SKOS + b).alias("p"), F.col("s").alias("o"), "g"))
    q = kept(q.distinct(), "inferred")
    for a in ("broader", "narrower"):
        pairs = q.filter(F.col("p") == SKOS + a).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
        far = closure(pairs, None, None, 1, None)
        q = q.unionAll(far.select(F.col("a").alias("s"), F.lit(f"{SKOS}{a}Transitive").alias("p"), F.col("b").alias("o"), F.lit(None).cast("string").alias("g")))
    return replace(data, quads=kept(q.distinct(), "inferred"))


def parse_rules(text: str, prefixes: dict[str, str] | None = None) -> list[tuple[list[A.Triple], list[A.Triple]]]:
    """Rules { body } => { head } in N3."""
    p = Parser(re.sub(r"@prefix\s+([\w-]*:)\s*(<[^>]*>)\s*\.", r"PREFIX \1 \2 ", text).replace("=>", "="), prefixes)
    out = []
    while True:
        p.prologue()
        if p.peek()[0] == "end":
            return out
        body = p.template()
        p.need("=")
        out.append((body, p.template()))
        p.take(".")


def rules(data: QuadSource, text: str, prefixes: dict[str, str] | None = None, most: int | None = None) -> QuadSource:
    """data with all that the rules entail: rounds until one adds nothing; more than `most`, if given, are an error."""
    parsed, source = parse_rules(text, prefixes), data
    for n in itertools.count(1):
        compiler = Compiler(source.quads.sparkSession, source)
        new = None
        for body, head in parsed:
            found = compiler.instances(compiler.pattern(A.Bgp(tuple(body)), Context()), [(None, t) for t in head])
            found = found.select("s", F.col("p.lex").alias("p"), "o", F.col("g.lex").alias("g"))
            new = found if new is None else new.unionAll(found)
        if new is None:
            return source
        old = source.quads.filter("g is null")
        new = new.distinct()
        new = kept(new.join(old.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select("s", "p", "o", "g"), "entailed")
        if new.isEmpty():
            return source
        if n == most:
            raise RuntimeError(f"the rules still add triples after {most} rounds")
        source = replace(source, quads=kept(source.quads.unionAll(new), "inferred"))
    return source
