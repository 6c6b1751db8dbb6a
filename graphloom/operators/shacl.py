"""Validation of shapes (SHACL core, constraints and components in SPARQL): every constraint is one plan over all focus nodes;
results are a table of violations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import BLANK, IRI, LITERAL, TERM_TYPE, Val, less, read_term, text_of
from graphloom.plans import algebra as A
from graphloom.plans.compiler import Compiler, Context
from graphloom.plans.parser import parse_query
from graphloom.plans.solutions import Info, Solutions, column, ref
from graphloom.sources.quads import QuadSource
from graphloom.sources.syntax import rows_in

SH = "http://www.w3.org/ns/shacl#"
RESULT = f"focus {TERM_TYPE}, path string, value {TERM_TYPE}, component string, shape string, severity string, message string"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys (none: all columns) to as many tasks as the session sets. Terms compress so well that adaptive execution, which goes by
    bytes of shuffle files, would merge millions of them into one task; and no scan has to find the distinct ones of a file."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or rows.columns))


class ShapesGraph:
    """A small shapes graph, held on the driver: subject to predicate to objects, in N-Triples."""

    def __init__(self, text: str, how: str = "turtle"):
        self.by: dict[str, dict[str, list[str]]] = {}
        for s, p, o, _ in rows_in(text, how, "shapes"):
            self.by.setdefault(s, {}).setdefault(p[1:-1], []).append(o)

    def all(self, s: str, name: str) -> list[str]:
        return self.by.get(s, {}).get(name if ":" in name else SH + name, [])

    def one(self, s: str, name: str) -> str | None:
        return next(iter(self.all(s, name)), None)

    def items(self, head: str | None) -> list[str]:
        out = []
        while head and head != f"<{A.RDF}nil>":
            out.append(self.one(head, A.RDF + "first"))
            head = self.one(head, A.RDF + "rest")
        return out

    def text(self, s: str, name: str) -> str | None:
        """A string's characters."""
        found = self.one(s, name)
        if found is None:
            return None
        escapes = {"n": "\n", "r": "\r", "t": "\t"}
        return re.sub(r"\\(.)", lambda m: escapes.get(m[1], m[1]), found[1 : found.rindex('"')])

    def query(self, s: str, name: str, path: str | None) -> A.Query:
        """A SELECT or ASK with the prefixes that it names; $PATH stands for the shape's path, which must be one predicate there."""
        declared = [d for p in self.all(s, "prefixes") for d in self.all(p, "declare")]
        prefixes = {self.text(d, "prefix"): self.text(d, "namespace") for d in declared}
        text = self.text(s, name)
        if "$PATH" in text:
            if not (path or "").startswith("<"):
                raise ValueError(f"$PATH stands for one predicate only, not for {path}")
            text = text.replace("$PATH", path)
        return parse_query(text, prefixes=prefixes)

    def components(self) -> list[str]:
        return sorted(s for s in self.by if f"<{SH}ConstraintComponent>" in self.all(s, A.RDF + "type"))

    def parameters(self, component: str) -> list[tuple[str, str, bool]]:
        """Name, predicate, and whether it may be left out."""
        out = []
        for p in self.all(component, "parameter"):
            iri = self.one(p, "path")[1:-1]
            out.append((re.split("[#/:]", iri)[-1], iri, self.one(p, "optional") == f'"true"^^<{A.XSD}boolean>'))
        return out

    def path(self, n: str) -> Any:
        if n.startswith("<"):
            return A.Link(n[1:-1])
        for name, make in (("inversePath", lambda p: A.Inverse(p)), ("zeroOrMorePath", lambda p: A.Repeat(p, 0, None)), ("oneOrMorePath", lambda p: A.Repeat(p, 1, None)), ("zeroOrOnePath", lambda p: A.Repeat(p, 0, 1))):
            if inner := self.one(n, name):
                return make(self.path(inner))
        many = [self.path(x) for x in self.items(self.one(n, "alternativePath") or n)]
        out = many[0]
        for p in many[1:]:
            out = A.Alternative(out, p) if self.one(n, "alternativePath") else A.Sequence(out, p)
        return out


@dataclass
class Validator:
    data: QuadSource
    shapes: ShapesGraph
    compiler: Compiler = field(init=False)

    def __post_init__(self) -> None:
        self.spark = self.data.quads.sparkSession
        self.compiler = Compiler(self.spark, self.data)
        q = self.data.quads.filter("g is null")
        self.types = q.filter(F.col("p") == A.RDF + "type").select(F.col("s").alias("n"), F.col("o").alias("c"))
        self.triples = q

    def term(self, text: str) -> Column:
        return read_term(F.lit(text))

    def instances(self, cls: str) -> DataFrame:
        """(n) of a class or its sub-classes."""
        below = self.compiler.path(A.Var("c"), A.Repeat(A.Link(A.RDFS + "subClassOf"), 0, None), A.Iri(cls[1:-1]), Context()).terms()
        classes = below.df.select(F.col("`?c`").alias("c")).distinct()
        return spread(self.types.join(classes, "c").select("n")).distinct()

    def focus(self, shape: str) -> DataFrame | None:
        parts = [self.spark.range(1).select(self.term(n).alias("n")) for n in self.shapes.all(shape, "targetNode")]
        parts += [self.instances(c) for c in self.shapes.all(shape, "targetClass")]
        if f"<{A.RDFS}Class>" in self.shapes.all(shape, A.RDF + "type"):
            parts.append(self.instances(shape))
        parts += [self.triples.filter(F.col("p") == p[1:-1]).select(F.col("s").alias("n")) for p in self.shapes.all(shape, "targetSubjectsOf")]
        parts += [self.triples.filter(F.col("p") == p[1:-1]).select(F.col("o").alias("n")) for p in self.shapes.all(shape, "targetObjectsOf")]
        out = None
        for p in parts:
            out = p if out is None else out.unionAll(p)
        return None if out is None else spread(out).distinct()

    def validate(self) -> DataFrame:
        out = self.spark.createDataFrame([], RESULT)
        for shape in sorted(self.shapes.by):
            nodes = self.focus(shape)
            if nodes is not None:
                out = out.unionAll(self.check(shape, nodes.select(F.col("n").alias("focus"))))
        return out

    def conforms(self) -> bool:
        return self.validate().isEmpty()

    def check(self, shape: str, focus: DataFrame) -> DataFrame:
        """Violations of a shape by focus(focus)."""
        if self.shapes.one(shape, "deactivated") == f'"true"^^<{A.XSD}boolean>':
            return self.spark.createDataFrame([], RESULT)
        path = self.shapes.one(shape, "path")
        if path:
            steps = self.compiler.path(A.Var("f"), self.shapes.path(path), A.Var("v"), Context()).terms().df
            values = spread(steps.select(F.col("`?f`").alias("focus"), F.col("`?v`").alias("value")).join(focus.hint("merge"), "focus", "left_semi")).distinct()
        else:
            values = focus.select("focus", F.col("focus").alias("value"))
        out = self.spark.createDataFrame([], RESULT)
        for bad, component in self.constraints(shape, focus, values):
            severity = (self.shapes.one(shape, "severity") or f"<{SH}Violation>")[1:-1]
            message = self.shapes.one(shape, "message")
            out = out.unionAll(bad.select("focus", F.lit(path).cast("string").alias("path"), (F.col("value") if "value" in bad.columns else F.lit(None).cast(TERM_TYPE)).alias("value"), F.lit(component if ":" in component else SH + component).alias("component"), F.lit(shape).alias("shape"), F.lit(severity).alias("severity"), (text_of(Val("term", self.term(message))) if message else F.lit(None).cast("string")).alias("message")))
        for inner in self.shapes.all(shape, "property"):
            out = out.unionAll(self.check(inner, spread(values.select(F.col("value").alias("focus"))).distinct()))
        return out

    @staticmethod
    def by_value(sides: DataFrame) -> DataFrame:
        """(focus, value, sides): 1 where a value is on one side only, 2 on the other, 3 on both."""
        return spread(sides, "focus", "value").groupBy("focus", "value").agg(F.bit_or("side").alias("sides"))

    def failing(self, shape: str, values: DataFrame) -> DataFrame:
        """(value) of values that don't conform to a shape."""
        nodes = spread(values.select(F.col("value").alias("focus"))).distinct()
        return spread(self.check(shape, nodes).select(F.col("focus").alias("value"))).distinct()

    def constraints(self, shape: str, focus: DataFrame, values: DataFrame) -> Any:
        g = self.shapes
        v = F.col("value")
        val = Val("term", v)

        def number(x: str) -> int:
            return int(x.split('"')[1])

        def unless(ok: Column) -> DataFrame:
            return values.filter(~F.coalesce(ok, F.lit(False)))

        counted = focus.join(values.groupBy("focus").agg(F.count(v).alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        for x in g.all(shape, "minCount"):
            yield counted.filter(F.col("n") < number(x)), "MinCountConstraintComponent"
        for x in g.all(shape, "maxCount"):
            yield counted.filter(F.col("n") > number(x)), "MaxCountConstraintComponent"
        for x in g.all(shape, "class"):
            yield values.join(self.instances(x).select(F.col("n").alias("value")), "value", "left_anti"), "ClassConstraintComponent"
        for x in g.all(shape, "datatype"):
            yield unless((v["kind"] == LITERAL) & (v["dt"] == x[1:-1])), "DatatypeConstraintComponent"
        for x in g.all(shape, "nodeKind"):
            kinds = {"IRI": [IRI], "BlankNode": [BLANK], "Literal": [LITERAL], "BlankNodeOrIRI": [BLANK, IRI], "BlankNodeOrLiteral": [BLANK, LITERAL], "IRIOrLiteral": [IRI, LITERAL]}
            yield unless(v["kind"].isin(kinds[x[len(SH) + 1 : -1]])), "NodeKindConstraintComponent"
        for name, test in (("minInclusive", lambda c: less(c, val, True)), ("minExclusive", lambda c: less(c, val)), ("maxInclusive", lambda c: less(val, c, True)), ("maxExclusive", lambda c: less(val, c))):
            for x in g.all(shape, name):
                yield unless(test(Val("term", self.term(x)))), name[0].upper() + name[1:] + "ConstraintComponent"
        for x in g.all(shape, "minLength"):
            yield unless((v["kind"] != BLANK) & (F.length(v["lex"]) >= number(x))), "MinLengthConstraintComponent"
        for x in g.all(shape, "maxLength"):
            yield unless((v["kind"] != BLANK) & (F.length(v["lex"]) <= number(x))), "MaxLengthConstraintComponent"
        for x in g.all(shape, "pattern"):
            flags = g.one(shape, "flags")
            text = x[1 : x.rindex('"')].replace("\\\\", "\\")
            yield unless((v["kind"] != BLANK) & F.rlike(v["lex"], F.lit((f"(?{flags[1:-1]})" if flags else "") + text))), "PatternConstraintComponent"
        for x in g.all(shape, "languageIn"):
            tags = [t.split('"')[1].lower() for t in g.items(x)]
            ok = F.lit(False)
            for t in tags:
                ok = ok | (v["lang"] == t) | v["lang"].startswith(t + "-")
            yield unless(ok), "LanguageInConstraintComponent"
        if g.one(shape, "uniqueLang") == f'"true"^^<{A.XSD}boolean>':
            yield values.filter(v["lang"].isNotNull()).groupBy("focus", v["lang"].alias("tag")).count().filter("count > 1").select("focus"), "UniqueLangConstraintComponent"
        for x in g.all(shape, "in"):
            yield unless(v.isin([self.term(i) for i in g.items(x)]) if g.items(x) else F.lit(False)), "InConstraintComponent"
        for x in g.all(shape, "hasValue"):
            has = values.filter(v == self.term(x)).select("focus")
            yield focus.join(has, "focus", "left_anti"), "HasValueConstraintComponent"
        for name in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            for x in g.all(shape, name):
                other = self.triples.filter(F.col("p") == x[1:-1]).select(F.col("s").alias("focus"), F.col("o").alias("other"))
                component = name[0].upper() + name[1:] + "ConstraintComponent"
                if name == "equals":
                    theirs = other.join(focus.hint("merge"), "focus", "left_semi").select("focus", F.col("other").alias("value"))
                    sides = values.select("focus", "value", F.lit(1).alias("side")).unionAll(theirs.withColumn("side", F.lit(2)))
                    yield self.by_value(sides).filter("sides < 3"), component
                else:
                    both = values.join(other.hint("merge"), "focus")
                    o = Val("term", F.col("other"))
                    ok = (v != F.col("other")) if name == "disjoint" else less(val, o, name == "lessThanOrEquals")
                    yield both.filter(~F.coalesce(ok, F.lit(False))).select("focus", "value"), component
        for x in g.all(shape, "node"):
            yield values.join(self.failing(x, values), "value", "left_semi").select("focus", "value"), "NodeConstraintComponent"
        for x in g.all(shape, "not"):
            yield values.join(self.failing(x, values), "value", "left_anti").select("focus", "value"), "NotConstraintComponent"
        for name in ("and", "or", "xone"):
            for x in g.all(shape, name):
                parts = g.items(x)
                fails = None
                for p in parts:
                    f = self.failing(p, values)
                    fails = f if fails is None else fails.unionAll(f)
                n = values.join(fails.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
                bad = {"and": F.col("n") > 0, "or": F.col("n") == len(parts), "xone": F.col("n") != len(parts) - 1}[name]
                yield n.filter(bad).select("focus", "value"), name.title() + "ConstraintComponent"
        for x in g.all(shape, "qualifiedValueShape"):
            good = values.join(self.failing(x, values), "value", "left_anti").groupBy("focus").agg(F.count(v).alias("n"))
            n = focus.join(good, "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            for y in g.all(shape, "qualifiedMinCount"):
                yield n.filter(F.col("n") < number(y)), "QualifiedMinCountConstraintComponent"
            for y in g.all(shape, "qualifiedMaxCount"):
                yield n.filter(F.col("n") > number(y)), "QualifiedMaxCountConstraintComponent"
        if g.one(shape, "closed") == f'"true"^^<{A.XSD}boolean>':
            allowed = [g.one(p, "path")[1:-1] for p in g.all(shape, "property") if (g.one(p, "path") or "").startswith("<")] + [i[1:-1] for i in g.items(g.one(shape, "ignoredProperties"))]
            yield self.triples.join(focus, F.col("s") == F.col("focus"), "left_semi").filter(~F.col("p").isin(allowed)).select(F.col("s").alias("focus"), F.col("o").alias("value")), "ClosedConstraintComponent"

        path = g.one(shape, "path")
        for x in g.all(shape, "sparql"):
            if g.one(x, "deactivated") != f'"true"^^<{A.XSD}boolean>':
                yield self.selected(g.query(x, "select", path), focus, {}), "SPARQLConstraintComponent"
        for component in g.components():
            given = {name: g.one(shape, iri) for name, iri, _ in g.parameters(component)}
            if all(given[name] or optional for name, _, optional in g.parameters(component)):
                own = g.one(component, "propertyValidator" if path else "nodeValidator") or g.one(component, "validator")
                bound = {name: x for name, x in given.items() if x}
                if own and g.one(own, "ask"):
                    yield self.refused(g.query(own, "ask", path), values, bound), component[1:-1]
                elif own:
                    yield self.selected(g.query(own, "select", path), focus, bound), component[1:-1]

    def bound_in(self, q: A.Query, rows: DataFrame, bound: dict[str, str]) -> A.Query:
        """A query whose pattern starts from rows, a column of terms for each variable, and from parameters."""
        columns = {**{n: F.col(n) for n in rows.columns}, **{n: self.term(x) for n, x in bound.items()}}
        start = A.Frame(Solutions(rows.select(*(c.alias(column(n)) for n, c in columns.items())), {n: Info("term") for n in columns}))

        def first(p: Any) -> Any:
            if isinstance(p, (A.Filter, A.Extend)):
                return replace(p, inner=first(p.inner))
            if isinstance(p, (A.LeftJoin, A.Minus)):
                return replace(p, left=first(p.left))
            if isinstance(p, A.Union_):
                return replace(p, left=first(p.left), right=first(p.right))
            return A.Join(start, p)

        return replace(q, pattern=first(q.pattern))

    def selected(self, q: A.Query, focus: DataFrame, bound: dict[str, str]) -> DataFrame:
        """(focus, value): a violation for each solution; its ?value, or the focus node where there is none."""
        q = self.bound_in(q, focus.select(F.col("focus").alias("this")), bound)
        s = self.compiler.select(q, Context()).terms()
        value = F.coalesce(ref("value"), ref("this")) if "value" in s.vars else ref("this")
        return s.df.select(ref("this").alias("focus"), value.alias("value"))

    def refused(self, q: A.Query, values: DataFrame, bound: dict[str, str]) -> DataFrame:
        """(focus, value) for which an ASK has no solution."""
        q = self.bound_in(q, values.select(F.col("focus").alias("this"), "value").distinct(), bound)
        s = self.compiler.pattern(q.pattern, Context()).terms().df.select(ref("this").alias("focus"), ref("value").alias("value")).distinct()
        return values.join(s, ["focus", "value"], "left_anti")


def validate(data: QuadSource, shapes: str, how: str = "turtle") -> DataFrame:
    return Validator(data, ShapesGraph(shapes, how)).validate()
