"""Queries to DataFrames. Nothing runs here except the rounds of unbounded property paths."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.aggregates import aggregate
from graphloom.functions.builtins import Function, call
from graphloom.functions.values import NATIVE, TERM_TYPE, Val, as_term, constant, null, order_key, part_of, quoted, same_term, text_of, truth, written
from graphloom.operators.paths import closure
from graphloom.plans import algebra as A
from graphloom.plans import solutions as S
from graphloom.plans.solutions import Info, Solutions, column, ref
from graphloom.staging import kept

Env = Callable[[str], Val | None]


class Source(Protocol):
    """What holds the triples. graph: None (the default graph), an IRI, or a variable over the named graphs."""

    def star(self, triples: list[A.Triple], graph: A.Node | None) -> list[Solutions]:
        """Solutions of triples with plain predicates, grouped as the source likes; to be joined."""

    def nodes(self, graph: A.Node | None) -> DataFrame:
        """(n) all subjects and objects, as terms."""

    def graphs(self) -> DataFrame:
        """(g) the names of the named graphs."""


@dataclass(frozen=True)
class Context:
    graph: A.Node | None = None


@dataclass
class Compiler:
    spark: SparkSession
    source: Source
    custom: dict[str, Function] = field(default_factory=dict)
    properties: dict[str, Callable[..., Solutions]] = field(default_factory=dict)
    service: Callable[[str, Any], Solutions] | None = None
    fresh: Any = field(default_factory=itertools.count)

    # patterns

    def identity(self) -> Solutions:
        return Solutions(self.spark.range(1).select(), {})

    def pattern(self, p: Any, c: Context) -> Solutions:
        return getattr(self, "do_" + type(p).__name__.lower().rstrip("_"))(p, c)

    def do_bgp(self, p: A.Bgp, c: Context) -> Solutions:
        plain, rest, parts = [], [], []
        for t in p.triples:
            if isinstance(t.p, A.Iri) and t.p.value in self.properties:
                rest.append((True, t))
            elif isinstance(t.p, (A.Iri, A.Var)):
                plain.append(t)
            else:
                rest.append((False, t))
        plain, hidden = self.unquoted(plain)
        parts = self.source.star(plain, c.graph) if plain else []
        for is_function, t in rest:
            parts.append(self.properties[t.p.value](self, t, c) if is_function else self.path(t.s, t.p, t.o, c))
        out = self.joined(parts)
        for var, q in hidden:
            out = self.opened(out, var, q)
        if not parts and isinstance(c.graph, A.Var):
            return Solutions(self.source.graphs().select(F.col("g").alias(column(c.graph.name))), {c.graph.name: Info("iri", "")})
        return out

    def joined(self, parts: list[Solutions]) -> Solutions:
        """Joins parts so that each shares a variable with those before, if any does."""
        if not parts:
            return self.identity()
        out, rest = parts[0], parts[1:]
        while rest:
            at = next((i for i, x in enumerate(rest) if set(x.vars) & set(out.vars)), 0)
            out = S.join(out, rest.pop(at))
        return out

    def unquoted(self, triples: list[A.Triple]) -> tuple[list[A.Triple], list[tuple[str, A.Quoted]]]:
        """Quoted triples with variables become hidden variables."""
        hidden: list[tuple[str, A.Quoted]] = []

        def one(n: A.Node) -> A.Node:
            if isinstance(n, A.Quoted) and A.variables_of(n):
                hidden.append((f"_:q{next(self.fresh)}", n))
                return A.Var(hidden[-1][0])
            return n

        return [A.Triple(one(t.s), t.p, one(t.o)) for t in triples], hidden

    def opened(self, s: Solutions, var: str, q: A.Quoted) -> Solutions:
        """Matches the parts of a quoted triple."""
        for i, n in enumerate((q.s, q.p, q.o), 1):
            got = Val("term", part_of(as_term(s.val(var)).col, i))
            if isinstance(n, A.Var):
                s = s.filtered(same_term(s.val(n.name), got)) if n.name in s.vars else s.with_val(n.name, got, False).filtered(got.col.isNotNull())
            elif isinstance(n, A.Quoted) and A.variables_of(n):
                inner = f"_:q{next(self.fresh)}"
                s = self.opened(s.with_val(inner, got, False), inner, n)
            else:
                s = s.filtered(same_term(got, constant(n)))
        return s

    def do_join(self, p: A.Join, c: Context) -> Solutions:
        return S.join(self.pattern(p.left, c), self.pattern(p.right, c))

    def do_union(self, p: A.Union_, c: Context) -> Solutions:
        return S.union(self.pattern(p.left, c), self.pattern(p.right, c))

    def do_minus(self, p: A.Minus, c: Context) -> Solutions:
        return S.minus(self.pattern(p.left, c), self.pattern(p.right, c))

    def do_leftjoin(self, p: A.LeftJoin, c: Context) -> Solutions:
        left, right = self.pattern(p.left, c), self.pattern(p.right, c)
        condition = None
        if p.condition is not None:
            if contains_exists(p.condition):
                # the condition needs whole solutions: join, filter, then add what found nothing
                # the numbered rows are used twice, so they are written once
                left = Solutions(kept(left.df.withColumn("?_:row", F.monotonically_increasing_id()), "left"), {**left.vars, "_:row": Info("int")})
                inner = self.filtered(S.join(left, right), p.condition, c)
                out = S.union(inner, S.semi_join(left, inner.keep(["_:row"]), False))
                return out.keep([n for n in out.vars if n != "_:row"])
            condition = lambda env: truth(self.expression(p.condition, env))
        return S.left_join(left, right, condition)

    def do_filter(self, p: A.Filter, c: Context) -> Solutions:
        return self.filtered(self.pattern(p.inner, c), p.condition, c)

    def filtered(self, s: Solutions, e: Any, c: Context) -> Solutions:
        if isinstance(e, A.Call) and e.name == "&&":
            return self.filtered(self.filtered(s, e.args[0], c), e.args[1], c)
        if isinstance(e, A.Call) and e.name == "!" and isinstance(e.args[0], A.Exists):
            e = A.Exists(e.args[0].pattern, not e.args[0].wanted)
        if isinstance(e, A.Exists):
            inner, condition = e.pattern, None
            if isinstance(inner, A.Filter) and not contains_exists(inner.condition) and A.expression_variables(inner.condition) - set(A.variables(inner.inner)):
                test = inner.condition  # it sees variables of the solution that is tested
                inner, condition = inner.inner, lambda env: truth(self.expression(test, env))
            return S.semi_join(s, self.pattern(inner, c), e.wanted, condition)
        s, e = self.marked(s, e, c)
        keep = s.filtered(truth(self.expression(e, s.val)))  # an error drops the row, as NULL does
        return keep.keep([n for n in keep.vars if not n.startswith("_:exists")])

    def marked(self, s: Solutions, e: Any, c: Context) -> tuple[Solutions, Any]:
        """EXISTS inside an expression becomes a column of truth values."""
        if isinstance(e, A.Exists):
            name = f"_:exists{next(self.fresh)}"
            inner = self.pattern(e.pattern, c)
            inner = inner.keep([n for n in inner.vars if n in s.vars])
            inner = Solutions(inner.df.distinct() if inner.vars else inner.df.limit(1), inner.vars).with_val(name, Val("bool", F.lit(True)), False)
            s = S.left_join(s, inner, None)
            return s.with_val(name, Val("bool", (F.coalesce(ref(name), F.lit(False)) == e.wanted)), False), A.Term(A.Var(name))
        if isinstance(e, A.Call):
            args = []
            for a in e.args:
                s, a = self.marked(s, a, c)
                args.append(a)
            return s, replace(e, args=tuple(args))
        return s, e

    def do_extend(self, p: A.Extend, c: Context) -> Solutions:
        s, e = self.marked(self.pattern(p.inner, c), p.expr, c)
        v = self.expression(e, s.val)
        if p.var in s.vars:  # LET on a bound variable keeps what agrees
            old = s.val(p.var)
            s = s.filtered(F.coalesce(same_term(old, v), old.col.isNull()))
            return s.with_val(p.var, v.like(F.coalesce(old.col, v.col)) if (old.kind, old.extra) == (v.kind, v.extra) else Val("term", F.coalesce(as_term(old).col, as_term(v).col)))
        return s.with_val(p.var, v)

    def do_values(self, p: A.Values, c: Context) -> Solutions:
        if not p.rows or not p.vars:
            df = self.spark.range(len(p.rows)).select(*(F.lit(None).cast(TERM_TYPE).alias(column(v)) for v in p.vars))
            return Solutions(df, {v: Info("term", None, True) for v in p.vars})
        table = [[None if n is None else constant(n) for n in row] for row in p.rows]
        info: dict[str, Info] = {}
        for i, v in enumerate(p.vars):
            found = [r[i] for r in table if r[i] is not None]
            kinds = {(x.kind, x.extra) for x in found}
            kind, extra = next(iter(kinds)) if len(kinds) == 1 else ("term", None)
            info[v] = Info(kind, extra, len(found) < len(table))
        types = {n: "string" if i.kind in ("iri", "lang") else TERM_TYPE if i.kind == "term" else NATIVE[i.kind][1] for n, i in info.items()}

        def cell(x: Val | None, i: Info, name: str) -> Column:
            return F.lit(None).cast(types[name]) if x is None else (x.col if i.kind != "term" else as_term(x).col).cast(types[name])

        rows = [F.struct(*(cell(x, info[v], v).alias(column(v)) for x, v in zip(r, p.vars, strict=True))) for r in table]
        return Solutions(self.spark.range(1).select(F.inline(F.array(*rows))), info)

    def do_graph(self, p: A.Graph, c: Context) -> Solutions:
        out = self.pattern(p.inner, Context(p.name))
        if isinstance(p.name, A.Var) and p.name.name not in out.vars:
            names = Solutions(self.source.graphs().select(F.col("g").alias(column(p.name.name))), {p.name.name: Info("iri", "")})
            out = S.join(out, names)
        return out

    def do_service(self, p: A.Service, c: Context) -> Solutions:
        try:
            if self.service is None or not isinstance(p.endpoint, A.Iri):
                raise LookupError("no service is known")
            return self.service(p.endpoint.value, p.inner)
        except Exception:
            if p.silent:
                return self.identity()
            raise

    def do_frame(self, p: A.Frame, c: Context) -> Solutions:
        return p.solutions

    def do_subquery(self, p: A.SubQuery, c: Context) -> Solutions:
        return self.select(p.query, c)

    # paths

    def path(self, s: A.Node, p: Any, o: A.Node, c: Context) -> Solutions:
        if isinstance(p, A.Link):
            return self.do_bgp(A.Bgp((A.Triple(s, A.Iri(p.iri), o),)), c)
        if isinstance(p, A.Inverse):
            return self.path(o, p.path, s, c)
        if isinstance(p, A.Sequence):
            mid = A.Var(f"_:m{next(self.fresh)}")
            out = S.join(self.path(s, p.first, mid, c), self.path(mid, p.then, o, c))
            return out.keep([n for n in out.vars if n != mid.name])
        if isinstance(p, A.Alternative):
            return S.union(self.path(s, p.one, o, c), self.path(s, p.other, o, c))
        if isinstance(p, A.Negated):
            parts = []
            for names, a, b in ((p.forward, s, o), (p.backward, o, s)):
                if names or not (p.forward or p.backward):
                    v = f"_:n{next(self.fresh)}"
                    found = self.do_bgp(A.Bgp((A.Triple(a, A.Var(v), b),)), c)
                    found = found.filtered(~text_of(found.val(v)).isin(list(names)))
                    parts.append(found.keep([n for n in found.vars if n != v]))
            return parts[0] if len(parts) == 1 else S.union(*parts)
        if isinstance(p, A.Repeat):
            return self.repeated(s, p, o, c)
        raise ValueError(f"not a path: {p}")

    def repeated(self, s: A.Node, p: A.Repeat, o: A.Node, c: Context) -> Solutions:
        """Set semantics: pairs reached in least to most steps."""
        if isinstance(c.graph, A.Var):  # each graph has its own paths
            out = None
            for row in self.source.graphs().collect():
                part = self.repeated(s, p, o, Context(A.Iri(row["g"]))).with_val(c.graph.name, Val("iri", F.lit(row["g"]), ""), False)
                out = part if out is None else S.union(out, part)
            return out if out is not None else Solutions(self.identity().df.limit(0), {})
        step = self.path(A.Var("_:a"), p.path, A.Var("_:b"), c)
        kind = S.common_info(step.vars["_:a"], step.vars["_:b"])
        edges = step.df.select(S.converted(step.val("_:a"), kind).alias("a"), S.converted(step.val("_:b"), kind).alias("b")).distinct()
        term = lambda n: None if isinstance(n, A.Var) else self.as_kind(constant(n), kind)
        start, end = term(s), term(o)
        zero = None
        if p.least == 0:
            if start is None and end is None:
                kind = Info("term")
                edges = edges.select(*(as_term(Val(step.vars["_:a"].kind if (step.vars["_:a"].kind, step.vars["_:a"].extra) == (step.vars["_:b"].kind, step.vars["_:b"].extra) else "term", F.col(x), step.vars["_:a"].extra)).col.alias(x) for x in "ab"))
                zero = self.source.nodes(c.graph).select(F.col("n").alias("a"), F.col("n").alias("b"))
            else:
                at = start if start is not None else end
                zero = self.spark.range(1).select(at.alias("a"), at.alias("b"))
        pairs = closure(edges, start, end, max(1, p.least), p.most)
        if zero is not None:
            pairs = pairs.unionAll(zero)
        pairs = pairs.distinct()
        if start is not None:
            pairs = pairs.filter(F.col("a") == start)
        if end is not None:
            pairs = pairs.filter(F.col("b") == end)
        if isinstance(s, A.Var) and isinstance(o, A.Var) and s.name == o.name:
            pairs = pairs.filter("a = b")
        cols = {n.name: x for n, x in ((s, "a"), (o, "b")) if isinstance(n, A.Var)}
        return Solutions(pairs.select(*(F.col(x).alias(column(n)) for n, x in cols.items())), {n: replace(kind, maybe=False) for n in cols})

    def as_kind(self, v: Val, kind: Info) -> Column:
        if (v.kind, v.extra) == (kind.kind, kind.extra):
            return v.col
        if kind.kind == "iri" and v.kind == "iri":  # the key of a row's IRI
            return F.when(v.col.startswith(kind.extra or ""), F.substring(v.col, F.lit(len(kind.extra or "") + 1), F.length(v.col)))
        return as_term(v).col

    # expressions

    def expression(self, e: Any, env: Env) -> Val:
        if isinstance(e, A.Term):
            if isinstance(e.node, A.Var):
                return env(e.node.name) or null("term")
            if isinstance(e.node, A.Quoted):
                return quoted(*(self.expression(A.Term(n), env) for n in (e.node.s, e.node.p, e.node.o)))
            return constant(e.node)
        if isinstance(e, A.Call):
            if e.name == "BOUND":
                v = env(e.args[0].node.name)
                return Val("bool", F.lit(False) if v is None else v.col.isNotNull())
            if e.name == "CALL":
                return call(e.args[0].node.value, [self.expression(a, env) for a in e.args[1:]], self.custom)
            return call(e.name, [self.expression(a, env) for a in e.args], self.custom)
        raise ValueError(f"not an expression here: {e}")

    # queries

    def select(self, q: A.Query, c: Context) -> Solutions:
        """Solutions of a query, projected."""
        s = self.pattern(q.pattern, c)
        if q.values is not None:
            s = S.join(s, self.do_values(q.values, c))
        projection = q.projection
        if projection is None:
            names = A.variables(q.pattern) + (list(q.values.vars) if q.values else [])
            projection = [(n, None) for n in dict.fromkeys(names)]
        if isinstance(c.graph, A.Var) and c.graph.name in s.vars and not q.group:
            projection = [*projection, (c.graph.name, None)]
        order, having = q.order, q.having
        if q.group or any(contains_aggregate(e) for _, e in projection) or any(map(contains_aggregate, having)) or any(contains_aggregate(e) for e, _ in order):
            s, projection, having, order = self.grouped(s, q, projection, c)
        for h in having:
            s = self.filtered(s, h, c)
        for name, e in projection:
            if e is not None:
                s, e = self.marked(s, e, c)
                s = s.with_val(name, self.expression(e, s.val))
            elif name not in s.vars:
                s = s.with_val(name, null("term"))
        names = [n for n, _ in projection]
        keys = []
        for i, (e, up) in enumerate(order):
            s, e = self.marked(s, e, c)
            s = Solutions(s.df.withColumn(f"_order{i}", order_key(self.expression(e, s.val))), s.vars)
            keys.append(F.col(f"_order{i}").asc_nulls_first() if up else F.col(f"_order{i}").desc_nulls_last())
        out = s.df.select(*(ref(n) for n in dict.fromkeys(names)), *(f"_order{i}" for i in range(len(order))))
        if q.distinct or q.reduced:
            out = out.groupBy(*(ref(n) for n in dict.fromkeys(names))).agg(*(F.min(f"_order{i}").alias(f"_order{i}") for i in range(len(order)))) if order else out.distinct()
        if keys:
            out = out.orderBy(*keys)
        if q.offset:
            out = out.offset(q.offset)
        if q.limit is not None and q.limit >= 0:
            out = out.limit(q.limit)
        return Solutions(out.drop(*(f"_order{i}" for i in range(len(order)))), {n: s.vars[n] for n in names})

    def grouped(self, s: Solutions, q: A.Query, projection: list[tuple[str, Any]], c: Context) -> tuple[Solutions, list, list, list]:
        """Groups and aggregates; aggregates in expressions become variables."""
        keys: dict[str, Info] = {}
        for i, (e, name) in enumerate(q.group):
            if isinstance(e, A.Term) and isinstance(e.node, A.Var):
                name = e.node.name
                if name not in s.vars:
                    s = s.with_val(name, null("term"))
            else:
                name = name or f"_:key{i}"
                s = s.with_val(name, self.expression(e, s.val))
            keys[name] = s.vars[name]
        made: dict[A.Aggregate, str] = {}

        def lifted(e: Any) -> Any:
            if isinstance(e, A.Aggregate):
                made.setdefault(e, f"_:agg{len(made)}")
                return A.Term(A.Var(made[e]))
            for i, (k, _) in enumerate(q.group):
                if e == k and not isinstance(k, A.Term):
                    return A.Term(A.Var(q.group[i][1] or f"_:key{i}"))
            return replace(e, args=tuple(map(lifted, e.args))) if isinstance(e, A.Call) else e

        projection = [(n, None if e is None else lifted(e)) for n, e in projection]
        having, order = [lifted(h) for h in q.having], [(lifted(e), up) for e, up in q.order]
        aggs, info = [], dict(keys)
        for a, name in made.items():
            v = None if a.arg is None else self.expression(a.arg, s.val)
            col, kind, extra = aggregate(a.name, v, [F.coalesce(as_term(s.val(n)).col, F.lit(None).cast(TERM_TYPE)) for n in s.vars if not n.startswith("_:")], a.distinct, a.separator)
            aggs.append(col.alias(column(name)))
            info[name] = Info(kind, extra, a.name != "COUNT")
        if keys:
            df = s.df.groupBy(*(ref(n) for n in keys))
            out = df.agg(*aggs) if aggs else s.df.select(*(ref(n) for n in keys)).distinct()
        else:
            out = s.df.agg(*aggs) if aggs else s.df.agg(F.count(F.lit(1)).alias("_n")).select()
        for n, e in projection:
            if e is None and n not in info:
                raise ValueError(f"?{n} is selected but is neither grouped by nor aggregated")
        return Solutions(out, info), projection, having, order

    def ask(self, q: A.Query) -> bool:
        s = self.pattern(q.pattern, Context())
        return not s.df.limit(1).isEmpty()

    def construct(self, q: A.Query) -> DataFrame:
        """Distinct triples (s, p, o) as terms; blank nodes of the template are new for each solution."""
        s = self.select(replace(q, projection=None, template=[]) if not q.group else q, Context())
        return self.instances(s, [(None, t) for t in q.template]).select("s", "p", "o").distinct()

    def instances(self, s: Solutions, template: list[tuple[A.Node | None, A.Triple]]) -> DataFrame:
        """(g, s, p, o) of a template for each solution; what is unbound or no valid triple is left out."""
        row = F.concat_ws("|", *(F.coalesce(written(as_term(s.val(n)).col), F.lit("")) for n in sorted(s.vars))) if s.vars else F.lit("")

        def value(n: A.Node) -> Column:
            if isinstance(n, A.Var):
                if n.name.startswith("_:") and n.name not in s.vars:
                    return as_term(Val("term", F.struct(F.lit(1).alias("kind"), F.concat(F.lit("c"), F.md5(F.concat(row, F.lit(n.name)))).alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")))).col
                v = s.val(n.name)
                return F.lit(None).cast(TERM_TYPE) if v is None else as_term(v).col
            if isinstance(n, A.Quoted):
                return quoted(*(Val("term", value(x)) for x in (n.s, n.p, n.o))).col
            return as_term(constant(n)).col

        parts = [F.struct((F.lit(None).cast(TERM_TYPE) if g is None else value(g)).cast(TERM_TYPE).alias("g"), value(t.s).cast(TERM_TYPE).alias("s"), value(t.p).cast(TERM_TYPE).alias("p"), value(t.o).cast(TERM_TYPE).alias("o")) for g, t in template]
        if not parts:
            return self.spark.createDataFrame([], f"g {TERM_TYPE}, s {TERM_TYPE}, p {TERM_TYPE}, o {TERM_TYPE}")
        out = s.df.select(F.explode(F.array(*parts)).alias("t")).select("t.*")
        return out.filter(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & (F.col("s.kind") != 2) & (F.col("p.kind") == 0))


def contains_exists(e: Any) -> bool:
    return isinstance(e, A.Exists) or (isinstance(e, A.Call) and any(map(contains_exists, e.args)))


def contains_aggregate(e: Any) -> bool:
    return isinstance(e, A.Aggregate) or (isinstance(e, A.Call) and any(map(contains_aggregate, e.args)))
