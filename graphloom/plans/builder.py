"""A fluent builder of queries: select("x").where("?x", "a", ":C").filter("?y > 3").limit(5)."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from graphloom.plans import algebra as A
from graphloom.plans.parser import Parser


class Builder:
    """Each method returns a new builder; build() gives the query for the engine."""

    def __init__(self, form: str = "SELECT", prefixes: dict[str, str] | None = None):
        self.prefixes = dict(prefixes or {})
        self.q = A.Query(form, A.Bgp(()))
        self.conditions: tuple[Any, ...] = ()

    def _with(self, **changes: Any) -> Builder:
        out = Builder(self.q.form, self.prefixes)
        out.conditions = changes.pop("conditions", self.conditions)
        out.q = replace(self.q, **changes)
        return out

    def _parser(self, text: str) -> Parser:
        return Parser(text, self.prefixes)

    def prefix(self, name: str, iri: str) -> Builder:
        out = self._with()
        out.prefixes[name] = iri
        return out

    def select(self, *items: str) -> Builder:
        """Names, or "expression AS ?name"."""
        got = []
        for i in items:
            if " AS " in i:
                text, name = i.rsplit(" AS ", 1)
                got.append((name.strip().lstrip("?$"), self._parser(text).expression()))
            else:
                got.append((i.lstrip("?$"), None))
        return self._with(projection=got or None)

    def distinct(self) -> Builder:
        return self._with(distinct=True)

    def where(self, s: str, p: str, o: str) -> Builder:
        found: list[A.Triple] = []
        self._parser(f"{s} {p} {o}").triples(found)
        old = self.q.pattern
        if isinstance(old, A.Bgp):
            return self._with(pattern=A.Bgp(old.triples + tuple(found)))
        return self._with(pattern=A.Join(old, A.Bgp(tuple(found))))

    def optional(self, inner: Builder) -> Builder:
        condition = inner.conditions[0] if inner.conditions else None
        for c in inner.conditions[1:]:
            condition = A.Call("&&", (condition, c))
        return self._with(pattern=A.LeftJoin(self.q.pattern, inner.q.pattern, condition))

    def union(self, *others: Builder) -> Builder:
        out = self.pattern()
        for o in others:
            out = A.Union_(out, o.pattern())
        return self._with(pattern=out, conditions=())

    def minus(self, inner: Builder) -> Builder:
        return self._with(pattern=A.Minus(self.q.pattern, inner.pattern()))

    def graph(self, name: str, inner: Builder) -> Builder:
        g = A.Graph(self._parser(name).term(), inner.pattern())
        return self._with(pattern=g if self.q.pattern == A.Bgp(()) else A.Join(self.q.pattern, g))

    def sub_query(self, inner: Builder) -> Builder:
        s = A.SubQuery(inner.build())
        return self._with(pattern=s if self.q.pattern == A.Bgp(()) else A.Join(self.q.pattern, s))

    def filter(self, text: str) -> Builder:
        return self._with(conditions=(*self.conditions, self._parser(text).expression()))

    def exists(self, inner: Builder, wanted: bool = True) -> Builder:
        return self._with(conditions=(*self.conditions, A.Exists(inner.pattern(), wanted)))

    def bind(self, text: str, name: str) -> Builder:
        return self._with(pattern=A.Extend(self.q.pattern, name.lstrip("?$"), self._parser(text).expression()))

    def values(self, name: str, *items: str) -> Builder:
        v = A.Values((name.lstrip("?$"),), tuple((self._parser(i).term(),) for i in items))
        return self._with(pattern=v if self.q.pattern == A.Bgp(()) else A.Join(self.q.pattern, v))

    def group_by(self, *items: str) -> Builder:
        return self._with(group=[(self._parser(i).expression(), None) for i in items])

    def having(self, text: str) -> Builder:
        return self._with(having=[*self.q.having, self._parser(text).expression()])

    def order_by(self, text: str, ascending: bool = True) -> Builder:
        return self._with(order=[*self.q.order, (self._parser(text).expression(), ascending)])

    def limit(self, n: int) -> Builder:
        return self._with(limit=n)

    def offset(self, n: int) -> Builder:
        return self._with(offset=n)

    def construct(self, *triples: tuple[str, str, str]) -> Builder:
        found: list[A.Triple] = []
        for t in triples:
            self._parser(" ".join(t)).triples(found)
        return self._with(form="CONSTRUCT", template=found)

    def pattern(self) -> Any:
        out = self.q.pattern
        for c in self.conditions:
            out = A.Filter(out, c)
        return out

    def build(self) -> A.Query:
        return replace(self.q, pattern=self.pattern())


def select(*items: str, prefixes: dict[str, str] | None = None) -> Builder:
    return Builder("SELECT", prefixes).select(*items)


def ask(prefixes: dict[str, str] | None = None) -> Builder:
    return Builder("ASK", prefixes)
