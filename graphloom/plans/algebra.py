"""Nodes of queries and updates: what the parser makes and the compiler turns into DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Union

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
FN = "http://www.w3.org/2005/xpath-functions#"
AFN = "http://jena.hpl.hp.com/ARQ/function#"
#: Namespace of the extension functions; other namespaces can be declared to mean the same.
EXT = "urn:graphloom:ext#"


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = XSD + "string"
    lang: str | None = None


@dataclass(frozen=True)
class Blank:
    label: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Quoted:
    """A quoted triple; its parts may be variables in patterns."""

    s: "Node"
    p: "Node"
    o: "Node"


Node = Union[Iri, Literal, Blank, Var, Quoted]


@dataclass(frozen=True)
class Triple:
    s: Node
    p: Any  # a node or a path
    o: Node


# paths


@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: Any


@dataclass(frozen=True)
class Sequence:
    first: Any
    then: Any


@dataclass(frozen=True)
class Alternative:
    one: Any
    other: Any


@dataclass(frozen=True)
class Negated:
    forward: tuple[str, ...]
    backward: tuple[str, ...]


@dataclass(frozen=True)
class Repeat:
    """least to most times; most None: without end."""

    path: Any
    least: int
    most: int | None


# expressions


@dataclass(frozen=True)
class Term:
    node: Node


@dataclass(frozen=True)
class Call:
    """A builtin (upper-case name), an operator sign, or a function named by its IRI."""

    name: str
    args: tuple[Any, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Exists:
    pattern: Any
    wanted: bool


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: Any  # None: *
    distinct: bool = False
    separator: str | None = None


# patterns


@dataclass(frozen=True)
class Bgp:
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any


@dataclass(frozen=True)
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass(frozen=True)
class Union_:
    left: Any
    right: Any


@dataclass(frozen=True)
class Minus:
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    inner: Any
    condition: Any


@dataclass(frozen=True)
class Extend:
    inner: Any
    var: str
    expr: Any


@dataclass(frozen=True)
class Values:
    vars: tuple[str, ...]
    rows: tuple[tuple[Node | None, ...], ...]


@dataclass(frozen=True)
class Graph:
    name: Node
    inner: Any


@dataclass(frozen=True)
class Service:
    endpoint: Node
    inner: Any
    silent: bool


@dataclass(frozen=True)
class Frame:
    """Solutions that are there already."""

    solutions: Any


@dataclass(frozen=True)
class SubQuery:
    query: "Query"


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    pattern: Any
    projection: list[tuple[str, Any]] | None = None  # name and expression (None: the variable itself); None: *
    distinct: bool = False
    reduced: bool = False
    template: list[Triple] = field(default_factory=list)
    describe: list[Node] = field(default_factory=list)
    group: list[tuple[Any, str | None]] = field(default_factory=list)
    having: list[Any] = field(default_factory=list)
    order: list[tuple[Any, bool]] = field(default_factory=list)  # expression, ascending
    limit: int | None = None
    offset: int = 0
    values: Values | None = None
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Command:
    """An update command: kind and what it needs."""

    kind: str
    options: dict


def variables(x: Any) -> list[str]:
    """Variables that a pattern can bind, in order of appearance."""
    out: dict[str, None] = {}

    def walk(n: Any) -> None:
        if isinstance(n, Var):
            out.setdefault(n.name)
        elif isinstance(n, Bgp):
            for t in n.triples:
                walk(t.s), walk(t.p), walk(t.o)
        elif isinstance(n, Quoted):
            walk(n.s), walk(n.p), walk(n.o)
        elif isinstance(n, (Join, LeftJoin, Union_)):
            walk(n.left), walk(n.right)
        elif isinstance(n, Minus):
            walk(n.left)
        elif isinstance(n, Filter):
            walk(n.inner)
        elif isinstance(n, Extend):
            walk(n.inner)
            out.setdefault(n.var)
        elif isinstance(n, Values):
            for v in n.vars:
                out.setdefault(v)
        elif isinstance(n, Frame):
            for v in n.solutions.vars:
                out.setdefault(v)
        elif isinstance(n, (Graph, Service)):
            walk(n.name if isinstance(n, Graph) else n.endpoint)
            walk(n.inner)
        elif isinstance(n, SubQuery):
            q = n.query
            for v in [name for name, _ in q.projection] if q.projection is not None else variables(q.pattern):
                out.setdefault(v)

    walk(x)
    return [v for v in out if not v.startswith("_:")]


def expression_variables(e: Any) -> set[str]:
    if isinstance(e, Term):
        return {e.node.name} if isinstance(e.node, Var) else set(variables(e.node))
    if isinstance(e, Call):
        return set().union(*map(expression_variables, e.args))
    if isinstance(e, Aggregate):
        return expression_variables(e.arg) if e.arg is not None else set()
    if isinstance(e, Exists):
        return set(variables(e.pattern))
    return set()


def variables_of(q: Quoted) -> set[str]:
    """Variables inside a quoted triple."""
    return {n.name for n in (q.s, q.p, q.o) if isinstance(n, Var)}.union(*(variables_of(n) for n in (q.s, q.p, q.o) if isinstance(n, Quoted)))
