"""Recursive-descent parser for SPARQL 1.1 queries and updates, with quoted triples and LET, after the public W3C grammar."""

from __future__ import annotations

import itertools
import re
from typing import Any
from urllib.parse import urljoin

from graphloom.plans import algebra as A

TOKEN = re.compile(
    r"""(?P<space>[\s]+|\#[^\n]*)
    |(?P<iri><(?![<=\s])[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<quote><<|>>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<double>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)|(?P<decimal>\d*\.\d+)|(?P<integer>\d+)
    |(?P<var>[?$]\w+)
    |(?P<blank>_:[\w.\-·]*[\w\-])
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<pname>(?:[^\W\d_][\w.\-·]*)?:(?!=)(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.\-:·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z][A-Za-z0-9_]*)
    |(?P<sign>\^\^|&&|\|\||!=|<=|>=|:=|[{}()\[\].;,=<>!+\-*/|^?])""",
    re.VERBOSE | re.DOTALL,
)
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
#: Aggregates of the extension namespace, used like functions.
EXT_AGGREGATES = {"median", "mode", "nmin", "nmax", "all", "any", "none"}
_ESC = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class SyntaxProblem(ValueError):
    pass


def unescape(s: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESC.get(m[3], "\\" + m[3]), s, flags=re.DOTALL)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = "", aliases: dict[str, str] | None = None):
        self.prefixes, self.base, self.aliases = dict(prefixes or {}), base, aliases or {}
        self.fresh = itertools.count()
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SyntaxProblem(f"unexpected text at {at}: {text[at : at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    # tokens

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def sees(self, *words: str) -> bool:
        kind, text = self.peek()
        return (kind == "word" and text.upper() in words) or (kind in ("sign", "quote") and text in words)

    def take(self, *words: str) -> str | None:
        if self.sees(*words):
            text = self.next()[1]
            return text.upper() if text[0].isalpha() else text
        return None

    def need(self, *words: str) -> str:
        got = self.take(*words)
        if got is None:
            raise SyntaxProblem(f"expected {' or '.join(words)}, found {self.peek()[1]!r}")
        return got

    # names

    def expand(self, iri: str) -> str:
        iri = unescape(iri)
        out = urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) else iri
        for other, own in self.aliases.items():
            if out.startswith(other):
                return own + out[len(other) :]
        return out

    def iri(self) -> str:
        kind, text = self.next()
        if kind == "iri":
            return self.expand(text[1:-1])
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SyntaxProblem(f"undeclared prefix {prefix}:")
            return self.expand(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        raise SyntaxProblem(f"expected an IRI, found {text!r}")

    def prologue(self) -> None:
        while word := self.take("PREFIX", "BASE"):
            if word == "BASE":
                self.base = self.expand(self.next()[1][1:-1])
            else:
                prefix = self.next()[1].rstrip(":")
                self.prefixes[prefix] = self.expand(self.next()[1][1:-1])

    def blank(self) -> A.Var:
        return A.Var(f"_:g{next(self.fresh)}")

    def literal(self) -> A.Literal | None:
        kind, text = self.peek()
        sign = ""
        if kind == "sign" and text in "+-" and self.peek(1)[0] in ("integer", "decimal", "double"):
            sign = self.next()[1]
            kind, text = self.peek()
        if kind in ("integer", "decimal", "double"):
            self.next()
            return A.Literal((sign if sign == "-" else "") + text, A.XSD + kind)
        if kind == "word" and text in ("true", "false"):
            self.next()
            return A.Literal(text, A.XSD + "boolean")
        if kind == "string":
            self.next()
            value = unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.peek()[0] == "lang":
                return A.Literal(value, A.RDF + "langString", self.next()[1][1:].lower())
            if self.take("^^"):
                return A.Literal(value, self.iri())
            return A.Literal(value)
        return None

    def term(self) -> A.Node:
        """A variable, IRI, literal, blank node or quoted triple."""
        kind, text = self.peek()
        if kind == "var":
            self.next()
            return A.Var(text[1:])
        if kind == "blank":
            self.next()
            return A.Var("_:" + text[2:])
        if self.take("<<"):
            s, p, o = self.term(), self.verb(), self.term()
            self.need(">>")
            return A.Quoted(s, p, o)
        found = self.literal()
        return found if found is not None else A.Iri(self.iri())

    def verb(self) -> A.Node:
        if self.peek() == ("word", "a"):
            self.next()
            return A.Iri(A.RDF + "type")
        return self.term()

    # triples

    def node(self, out: list[A.Triple]) -> A.Node:
        """A term, a collection or a blank node with properties, whose triples go to out."""
        if self.take("["):
            b = self.blank()
            if not self.take("]"):
                self.properties(b, out)
                self.need("]")
            return b
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            rest: A.Node = A.Iri(A.RDF + "nil")
            for item in reversed(items):
                cell = self.blank()
                out += [A.Triple(cell, A.Iri(A.RDF + "first"), item), A.Triple(cell, A.Iri(A.RDF + "rest"), rest)]
                rest = cell
            return rest
        return self.term()

    def properties(self, subject: A.Node, out: list[A.Triple]) -> None:
        while True:
            verb = A.Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            if isinstance(verb, A.Link):
                verb = A.Iri(verb.iri)
            while True:
                obj = self.node(out)
                out.append(A.Triple(subject, verb, obj))
                if self.sees("{") and self.peek(1) == ("sign", "|"):
                    raise SyntaxProblem("annotations aren't supported")
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.sees(".", "]", "}") or self.peek()[0] == "end":
                return

    def triples(self, out: list[A.Triple]) -> None:
        start = self.sees("[", "(")
        subject = self.node(out)
        if start and self.sees(".", "}", "{"):
            return
        self.properties(subject, out)

    # paths

    def path(self) -> Any:
        out = self.path_sequence()
        while self.take("|"):
            out = A.Alternative(out, self.path_sequence())
        return out

    def path_sequence(self) -> Any:
        out = self.path_step()
        while self.take("/"):
            out = A.Sequence(out, self.path_step())
        return out

    def path_step(self) -> Any:
        if self.take("^"):
            return A.Inverse(self.path_step())
        if self.take("!"):
            many = bool(self.take("("))
            forward, backward = [], []
            while True:
                (backward if self.take("^") else forward).append(self.link())
                if not (many and self.take("|")):
                    break
            if many:
                self.need(")")
            out: Any = A.Negated(tuple(forward), tuple(backward))
        elif self.take("("):
            out = self.path()
            self.need(")")
        else:
            out = A.Link(self.link())
        while sign := self.take("*", "+", "?") or (self.peek() == ("sign", "{") and self.peek(1)[0] in ("integer",) and self.take("{")):
            if sign == "{":
                least = int(self.next()[1])
                most: int | None = least
                if self.take(","):
                    most = int(self.next()[1]) if self.peek()[0] == "integer" else None
                self.need("}")
                out = A.Repeat(out, least, most)
            else:
                out = A.Repeat(out, int(sign == "+"), 1 if sign == "?" else None)
        return out

    def link(self) -> str:
        if self.peek() == ("word", "a"):
            self.next()
            return A.RDF + "type"
        return self.iri()

    # patterns

    def group(self) -> Any:
        self.need("{")
        if self.sees("SELECT"):
            query = self.select()
            self.need("}")
            return A.SubQuery(query)
        out: Any = None
        filters = []

        def joined(x: Any) -> Any:
            return x if out is None else A.Join(out, x)

        while not self.take("}"):
            if self.take("OPTIONAL"):
                inner = self.group()
                condition = None
                if isinstance(inner, A.Filter):
                    inner, condition = inner.inner, inner.condition
                out = A.LeftJoin(out if out is not None else A.Bgp(()), inner, condition)
            elif self.take("MINUS"):
                out = A.Minus(out if out is not None else A.Bgp(()), self.group())
            elif self.take("FILTER"):
                filters.append(self.constraint())
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                out = self.extended(out, self.next()[1][1:], e)
                self.need(")")
            elif self.take("LET"):
                self.need("(")
                name = self.next()[1][1:]
                self.need(":=")
                out = A.Extend(out if out is not None else A.Bgp(()), name, self.expression())
                self.need(")")
            elif self.take("VALUES"):
                out = joined(self.values())
            elif self.take("GRAPH"):
                name = self.term()
                out = joined(A.Graph(name, self.group()))
            elif self.take("SERVICE"):
                silent = bool(self.take("SILENT"))
                name = self.term()
                out = joined(A.Service(name, self.group(), silent))
            elif self.sees("{"):
                inner = self.group()
                while self.take("UNION"):
                    inner = A.Union_(inner, self.group())
                out = joined(inner)
            elif self.take("."):
                pass
            else:
                found: list[A.Triple] = []
                while not self.sees("}", "OPTIONAL", "MINUS", "FILTER", "BIND", "LET", "VALUES", "GRAPH", "SERVICE", "{"):
                    self.triples(found)
                    if not self.take("."):
                        break
                if isinstance(out, A.Bgp):
                    out = A.Bgp(out.triples + tuple(found))
                elif isinstance(out, A.Join) and isinstance(out.right, A.Bgp):
                    out = A.Join(out.left, A.Bgp(out.right.triples + tuple(found)))
                else:
                    out = joined(A.Bgp(tuple(found)))
        out = A.Bgp(()) if out is None else out
        if filters:
            condition = filters[0]
            for f in filters[1:]:
                condition = A.Call("&&", (condition, f))
            out = A.Filter(out, condition)
        return out

    def extended(self, inner: Any, name: str, e: Any) -> Any:
        inner = inner if inner is not None else A.Bgp(())
        if name in A.variables(inner):
            raise SyntaxProblem(f"?{name} is assigned but was used before")
        return A.Extend(inner, name, e)

    def values(self) -> A.Values:
        many = bool(self.take("("))
        names = []
        while self.peek()[0] == "var":
            names.append(self.next()[1][1:])
            if not many:
                break
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            if many:
                self.need("(")
            row = []
            for _ in names:
                row.append(None if self.take("UNDEF") else self.term())
            if many:
                self.need(")")
            rows.append(tuple(row))
        return A.Values(tuple(names), tuple(rows))

    # expressions

    def constraint(self) -> Any:
        if self.sees("("):
            self.next()
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self) -> Any:
        out = self.conjunction()
        while self.take("||"):
            out = A.Call("||", (out, self.conjunction()))
        return out

    def conjunction(self) -> Any:
        out = self.relation()
        while self.take("&&"):
            out = A.Call("&&", (out, self.relation()))
        return out

    def relation(self) -> Any:
        out = self.additive()
        if sign := self.take("=", "!=", "<", ">", "<=", ">="):
            return A.Call(sign, (out, self.additive()))
        if self.sees("IN") or (self.sees("NOT") and self.peek(1)[1].upper() == "IN"):
            name = "NOT IN" if self.take("NOT") else "IN"
            self.need("IN")
            return A.Call(name, (out, *self.arguments()))
        return out

    def additive(self) -> Any:
        out = self.product()
        while sign := self.take("+", "-"):
            out = A.Call(sign, (out, self.product()))
        return out

    def product(self) -> Any:
        out = self.unary()
        while sign := self.take("*", "/"):
            out = A.Call(sign, (out, self.unary()))
        return out

    def unary(self) -> Any:
        if self.take("!"):
            return A.Call("!", (self.unary(),))
        if self.sees("-") and self.peek(1)[0] not in ("integer", "decimal", "double"):
            self.next()
            return A.Call("NEG", (self.unary(),))
        if self.sees("+") and self.peek(1)[0] not in ("integer", "decimal", "double"):
            self.next()
            return self.unary()
        return self.primary()

    def arguments(self) -> list[Any]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def primary(self) -> Any:
        kind, text = self.peek()
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if kind == "word" and text not in ("true", "false"):
            word = self.next()[1].upper()
            if word == "NOT":
                self.need("EXISTS")
                return A.Exists(self.group(), False)
            if word == "EXISTS":
                return A.Exists(self.group(), True)
            if word in AGGREGATES:
                return self.aggregate(word)
            return A.Call(word, tuple(self.arguments()))
        if kind in ("iri", "pname"):
            name = self.iri()
            if not self.sees("("):
                return A.Term(A.Iri(name))
            if name.startswith(A.EXT) and name[len(A.EXT) :] in EXT_AGGREGATES:
                return self.aggregate("ext:" + name[len(A.EXT) :])
            if name == A.FN + "string-join" and self.peek(1)[1].upper() != ")":
                return self.aggregate("STRING_JOIN")
            return A.Call(name, tuple(self.arguments()))
        return A.Term(self.term())

    def aggregate(self, name: str) -> A.Aggregate:
        self.need("(")
        distinct = bool(self.take("DISTINCT"))
        arg = None if self.take("*") else self.expression()
        separator = None
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = self.literal().value
        elif self.take(","):
            if self.take("SEPARATOR"):
                self.need("=")
            separator = self.literal().value
        self.need(")")
        return A.Aggregate(name, arg, distinct, separator)

    # queries

    def query(self) -> A.Query:
        self.prologue()
        if self.sees("SELECT"):
            out = self.select()
        elif self.take("ASK"):
            out = self.rest(A.Query("ASK", None))
        elif self.take("CONSTRUCT"):
            out = A.Query("CONSTRUCT", None)
            if self.sees("{"):
                out.template = self.template()
                out = self.rest(out)
            else:
                self.datasets(out)
                self.need("WHERE")
                at = self.at
                out.template = self.template()
                self.at = at
                out.pattern = self.group()
                out = self.modifiers(out)
        elif self.take("DESCRIBE"):
            out = A.Query("DESCRIBE", A.Bgp(()))
            if not self.take("*"):
                while self.peek()[0] in ("var", "iri", "pname"):
                    out.describe.append(self.term())
            self.datasets(out)
            if self.sees("WHERE", "{"):
                self.take("WHERE")
                out.pattern = self.group()
            out = self.modifiers(out)
            out.describe = out.describe or [A.Var(v) for v in A.variables(out.pattern)]
        else:
            raise SyntaxProblem(f"expected a query, found {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"text after the query: {self.peek()[1]!r}")
        return out

    def template(self) -> list[A.Triple]:
        self.need("{")
        out: list[A.Triple] = []
        while not self.take("}"):
            self.triples(out)
            self.take(".")
        return out

    def select(self) -> A.Query:
        self.need("SELECT")
        out = A.Query("SELECT", None)
        out.distinct, out.reduced = bool(self.take("DISTINCT")), bool(self.take("REDUCED"))
        if not self.take("*"):
            out.projection = []
            while True:
                if self.peek()[0] == "var":
                    out.projection.append((self.next()[1][1:], None))
                elif self.take("("):
                    e = self.expression()
                    self.need("AS")
                    out.projection.append((self.next()[1][1:], e))
                    self.need(")")
                else:
                    break
            if not out.projection:
                raise SyntaxProblem("nothing is selected")
        return self.rest(out)

    def datasets(self, q: A.Query) -> None:
        while self.take("FROM"):
            (q.named_graphs if self.take("NAMED") else q.default_graphs).append(self.iri())

    def rest(self, q: A.Query) -> A.Query:
        self.datasets(q)
        self.take("WHERE")
        q.pattern = self.group()
        return self.modifiers(q)

    def modifiers(self, q: A.Query) -> A.Query:
        if self.take("GROUP"):
            self.need("BY")
            while self.peek()[0] in ("var", "iri", "pname") or self.sees("(") or (self.peek()[0] == "word" and not self.sees("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES")):
                if self.take("("):
                    e = self.expression()
                    name = self.next()[1][1:] if self.take("AS") else None
                    self.need(")")
                    q.group.append((e, name))
                else:
                    q.group.append((self.primary(), None))
        if self.take("HAVING"):
            while self.sees("(") or self.peek()[0] in ("iri", "pname") or (self.peek()[0] == "word" and not self.sees("ORDER", "LIMIT", "OFFSET", "VALUES")):
                q.having.append(self.constraint())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if way := self.take("ASC", "DESC"):
                    q.order.append((self.constraint(), way == "ASC"))
                elif self.sees("(") or self.peek()[0] in ("var", "iri", "pname") or (self.peek()[0] == "word" and not self.sees("LIMIT", "OFFSET", "VALUES")):
                    q.order.append((self.constraint(), True))
                else:
                    break
        while word := self.take("LIMIT", "OFFSET"):
            n = int(self.next()[1])
            if word == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        if self.take("VALUES"):
            q.values = self.values()
        return q

    # updates

    def update(self) -> list[A.Command]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                return out
            out.append(self.command())
            if not self.take(";") and self.peek()[0] != "end":
                raise SyntaxProblem(f"expected ;, found {self.peek()[1]!r}")

    def quads(self) -> list[tuple[A.Node | None, A.Triple]]:
        self.need("{")
        out: list[tuple[A.Node | None, A.Triple]] = []
        while not self.take("}"):
            if self.take("GRAPH"):
                name = self.term()
                out += [(name, t) for t in self.template()]
            else:
                found: list[A.Triple] = []
                self.triples(found)
                out += [(None, t) for t in found]
            self.take(".")
        return out

    def target(self) -> str:
        """An IRI after GRAPH, or DEFAULT, NAMED or ALL."""
        if word := self.take("DEFAULT", "NAMED", "ALL"):
            return word
        self.take("GRAPH")
        return self.iri()

    def command(self) -> A.Command:
        word = self.need("LOAD", "CLEAR", "DROP", "CREATE", "ADD", "MOVE", "COPY", "INSERT", "DELETE", "WITH")
        if word == "LOAD":
            o = {"silent": bool(self.take("SILENT")), "source": self.iri(), "into": None}
            if self.take("INTO"):
                o["into"] = self.target()
            return A.Command(word, o)
        if word in ("CLEAR", "DROP", "CREATE"):
            return A.Command(word, {"silent": bool(self.take("SILENT")), "target": self.target()})
        if word in ("ADD", "MOVE", "COPY"):
            o = {"silent": bool(self.take("SILENT")), "source": self.target()}
            self.need("TO")
            return A.Command(word, o | {"target": self.target()})
        if word in ("INSERT", "DELETE") and self.take("DATA"):
            return A.Command(f"{word} DATA", {"quads": self.quads()})
        o: dict[str, Any] = {"with": None, "delete": [], "insert": [], "using": [], "named": []}
        if word == "WITH":
            o["with"] = self.iri()
            word = self.need("DELETE", "INSERT")
        if word == "DELETE" and self.take("WHERE"):
            at = self.at
            o["delete"] = self.quads()
            self.at = at
            o["pattern"] = self.group()
            return A.Command("MODIFY", o)
        if word == "DELETE":
            o["delete"] = self.quads()
            word = self.take("INSERT")
        if word == "INSERT":
            o["insert"] = self.quads()
        while self.take("USING"):
            o["named" if self.take("NAMED") else "using"].append(self.iri())
        self.need("WHERE")
        o["pattern"] = self.group()
        return A.Command("MODIFY", o)


def parse_query(text: str, **options: Any) -> A.Query:
    return Parser(text, **options).query()


def parse_update(text: str, **options: Any) -> list[A.Command]:
    return Parser(text, **options).update()
