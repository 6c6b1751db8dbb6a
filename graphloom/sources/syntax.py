"""Readers' inner part: from a document's text to (s, p, o, g), each written in N-Triples; g is "" in the default graph."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urljoin
from xml.etree import ElementTree

from graphloom.plans import algebra as A
from graphloom.plans.parser import Parser, SyntaxProblem

Row = tuple[str, str, str, str]
RDF, XSD = A.RDF, A.XSD
XML = "{http://www.w3.org/XML/1998/namespace}"


def escaped(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")


def literal(value: str, dt: str | None = None, lang: str | None = None) -> str:
    return f'"{escaped(value)}"' + (f"@{lang.lower()}" if lang else f"^^<{dt}>" if dt and dt != XSD + "string" else "")


def written(n: A.Node, scope: str) -> str:
    """A node in N-Triples; blank labels are made unique to the document by its scope."""
    if isinstance(n, A.Iri):
        return f"<{n.value}>"
    if isinstance(n, A.Literal):
        return literal(n.value, n.datatype, n.lang)
    if isinstance(n, A.Var):
        return f"_:{scope}{re.sub(r'[^A-Za-z0-9]', '', n.name)}"
    if isinstance(n, A.Blank):
        return f"_:{scope}{n.label}"
    return f"<< {written(n.s, scope)} {written(n.p, scope)} {written(n.o, scope)} >>"


class Turtle(Parser):
    """Turtle and TriG, with quoted triples."""

    def document(self) -> Iterator[tuple[A.Node | None, A.Triple]]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if (kind == "lang" and text in ("@prefix", "@base")) or self.sees("PREFIX", "BASE"):
                self.next()
                if text.lower().endswith("prefix"):
                    name = self.next()[1].rstrip(":")
                    self.prefixes[name] = self.expand(self.next()[1][1:-1])
                else:
                    self.base = self.expand(self.next()[1][1:-1])
                if kind == "lang":
                    self.need(".")
                continue
            graph: A.Node | None = None
            if self.take("GRAPH"):
                graph = self.term()
            elif kind in ("iri", "pname", "blank") and self.peek(1) == ("sign", "{"):
                graph = self.term()
            if graph is not None or self.sees("{"):
                yield from ((graph, t) for t in self.template())
                continue
            found: list[A.Triple] = []
            self.triples(found)
            self.need(".")
            yield from ((None, t) for t in found)


def turtle(text: str, base: str, scope: str) -> Iterator[Row]:
    for g, t in Turtle(text, base=base).document():
        yield written(t.s, scope), written(t.p, scope), written(t.o, scope), "" if g is None else written(g, scope)


def rdf_xml(text: str, base: str, scope: str) -> Iterator[Row]:
    count = 0
    r = "{" + RDF + "}"

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:{scope}x{count}"

    def iri(x: str) -> str:
        m = re.match(r"\{(.*)\}(.*)", x)
        return f"<{m[1]}{m[2]}>" if m else f"<{x}>"

    def resolve(x: str, at: str) -> str:
        return f"<{urljoin(at, x) if at else x}>"

    def reified(triple: tuple[str, str, str], name: str | None, at: str) -> Iterator[Row]:
        yield (*triple, "")
        if name is not None:
            s = resolve("#" + name, at)
            yield s, f"<{RDF}type>", f"<{RDF}Statement>", ""
            for part, x in zip(("subject", "predicate", "object"), triple, strict=True):
                yield s, f"<{RDF}{part}>", x, ""

    def node(e: Any, at: str, lang: str | None) -> Iterator[Any]:
        """Rows, then the subject as the generator's value."""
        at, lang = e.get(XML + "base", at), e.get(XML + "lang", lang)
        s = resolve(e.get(r + "about"), at) if r + "about" in e.attrib else resolve("#" + e.get(r + "ID"), at) if r + "ID" in e.attrib else f"_:{scope}{e.get(r + 'nodeID')}" if r + "nodeID" in e.attrib else fresh()
        if e.tag != r + "Description":
            yield s, f"<{RDF}type>", iri(e.tag), ""
        for k, v in e.attrib.items():
            if k.startswith(XML) or k in (r + "about", r + "ID", r + "nodeID"):
                continue
            yield s, iri(k), f"<{v}>" if k == r + "type" else literal(v, None, lang), ""
        n = 0
        for c in e:
            p = iri(c.tag)
            if c.tag == r + "li":
                n += 1
                p = f"<{RDF}_{n}>"
            yield from prop(s, p, c, c.get(XML + "base", at), c.get(XML + "lang", lang))
        return s

    def prop(s: str, p: str, c: Any, at: str, lang: str | None) -> Iterator[Row]:
        name, kind = c.get(r + "ID"), c.get(r + "parseType")
        extra = {k: v for k, v in c.attrib.items() if not k.startswith(XML) and k not in (r + "ID", r + "parseType", r + "resource", r + "nodeID", r + "datatype")}
        if kind == "Literal":
            inner = escaped_xml(c)
            yield from reified((s, p, literal(inner, RDF + "XMLLiteral")), name, at)
        elif kind == "Resource":
            b = fresh()
            yield from reified((s, p, b), name, at)
            for x in c:
                yield from prop(b, iri(x.tag), x, at, x.get(XML + "lang", lang))
        elif kind == "Collection":
            cells = [(fresh(), x) for x in c]
            ends = [b for b, _ in cells[1:]] + [f"<{RDF}nil>"]
            yield from reified((s, p, cells[0][0] if cells else f"<{RDF}nil>"), name, at)
            for (b, x), end in zip(cells, ends, strict=True):
                o = yield from node(x, at, lang)
                yield b, f"<{RDF}first>", o, ""
                yield b, f"<{RDF}rest>", end, ""
        elif r + "resource" in c.attrib or r + "nodeID" in c.attrib or extra:
            o = resolve(c.get(r + "resource"), at) if r + "resource" in c.attrib else f"_:{scope}{c.get(r + 'nodeID')}" if r + "nodeID" in c.attrib else fresh()
            yield from reified((s, p, o), name, at)
            for k, v in extra.items():
                yield o, iri(k), f"<{v}>" if k == r + "type" else literal(v, None, lang), ""
        elif len(c):
            o = yield from node(c[0], at, lang)
            yield from reified((s, p, o), name, at)
        else:
            dt = c.get(r + "datatype")
            yield from reified((s, p, literal(c.text or "", dt, None if dt else lang)), name, at)

    def escaped_xml(c: Any) -> str:
        return (c.text or "") + "".join(ElementTree.tostring(x, encoding="unicode") for x in c)

    root = ElementTree.fromstring(text)
    at, lang = root.get(XML + "base", base), root.get(XML + "lang")
    for e in root if root.tag == r + "RDF" else [root]:
        yield from node(e, at, lang)


def rdf_json(text: str, base: str, scope: str) -> Iterator[Row]:
    def ref(x: str) -> str:
        return f"_:{scope}{x[2:]}" if x.startswith("_:") else f"<{x}>"

    for s, ps in json.loads(text).items():
        for p, os in ps.items():
            for o in os:
                yield ref(s), f"<{p}>", literal(o["value"], o.get("datatype"), o.get("lang")) if o["type"] == "literal" else ref(o["value"]), ""


def json_ld(text: str, base: str, scope: str) -> Iterator[Row]:
    """JSON-LD: contexts with prefixes, terms, types, containers, @reverse, @graph, @list, @vocab and @base."""
    count = 0

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:{scope}j{count}"

    def context(c: Any, active: dict) -> dict:
        for part in c if isinstance(c, list) else [c]:
            active = {} if part is None else {**active, **part} if isinstance(part, dict) else active
        return active

    def expand(x: str, c: dict, vocab: bool = False) -> str:
        seen = set()
        while vocab and x in c and x not in seen and c[x] is not None:
            seen.add(x)
            d = c[x]
            x = d if isinstance(d, str) else d.get("@id", x)
        if ":" in x:
            prefix, _, local = x.partition(":")
            if prefix in c and not local.startswith("//"):
                d = c[prefix]
                return expand(d if isinstance(d, str) else d["@id"], c, True) + local
            return x
        if x.startswith("@"):
            return x
        return c.get("@vocab", "") + x if vocab and "@vocab" in c else urljoin(c.get("@base") or base, x)

    def ref(x: str, c: dict) -> str:
        return f"_:{scope}{x[2:]}" if x.startswith("_:") else f"<{expand(x, c)}>"

    def value(v: Any, c: dict, d: dict, g: str) -> Iterator[Any]:
        if isinstance(v, dict) and "@value" in v:
            t, x = v.get("@type"), v["@value"]
            return plain(x, expand(t, c, True) if t else None, v.get("@language"))
        if isinstance(v, dict) and "@list" in v:
            return (yield from listed(v["@list"], c, d, g))
        if isinstance(v, dict):
            return (yield from node(v, c, g))
        if d.get("@type") in ("@id", "@vocab") and isinstance(v, str):
            return f"<{expand(v, c, True)}>" if d["@type"] == "@vocab" else ref(v, c)
        t = d.get("@type")
        return plain(v, expand(t, c, True) if t else None, d.get("@language", c.get("@language")) if isinstance(v, str) and not t else None)

    def plain(x: Any, dt: str | None, lang: str | None) -> str:
        if isinstance(x, bool):
            return literal(str(x).lower(), dt or XSD + "boolean")
        if isinstance(x, int) or (isinstance(x, float) and x.is_integer() and abs(x) < 1e21 and dt != XSD + "double"):
            return literal(str(int(x)), dt or XSD + "integer")
        if isinstance(x, float):
            m, e = f"{x:.15E}".split("E")
            return literal(f"{m.rstrip('0').rstrip('.') if '.' in m and m.rstrip('0')[-1] != '.' else m.rstrip('0') + '0'}E{int(e)}", dt or XSD + "double")
        return literal(x, dt, lang)

    def listed(items: Any, c: dict, d: dict, g: str) -> Iterator[Any]:
        items = items if isinstance(items, list) else [items]
        cells = [fresh() for _ in items]
        for b, x, end in zip(cells, items, [*cells[1:], f"<{RDF}nil>"], strict=False):
            o = yield from value(x, c, d, g)
            yield b, f"<{RDF}first>", o, g
            yield b, f"<{RDF}rest>", end, g
        return cells[0] if cells else f"<{RDF}nil>"

    def node(n: dict, c: dict, g: str) -> Iterator[Any]:
        if "@context" in n:
            c = context(n["@context"], c)
        keys = {k: expand(k, c, True) for k in n if k != "@context"}
        of = {v: k for k, v in keys.items()}
        s = ref(n[of["@id"]], c) if "@id" in of else fresh()
        for k, p in keys.items():
            vs = n[k] if isinstance(n[k], list) else [n[k]]
            d = c.get(k) if isinstance(c.get(k), dict) else {}
            if p == "@type":
                for t in vs:
                    yield s, f"<{RDF}type>", f"_:{scope}{t[2:]}" if t.startswith("_:") else f"<{expand(t, c, True)}>", g
            elif p == "@graph":
                for x in vs:
                    yield from node(x, c, s if "@id" in of or len(keys) > 1 else g)
            elif p == "@reverse":
                for q, xs in n[k].items():
                    for x in xs if isinstance(xs, list) else [xs]:
                        o = (yield from node(x, c, g)) if isinstance(x, dict) else ref(x, c)
                        yield o, f"<{expand(q, c, True)}>", s, g
            elif not p.startswith("@") and ":" in p:
                if d.get("@container") == "@language" and isinstance(n[k], dict):
                    vs = [{"@value": x, "@language": lang} for lang, xs in n[k].items() for x in (xs if isinstance(xs, list) else [xs])]
                if d.get("@container") == "@list":
                    o = yield from listed(n[k], c, d, g)
                    yield s, f"<{p}>", o, g
                    continue
                for v in vs:
                    if v is None:
                        continue
                    if "@reverse" in d:
                        o = (yield from node(v, c, g)) if isinstance(v, dict) else ref(v, c)
                        yield o, f"<{expand(d['@reverse'], c, True)}>", s, g
                        continue
                    o = yield from value(v, c, d, g)
                    yield s, f"<{p}>", o, g
        return s

    data = json.loads(text)
    for x in data if isinstance(data, list) else [data]:
        yield from node(x, {}, "")


def trix(text: str, base: str, scope: str) -> Iterator[Row]:
    def name(e: Any) -> str:
        return e.tag.rpartition("}")[2]

    def one(e: Any) -> str:
        if name(e) == "uri":
            return f"<{(e.text or '').strip()}>"
        if name(e) == "id":
            return f"_:{scope}{(e.text or '').strip()}"
        return literal(e.text or "", e.get("datatype"), e.get(XML + "lang"))

    for graph in ElementTree.fromstring(text):
        g = ""
        for e in graph:
            if name(e) == "triple":
                s, p, o = map(one, e)
                yield s, p, o, g
            else:
                g = one(e)


def separated(mark: str) -> Callable[[str, str, str], Iterator[Row]]:
    """Tables of subject, predicate and object."""

    def read(text: str, base: str, scope: str) -> Iterator[Row]:
        def one(x: str, node: bool) -> str:
            if re.match(r'^(<.*>|".*)$', x, re.DOTALL) or x.startswith("_:"):
                return f"_:{scope}{x[2:]}" if x.startswith("_:") else x
            return f"<{x}>" if node or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:\S*$", x) else literal(x)

        for row in csv.reader(io.StringIO(text), delimiter=mark):
            if len(row) >= 3:
                yield one(row[0], True), one(row[1], True), one(row[2], False), f"<{row[3]}>" if len(row) > 3 and row[3] else ""

    return read


FORMATS: dict[str, Callable[[str, str, str], Iterator[Row]]] = {"turtle": turtle, "trig": turtle, "ntriples": turtle, "rdfxml": rdf_xml, "rdfjson": rdf_json, "jsonld": json_ld, "trix": trix, "csv": separated(","), "tsv": separated("\t")}
ENDINGS = {"ttl": "turtle", "trig": "trig", "nt": "ntriples", "nq": "nquads", "rdf": "rdfxml", "xml": "rdfxml", "rj": "rdfjson", "jsonld": "jsonld", "trix": "trix", "csv": "csv", "tsv": "tsv"}


def scope_of(name: str) -> str:
    return "f" + hashlib.md5(name.encode()).hexdigest()[:8]


def each_row(text: str, how: str, name: str = "", base: str = "") -> Iterator[Row]:
    """Rows of a document, one after the other."""
    if how == "nquads":
        return quads_by_line(text, scope_of(name))
    if how not in FORMATS:
        raise SyntaxProblem(f"no format {how}")
    return FORMATS[how](text, base, scope_of(name))


def rows_in(text: str, how: str, name: str = "", base: str = "") -> list[Row]:
    """All rows of a document."""
    return list(each_row(text, how, name, base))


LINE = re.compile(r'\s*(<<.*>>|<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<<.*>>|<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$')


def quads_by_line(text: str, scope: str) -> Iterator[Row]:
    def own(x: str) -> str:
        return f"_:{scope}{x[2:]}" if x.startswith("_:") else x

    for line in text.splitlines():
        m = LINE.match(line)
        if m:
            yield own(m[1]), m[2], own(m[3]), own(m[4] or "")
        elif line.strip() and not line.strip().startswith("#"):
            raise SyntaxProblem(f"not a quad: {line[:80]!r}")
