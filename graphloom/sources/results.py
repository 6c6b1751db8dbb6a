"""Query results as files: the W3C formats read back, and the formats that describe a result as a graph or for a browser."""

from __future__ import annotations

import csv
import io
import json
import re
from typing import TYPE_CHECKING
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import LITERAL, read_term
from graphloom.plans.algebra import RDF, XSD
from graphloom.sources.files import write_result

if TYPE_CHECKING:
    from graphloom.engine import Result

RS = "http://www.w3.org/2001/sw/DataAccess/tests/result-set#"
SPARQL_XML = "{http://www.w3.org/2005/sparql-results#}"


def literal(lex: str, lang: str | None = None, datatype: str | None = None) -> str:
    """A literal in N-Triples."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lex = lex.replace(a, b)
    return f'"{lex}"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype else "")


def from_json(text: str) -> tuple[list[str], list[dict]] | bool:
    data = json.loads(text)
    if "boolean" in data:
        return bool(data["boolean"])

    def one(c: dict) -> str:
        if c["type"] == "uri":
            return f"<{c['value']}>"
        if c["type"] == "bnode":
            return f"_:{c['value']}"
        if c["type"] == "triple":
            v = c["value"]
            return v if isinstance(v, str) else f"<< {one(v['subject'])} {one(v['predicate'])} {one(v['object'])} >>"
        return literal(c["value"], c.get("xml:lang"), c.get("datatype"))

    return list(data["head"].get("vars", [])), [{n: one(c) for n, c in row.items()} for row in data["results"]["bindings"]]


def from_xml(text: str) -> tuple[list[str], list[dict]] | bool:
    root = ElementTree.fromstring(text)
    answer = root.find(SPARQL_XML + "boolean")
    if answer is not None:
        return (answer.text or "").strip() == "true"

    def one(e: ElementTree.Element) -> str:
        kind, value = e.tag.removeprefix(SPARQL_XML), e.text or ""
        if kind in ("uri", "bnode"):
            return f"<{value}>" if kind == "uri" else f"_:{value}"
        return literal(value, e.get("{http://www.w3.org/XML/1998/namespace}lang"), e.get("datatype"))

    names = [v.get("name") for v in root.iter(SPARQL_XML + "variable")]
    return names, [{b.get("name"): one(b[0]) for b in r.iter(SPARQL_XML + "binding")} for r in root.iter(SPARQL_XML + "result")]


def from_csv(text: str) -> tuple[list[str], list[dict]]:
    """CSV keeps no types: what begins like an absolute IRI is one, the rest are plain literals; an empty field is unbound."""
    head, *rest = list(csv.reader(io.StringIO(text, newline="")))

    def one(x: str) -> str:
        return x if x.startswith("_:") else f"<{x}>" if re.fullmatch(r'[A-Za-z][A-Za-z0-9+.-]*:[^\s<>"]+', x) else literal(x)

    return head, [{n: one(x) for n, x in zip(head, row, strict=True) if x != ""} for row in rest if row or len(head) == 1]


def from_tsv(text: str) -> tuple[list[str], list[dict]]:
    """TSV holds terms as Turtle writes them; bare numbers and truth values have their types."""
    head, *rest = text.removesuffix("\n").split("\n")
    names = [n.strip().removeprefix("?") for n in head.split("\t")] if head.strip() else []
    bare = ((r"[+-]?\d+", "integer"), (r"[+-]?\d*\.\d+", "decimal"), (r"[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+", "double"), ("true|false", "boolean"))

    def one(x: str) -> str:
        return next((literal(x, None, XSD + kind) for pattern, kind in bare if re.fullmatch(pattern, x)), x)

    return names, [{n: one(x) for n, x in zip(names, line.rstrip("\r").split("\t"), strict=True) if x} for line in rest]


READERS = {"json": from_json, "xml": from_xml, "csv": from_csv, "tsv": from_tsv}


def read_result(spark: SparkSession, text: str, how: str = "json") -> DataFrame | bool:
    """A small result document as a term column for each variable, NULL where it is unbound; the answer of an ASK."""
    if how not in READERS:
        raise ValueError(f"no result format {how}")
    got = READERS[how](text)
    if isinstance(got, bool):
        return got
    names, rows = got
    if not names:
        return spark.range(len(rows)).select()
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).select(*(read_term(F.col(f"`{n}`")).alias(n) for n in names))


def as_graph(result: Result) -> str:
    """A result as Turtle in the result-set vocabulary."""
    if result.form == "ASK":
        return f'[] a <{RS}ResultSet> ; <{RS}boolean> "{str(result.answer).lower()}"^^<{XSD}boolean> .\n'
    df = result.terms
    out = [f"_:set <{RDF}type> <{RS}ResultSet> .\n", *(f"_:set <{RS}resultVariable> {literal(n)} .\n" for n in df.columns)]
    for i, r in enumerate(df.collect()):
        out.append(f"_:set <{RS}solution> _:r{i} .\n")
        for j, n in enumerate(df.columns):
            if (t := r[n]) is not None:
                term = literal(t.lex, t.lang, None if t.lang or t.dt == XSD + "string" else t.dt) if t.kind == LITERAL else ("<{}>", "_:{}", "", "{}")[t.kind].format(t.lex)
                out.append(f"_:r{i} <{RS}binding> _:b{i}x{j} .\n_:b{i}x{j} <{RS}variable> {literal(n)} .\n_:b{i}x{j} <{RS}value> {term} .\n")
    return "".join(out)


def with_stylesheet(result: Result, href: str) -> str:
    """The XML format with a stylesheet that a browser applies."""
    head, _, rest = write_result(result, "xml").partition("?>")
    safe = href.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    return f'{head}?>\n<?xml-stylesheet type="text/xsl" href="{safe}"?>{rest}'
