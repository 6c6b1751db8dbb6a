"""Reading files into quads, and writing quads and results to files.

N-Triples and N-Quads are read line by line in Spark; files of the other syntaxes are parsed whole, one to a row, in Arrow batches.
So that no task has to hold much, graphs are written as documents of bounded size.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING, NamedTuple
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import BLANK, IRI, read_term, term_struct, written
from graphloom.plans.algebra import RDF, XSD
from graphloom.sources.quads import SCHEMA, QuadSource
from graphloom.sources.syntax import ENDINGS, each_row, rows_in

if TYPE_CHECKING:
    from graphloom.engine import Result

#: Rows, and characters of their terms, after which write_documents begins another document; rows that one task sorts.
MOST_ROWS, MOST_CHARS, SORTED_ROWS = 20_000, 4_000_000, 200_000


def from_texts(rows: DataFrame) -> DataFrame:
    """Quads from columns s, p, o, g in N-Triples; a set."""
    return rows.select(read_term(F.col("s")).alias("s"), F.regexp_extract("p", "^<(.*)>$", 1).alias("p"), read_term(F.col("o")).alias("o"), F.when(F.col("g") != "", F.regexp_replace("g", "^<(.*)>$", "$1")).alias("g")).distinct()


def read_text(spark: SparkSession, text: str, how: str = "turtle", base: str = "") -> QuadSource:
    """Quads in a small document at hand."""
    rows = rows_in(text, how, "text", base)
    return QuadSource(from_texts(spark.createDataFrame(rows, "s string, p string, o string, g string")) if rows else spark.createDataFrame([], SCHEMA))


def read_files(spark: SparkSession, path: str, how: str | None = None, base: str = "") -> QuadSource:
    how = how or ENDINGS.get(path.removesuffix(".gz").rpartition(".")[2], "turtle")
    if how in ("ntriples", "nquads"):
        return QuadSource(from_texts(by_line(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))))
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for at in range(batch.num_rows):
                name, content = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                content = gzip.decompress(content) if name.endswith(".gz") else content
                for rows in itertools.batched(each_row(content.decode("utf-8-sig"), how, name, base or name), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["s", "p", "o", "g"])

    return QuadSource(from_texts(files.mapInArrow(parse, "s string, p string, o string, g string")))


def by_line(lines: DataFrame, on_error: str = "raise") -> DataFrame:
    """Columns s, p, o, g from lines (value, file) of N-Triples or N-Quads; also for a stream of such lines. Blank lines and comments
    are left out; another line that is no quad is an error that names file and line, or is left out (on_error: raise or skip)."""
    node = r'(<<.*>>|<[^>]*>|_:\S+)'
    obj = r'(<<.*>>|<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
    pattern = rf"^\s*{node}\s+(<[^>]*>)\s+{obj}\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$"
    own = F.concat(F.lit("_:f"), F.substring(F.md5("file"), 1, 8))

    def part(i: int) -> F.Column:
        x = F.regexp_extract("value", pattern, i)
        return F.when(x.startswith("_:"), F.concat(own, F.substring(x, F.lit(3), F.length(x)))).otherwise(x)

    wrong = ~F.col("value").rlike(pattern)
    if on_error == "skip":
        lines = lines.filter(~wrong)
    else:
        lines = lines.filter(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
        lines = lines.withColumn("value", F.when(wrong, F.raise_error(F.concat(F.lit("no quad in "), F.col("file"), F.lit(": "), F.col("value")))).otherwise(F.col("value")))
    return lines.select(*(part(i).alias(n) for i, n in enumerate("spog", 1)))


# writing


def lines_of(quads: DataFrame) -> DataFrame:
    """N-Triples, or N-Quads where a graph is named: a line for each row."""
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise("") if "g" in quads.columns else F.lit("")
    p = F.concat(F.lit("<"), F.col("p"), F.lit(">")) if dict(quads.dtypes)["p"] == "string" else written(F.col("p"))
    return quads.select(F.concat(written(F.col("s")), F.lit(" "), p, F.lit(" "), written(F.col("o")), g, F.lit(" .")).alias("value"))


def write_lines(quads: DataFrame, path: str) -> None:
    lines_of(quads).write.mode("overwrite").text(path)


def to_write(quads: DataFrame) -> DataFrame:
    """Columns that the writers take: terms, and their text (sw, ow)."""
    p = F.col("p") if dict(quads.dtypes)["p"] == "string" else F.col("p.lex")
    g = F.col("g") if "g" in quads.columns else F.lit(None).cast("string")
    return quads.select(F.col("s"), p.alias("p"), F.col("o"), g.alias("g"), written(F.col("s")).alias("sw"), written(F.col("o")).alias("ow"))


def in_order() -> list:
    return [F.col("g").asc_nulls_first(), "sw", "p", "ow"]


def write_text(quads: DataFrame, how: str = "turtle", prefixes: dict[str, str] | None = None) -> str:
    """A small graph as a document: turtle, trig, ntriples, nquads, rdfjson, jsonld, trix, rdfxml, csv, tsv, dot, graphml or html."""
    return document(to_write(quads).orderBy(*in_order()).collect(), how, prefixes)


def write_documents(quads: DataFrame, path: str, how: str = "turtle", *, prefixes: dict[str, str] | None = None, compressed: bool = False, parts: int | None = None, genid: str = "urn:genid:") -> None:
    """A graph of any size as a folder of documents, each whole in itself and of a range of graphs and subjects (parts: how many at
    least). A document has at most MOST_ROWS rows and ends at MOST_CHARS characters, as writers and readers hold it whole; a larger
    range gives several, which begin with another subject unless one subject alone has so many rows.
    A label of a blank node means nothing in another document, so blank nodes become IRIs that begin with genid."""

    def named(t: Column) -> Column:
        return F.when(t["kind"] == BLANK, term_struct(IRI, F.concat(F.lit(genid), t["lex"]))).otherwise(t)

    rows = to_write(quads.withColumn("s", named(F.col("s"))).withColumn("o", named(F.col("o"))))
    # as many ranges as keep the sort of one task small
    rows = rows.repartitionByRange(max(parts or 1, -(-quads.count() // SORTED_ROWS)), F.col("g").asc_nulls_first(), F.col("sw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for b in batches for r in written_rows(b))
        for own in cut(found):
            yield pa.RecordBatch.from_arrays([pa.array([document(own, how, prefixes)], pa.string())], ["value"])

    out = rows.sortWithinPartitions(*in_order()).mapInArrow(run, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1)
    (out.option("compression", "gzip") if compressed else out).text(path)


class Term(NamedTuple):
    kind: int
    lex: str
    dt: str | None
    lang: str | None


class Written(NamedTuple):
    """A row of to_write."""

    s: Term
    p: str
    o: Term
    g: str | None
    sw: str
    ow: str


def written_rows(batch: pa.RecordBatch) -> Iterator[Written]:
    s, p, o, g, sw, ow = batch.columns
    s, o = (map(Term, *(f.to_pylist() for f in t.flatten())) for t in (s, o))
    return map(Written, s, p.to_pylist(), o, *(x.to_pylist() for x in (g, sw, ow)))


def cut(rows: Iterable[Written]) -> Iterator[list[Written]]:
    """Sorted rows, divided into documents. Half a document that ends with its subject is enough."""
    own: list[Written] = []
    chars = 0
    for r in rows:
        full = len(own) >= MOST_ROWS or chars >= MOST_CHARS
        if own and (full or ((len(own) >= MOST_ROWS // 2 or chars >= MOST_CHARS // 2) and (r.g, r.sw) != (own[-1].g, own[-1].sw))):
            yield own
            own, chars = [], 0
        own.append(r)
        chars += len(r.sw) + len(r.p) + len(r.ow)
    if own:
        yield own


def document(rows: list, how: str, prefixes: dict[str, str] | None = None) -> str:
    """Rows of to_write, sorted, as one document."""
    if how in ("ntriples", "nquads"):
        return "".join(f"{r.sw} <{r.p}> {r.ow}{f' <{r.g}>' if r.g and how == 'nquads' else ''} .\n" for r in rows)
    if how in ("csv", "tsv"):
        out = io.StringIO()
        csv.writer(out, delimiter="," if how == "csv" else "\t", lineterminator="\n").writerows((r.s.lex if r.s.kind == IRI else r.sw, r.p, r.o.lex if r.o.kind == IRI else r.ow, *([r.g] if r.g else [])) for r in rows)
        return out.getvalue()
    if how == "rdfjson":
        data: dict = {}
        for r in rows:
            o = {"type": ("uri", "bnode", "literal", "literal")[r.o.kind], "value": ("_:" if r.o.kind == BLANK else "") + r.o.lex}
            if r.o.kind == 2:
                o |= {"lang": r.o.lang} if r.o.lang else {"datatype": r.o.dt} if r.o.dt != XSD + "string" else {}
            data.setdefault(("_:" if r.s.kind == BLANK else "") + r.s.lex, {}).setdefault(r.p, []).append(o)
        return json.dumps(data, indent=1, ensure_ascii=False)
    if how == "jsonld":
        graphs: dict = {}
        for r in rows:
            node = graphs.setdefault(r.g, {}).setdefault(r.sw, {"@id": ("_:" if r.s.kind == BLANK else "") + r.s.lex})
            if r.o.kind == 2:
                v: object = {"@value": r.o.lex} | ({"@language": r.o.lang} if r.o.lang else {"@type": r.o.dt} if r.o.dt != XSD + "string" else {})
            else:
                v = {"@id": ("_:" if r.o.kind == BLANK else "") + r.o.lex}
            if r.p == RDF + "type" and r.o.kind == IRI:
                node.setdefault("@type", []).append(r.o.lex)
            else:
                node.setdefault(r.p, []).append(v)
        out = list(graphs.pop(None, {}).values()) + [{"@id": g, "@graph": list(n.values())} for g, n in graphs.items()]
        return json.dumps(out, indent=1, ensure_ascii=False)
    if how == "trix":

        def one(t, w) -> str:  # noqa: ANN001
            if t.kind == IRI:
                return f"<uri>{escape(t.lex)}</uri>"
            if t.kind == BLANK:
                return f"<id>{escape(t.lex)}</id>"
            return f"<plainLiteral{f' xml:lang={quoteattr(t.lang)}' if t.lang else ''}>{escape(t.lex)}</plainLiteral>" if t.lang or t.dt == XSD + "string" else f"<typedLiteral datatype={quoteattr(t.dt)}>{escape(t.lex)}</typedLiteral>"

        parts = ['<?xml version="1.0" encoding="utf-8"?>\n<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">']
        for g, own in itertools.groupby(rows, lambda r: r.g):
            parts.append("<graph>" + (f"<uri>{escape(g)}</uri>" if g else ""))
            parts += [f"<triple>{one(r.s, r.sw)}<uri>{escape(r.p)}</uri>{one(r.o, r.ow)}</triple>" for r in own]
            parts.append("</graph>")
        return "\n".join([*parts, "</TriX>\n"])
    if how == "rdfxml":
        parts = [f'<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF xmlns:rdf={quoteattr(RDF)}>']
        for r in rows:
            cut = max(r.p.rfind("#"), r.p.rfind("/"), r.p.rfind(":")) + 1
            about = f"rdf:about={quoteattr(r.s.lex)}" if r.s.kind == IRI else f"rdf:nodeID={quoteattr(r.s.lex)}"
            if r.o.kind == IRI:
                inner = f" rdf:resource={quoteattr(r.o.lex)}/>"
            elif r.o.kind == BLANK:
                inner = f" rdf:nodeID={quoteattr(r.o.lex)}/>"
            else:
                inner = (f" xml:lang={quoteattr(r.o.lang)}" if r.o.lang else f" rdf:datatype={quoteattr(r.o.dt)}" if r.o.dt != XSD + "string" else "") + f">{escape(r.o.lex)}</p:{r.p[cut:]}>"
            parts.append(f"<rdf:Description {about}><p:{r.p[cut:]} xmlns:p={quoteattr(r.p[:cut])}{inner}</rdf:Description>")
        return "\n".join([*parts, "</rdf:RDF>\n"])
    if how in ("turtle", "trig"):
        prefixes = prefixes or {}

        def short(w: str) -> str:
            for name, iri in prefixes.items():
                if w.startswith(f"<{iri}") and w[len(iri) + 1 : -1].replace("_", "a").isalnum():
                    return f"{name}:{w[len(iri) + 1 : -1]}"
            return w

        parts = [f"@prefix {n}: <{i}> .\n" for n, i in prefixes.items()]
        for g, own in itertools.groupby(rows, lambda r: r.g):
            if g:
                parts.append(f"<{g}> {{\n")
            subject = None
            for r in own:
                parts.append((f"{' .' if subject else ''}\n{short(r.sw)}" if r.sw != subject else " ;\n   ") + f" {'a' if r.p == RDF + 'type' else short(f'<{r.p}>')} {short(r.ow)}")
                subject = r.sw
            parts.append(" .\n" + ("}\n" if g else ""))
        return "".join(parts)
    if how == "dot":

        def node(t, w) -> str:  # noqa: ANN001
            return json.dumps(t.lex if t.kind == IRI else w, ensure_ascii=False)

        return "digraph {\n" + "".join(f"{node(r.s, r.sw)} -> {node(r.o, r.ow)} [label={json.dumps(r.p)}];\n" for r in rows) + "}\n"
    if how == "graphml":
        number = {w: f"n{i}" for i, w in enumerate(dict.fromkeys(w for r in rows for w in (r.sw, r.ow)))}
        text = {**{r.sw: r.s.lex for r in rows}, **{r.ow: r.o.lex for r in rows}}
        nodes = "".join(f'<node id="{i}"><data key="label">{escape(text[w])}</data></node>\n' for w, i in number.items())
        edges = "".join(f'<edge source="{number[r.sw]}" target="{number[r.ow]}"><data key="edgelabel">{escape(r.p)}</data></edge>\n' for r in rows)
        keys = "".join(f'<key id="{k}" for="{of}" attr.name="label" attr.type="string"/>\n' for k, of in (("label", "node"), ("edgelabel", "edge")))
        return f'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{keys}<graph edgedefault="directed">\n{nodes}{edges}</graph>\n</graphml>\n'
    if how == "html":
        cells = "".join("<tr>" + "".join(f"<td>{escape(x)}</td>" for x in (r.sw, f"<{r.p}>", r.ow)) + "</tr>\n" for r in rows)
        return f"<table>\n<tr><th>subject</th><th>predicate</th><th>object</th></tr>\n{cells}</table>\n"
    raise ValueError(f"no format {how}")


def write_result(result: Result, how: str = "json") -> str:
    """A small result as json, xml, csv or tsv, after the W3C recommendations."""
    if result.form == "ASK":
        if how == "json":
            return json.dumps({"head": {}, "boolean": result.answer})
        if how == "xml":
            return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{str(result.answer).lower()}</boolean></sparql>'
        return str(result.answer).lower() + "\n"
    df = result.terms
    names, rows = df.columns, df.collect()
    if how == "json":

        def cell(t) -> dict:  # noqa: ANN001
            out = {"type": ("uri", "bnode", "literal", "triple")[t.kind], "value": t.lex}
            return out | ({"xml:lang": t.lang} if t.lang else {"datatype": t.dt} if t.kind == 2 and t.dt != XSD + "string" else {})

        return json.dumps({"head": {"vars": names}, "results": {"bindings": [{n: cell(r[n]) for n in names if r[n] is not None} for r in rows]}}, ensure_ascii=False)
    if how == "xml":

        def tag(t) -> str:  # noqa: ANN001
            if t.kind in (IRI, BLANK):
                name = "uri" if t.kind == IRI else "bnode"
                return f"<{name}>{escape(t.lex)}</{name}>"
            extra = f" xml:lang={quoteattr(t.lang)}" if t.lang else f" datatype={quoteattr(t.dt)}" if t.dt != XSD + "string" else ""
            return f"<literal{extra}>{escape(t.lex)}</literal>"

        body = "".join("<result>" + "".join(f"<binding name={quoteattr(n)}>{tag(r[n])}</binding>" for n in names if r[n] is not None) + "</result>" for r in rows)
        return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{"".join(f"<variable name={quoteattr(n)}/>" for n in names)}</head><results>{body}</results></sparql>'
    out = io.StringIO()
    if how == "csv":
        w = csv.writer(out, lineterminator="\r\n")
        w.writerow(names)
        w.writerows([["" if r[n] is None else ("_:" if r[n].kind == BLANK else "") + r[n].lex for n in names] for r in rows])
    else:
        texts = df.select(*(written(F.col(f"`{n}`")).alias(n) for n in names)).collect()
        out.write("\t".join(f"?{n}" for n in names) + "\n")
        for r in texts:
            out.write("\t".join("" if r[n] is None else r[n] for n in names) + "\n")
    return out.getvalue()
