"""Typed values: a Spark column with what is known of its RDF type.

A value whose type is known statically stays a plain column (long, double, string, timestamp ...), so that comparisons and
aggregates are ordinary Spark expressions; anything else is a term, a struct(kind, lex, dt, lang) whose equality is sameTerm.
NULL stands for unbound and for an expression error alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.plans.algebra import RDF, XSD, Blank, Iri, Literal, Node, Quoted, Var

IRI, BLANK, LITERAL, TRIPLE = 0, 1, 2, 3
TERM_TYPE = "struct<kind:int,lex:string,dt:string,lang:string>"

INTEGERS = [XSD + n for n in "integer nonPositiveInteger negativeInteger long int short byte nonNegativeInteger unsignedLong unsignedInt unsignedShort unsignedByte positiveInteger".split()]
#: Static kinds, and the datatype and Spark type of each.
NATIVE = {"int": (XSD + "integer", "bigint"), "dec": (XSD + "decimal", "decimal(38,18)"), "flt": (XSD + "float", "float"), "dbl": (XSD + "double", "double"), "str": (XSD + "string", "string"), "bool": (XSD + "boolean", "boolean"), "dt": (XSD + "dateTime", "timestamp"), "date": (XSD + "date", "date"), "dur": (XSD + "dayTimeDuration", "interval day to second")}
RANK = {"int": 0, "dec": 1, "flt": 2, "dbl": 3}
KIND_OF = {dt: k for k, (dt, _) in NATIVE.items()} | {i: "int" for i in INTEGERS}


@dataclass(frozen=True)
class Val:
    """kind: a static kind, "iri" (extra is the text before the column's), "lang" (extra is the tag) or "term"."""

    kind: str
    col: Column
    extra: str | None = None

    def like(self, col: Column) -> Val:
        return Val(self.kind, col, self.extra)


def null(kind: str = "str") -> Val:
    return Val(kind, F.lit(None).cast(TERM_TYPE if kind == "term" else NATIVE[kind][1]))


def term_struct(kind: int, lex: Column, dt: Column | str | None = None, lang: Column | str | None = None) -> Column:
    def col(x: Any) -> Column:
        return (F.lit(x) if x is None or isinstance(x, str) else x).cast("string")

    return F.struct(F.lit(kind).alias("kind"), col(lex).alias("lex"), col(dt).alias("dt"), col(lang).alias("lang"))


def duration_text(c: Column) -> Column:
    seconds = F.extract(F.lit("SECOND"), c)
    parts = F.concat(F.lit("P"), F.abs(F.extract(F.lit("DAY"), c)).cast("string"), F.lit("DT"), F.abs(F.extract(F.lit("HOUR"), c)).cast("string"), F.lit("H"), F.abs(F.extract(F.lit("MINUTE"), c)).cast("string"), F.lit("M"), F.regexp_replace(F.abs(seconds).cast("string"), r"\.?0+$", ""), F.lit("S"))
    negative = (F.extract(F.lit("DAY"), c) < 0) | (F.extract(F.lit("HOUR"), c) < 0) | (F.extract(F.lit("MINUTE"), c) < 0) | (seconds < 0)
    return F.concat(F.when(negative, "-").otherwise(""), F.regexp_replace(parts, "MS$", "M0S"))


def text_of(v: Val) -> Column:
    """The lexical form (STR)."""
    if v.kind == "term":
        return F.when(v.col["kind"] != BLANK, v.col["lex"])
    if v.kind == "iri":
        return F.concat(F.lit(v.extra or ""), v.col.cast("string"))
    if v.kind == "dt":
        return F.concat(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.extract(F.lit("SECOND"), v.col) % 1 != 0, F.regexp_replace(F.date_format(v.col, ".SSSSSS"), "0+$", "")).otherwise(""), F.lit("Z"))
    if v.kind == "dur":
        return duration_text(v.col)
    if v.kind == "dec":
        return F.regexp_replace(F.regexp_replace(v.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return v.col.cast("string")


def as_term(v: Val) -> Val:
    if v.kind == "term":
        return v
    if v.kind == "iri":
        out = term_struct(IRI, text_of(v))
    elif v.kind == "lang":
        out = term_struct(LITERAL, v.col, RDF + "langString", v.extra)
    else:
        out = term_struct(LITERAL, text_of(v), NATIVE[v.kind][0])
    return Val("term", F.when(v.col.isNotNull(), out))


def constant(node: Node) -> Val:
    if isinstance(node, Iri):
        return Val("iri", F.lit(node.value), "")
    if isinstance(node, Blank):
        return Val("term", term_struct(BLANK, F.lit(node.label)))
    if isinstance(node, Literal):
        if node.lang:
            return Val("lang", F.lit(node.value), node.lang)
        kind = KIND_OF.get(node.datatype)
        if kind and node.datatype == NATIVE[kind][0] and not (kind == "dt" and zoneless(node.value)) and kind != "date":
            return Val(kind, F.lit(node.value) if kind == "str" else parsed(F.lit(node.value), kind))
        return Val("term", term_struct(LITERAL, F.lit(node.value), node.datatype))
    if isinstance(node, Quoted):
        return quoted(*(constant(x) for x in (node.s, node.p, node.o)))
    raise ValueError(f"not a constant: {node}")


def zoneless(lex: str) -> bool:
    tail = lex[-6:]
    return not (lex.endswith("Z") or (len(lex) > 10 and tail[0] in "+-" and tail[3] == ":"))


def written(t: Column) -> Column:
    """A term in N-Triples."""
    text = t["lex"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(t["lang"].isNotNull(), F.concat(F.lit("@"), t["lang"])).when(t["dt"] == XSD + "string", "").otherwise(F.concat(F.lit("^^<"), t["dt"], F.lit(">"))))
    return F.when(t["kind"] == IRI, F.concat(F.lit("<"), t["lex"], F.lit(">"))).when(t["kind"] == BLANK, F.concat(F.lit("_:"), t["lex"])).when(t["kind"] == TRIPLE, t["lex"]).otherwise(literal)


def quoted(s: Val, p: Val, o: Val) -> Val:
    """A quoted triple: a term whose text is the triple in N-Triples."""
    s, p, o = (as_term(x).col for x in (s, p, o))
    return Val("term", F.when(s.isNotNull() & p.isNotNull() & o.isNotNull(), term_struct(TRIPLE, F.concat(F.lit("<< "), written(s), F.lit(" "), written(p), F.lit(" "), written(o), F.lit(" >>")))))


NODE_PATTERN = r'(<[^<>]*>|_:\S+|"(?:[^"\\\\]|\\\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^<>]*>)?|<< .* >>)'
TRIPLE_PATTERN = "^<< " + NODE_PATTERN + " (<[^<>]*>) " + NODE_PATTERN + " >>$"


def read_term(text: Column) -> Column:
    """A term from N-Triples."""
    literal = r'^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^<>]*)>)?$'
    lex = F.regexp_extract(text, literal, 1)
    # a pair of backslashes is put aside, so that what follows it isn't read as an escape
    for a, b in (("\\\\", "\0"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\0", "\\")):
        lex = F.replace(lex, F.lit(a), F.lit(b))
    lang, dt = F.nullif(F.regexp_extract(text, literal, 2), F.lit("")), F.nullif(F.regexp_extract(text, literal, 3), F.lit(""))
    return (
        F.when(text.startswith("<< "), term_struct(TRIPLE, text))
        .when(text.startswith("<"), term_struct(IRI, F.regexp_extract(text, "^<(.*)>$", 1)))
        .when(text.startswith("_:"), term_struct(BLANK, F.substring(text, F.lit(3), F.length(text))))
        .when(text.startswith('"'), term_struct(LITERAL, lex, F.when(lang.isNotNull(), RDF + "langString").otherwise(F.coalesce(dt, F.lit(XSD + "string"))), F.lower(lang)))
    )


def part_of(t: Column, i: int) -> Column:
    """Subject (1), predicate (2) or object (3) of a quoted triple."""
    return F.when(t["kind"] == TRIPLE, read_term(F.regexp_extract(t["lex"], TRIPLE_PATTERN, i)))


# views of terms


def parsed(lex: Column, kind: str) -> Column:
    """A value of a static kind from its lexical form, NULL if it is none."""
    if kind == "bool":
        return F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)
    if kind == "dur":
        sign = F.when(lex.startswith("-"), -1).otherwise(1)

        def n(pattern: str) -> Column:
            return F.coalesce(F.nullif(F.regexp_extract(lex, pattern, 1), F.lit("")).cast("double"), F.lit(0.0))

        seconds = n(r"(\d+)D") * 86400 + n(r"(\d+)H") * 3600 + n(r"T.*?(\d+)M") * 60 + n(r"(\d+(?:\.\d+)?)S")
        return F.when(lex.rlike(r"^-?P(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$"), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (sign * seconds).cast("decimal(18,6)")))
    if kind in ("flt", "dbl"):
        lex = F.when(lex == "INF", "Infinity").when(lex == "-INF", "-Infinity").otherwise(lex)
        return F.when(~F.lower(lex).rlike("[df]$") | lex.isin("Infinity", "-Infinity"), lex.try_cast(NATIVE[kind][1]))
    if kind == "int":
        return F.when(lex.rlike(r"^[+-]?\d+$"), lex.try_cast("bigint"))
    if kind == "dec":
        return F.when(lex.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), lex.try_cast("decimal(38,18)"))
    if kind == "date":
        return F.substring(lex, 1, 10).try_cast("date")
    return lex.try_cast(NATIVE[kind][1])


def rank(t: Column) -> Column:
    """Place of a term in the promotion of numbers, NULL for others."""
    d = t["dt"]
    return F.when(d.isin(INTEGERS), 0).when(d == XSD + "decimal", 1).when(d == XSD + "float", 2).when(d == XSD + "double", 3)


def number(v: Val) -> Column:
    """As double; NULL if not a number."""
    if v.kind in RANK:
        return v.col.cast("double")
    if v.kind == "term":
        return F.when(rank(v.col).isNotNull(), parsed(v.col["lex"], "dbl"))
    return F.lit(None).cast("double")


def exact(v: Val) -> Column:
    """As decimal; NULL if not an integer or a decimal."""
    if v.kind in ("int", "dec"):
        return v.col.cast("decimal(38,18)")
    if v.kind == "term":
        return F.when(rank(v.col) <= 1, parsed(v.col["lex"], "dec"))
    return F.lit(None).cast("decimal(38,18)")


def rank_of(v: Val) -> Column:
    return F.when(v.col.isNotNull(), F.lit(RANK[v.kind])) if v.kind in RANK else rank(v.col) if v.kind == "term" else F.lit(None).cast("int")


def instant(v: Val) -> Column:
    if v.kind in ("dt", "date"):
        return v.col.cast("timestamp")
    if v.kind == "term":
        return F.when(v.col["dt"].isin(XSD + "dateTime", XSD + "date"), v.col["lex"].try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def interval(v: Val) -> Column:
    if v.kind == "dur":
        return v.col
    if v.kind == "term":
        return F.when(v.col["dt"].isin(XSD + "dayTimeDuration", XSD + "duration"), parsed(v.col["lex"], "dur"))
    return F.lit(None).cast("interval day to second")


def plain(v: Val) -> Column:
    """Text of a string or language-tagged literal; NULL for others."""
    if v.kind in ("str", "lang"):
        return v.col
    if v.kind == "term":
        return F.when(v.col["dt"].isin(XSD + "string", RDF + "langString"), v.col["lex"])
    return F.lit(None).cast("string")


def same_text(v: Val, lex: Column) -> Val:
    """A string literal with the tag of v."""
    if v.kind == "term":
        return Val("term", F.when(lex.isNotNull(), term_struct(LITERAL, lex, v.col["dt"], v.col["lang"])))
    return v.like(lex) if v.kind in ("str", "lang") else Val("str", lex)


def truth(v: Val) -> Column:
    """Effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind in RANK:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind in ("str", "lang"):
        return v.col != ""
    if v.kind == "term":
        n = parsed(v.col["lex"], "dbl")
        return F.when(v.col["dt"] == XSD + "boolean", F.coalesce(parsed(v.col["lex"], "bool"), F.lit(False))).when(rank(v.col).isNotNull(), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))).when(plain(v).isNotNull(), plain(v) != "")
    return F.lit(None).cast("boolean")


# comparison


def same_term(a: Val, b: Val) -> Column:
    if a.kind == b.kind == "iri":
        return a.col == b.col if a.extra == b.extra else text_of(a) == text_of(b)
    if a.kind == b.kind and a.kind not in ("term", "lang"):
        return a.col == b.col
    return as_term(a).col == as_term(b).col


def equal(a: Val, b: Val) -> Column:
    """Value equality; an error where values of unknown types differ."""
    if a.kind in RANK and b.kind in RANK:
        return a.col == b.col if a.kind == b.kind else number(a) == number(b)
    if a.kind == b.kind and a.kind != "term" and a.kind != "lang":
        return same_term(a, b)
    x, y = as_term(a).col, as_term(b).col
    known = XSD + "string", RDF + "langString", XSD + "boolean"
    zone_a, zone_b = (F.lit(True) if v.kind == "dt" else x_["lex"].rlike(r"(Z|[+-]\d\d:\d\d)$") for v, x_ in ((a, x), (b, y)))
    times = x["dt"].isin(XSD + "dateTime", XSD + "date") & (x["dt"] == y["dt"])
    return (
        F.when(x == y, True)
        .when((x["kind"] != LITERAL) | (y["kind"] != LITERAL), False)
        .when(rank_of(a).isNotNull() & rank_of(b).isNotNull(), number(a) == number(b))
        .when(times, F.when(zone_a == zone_b, instant(a) == instant(b)))
        .when((x["dt"] == XSD + "boolean") & (y["dt"] == XSD + "boolean"), parsed(x["lex"], "bool") == parsed(y["lex"], "bool"))
        .when(x["dt"].isin(*known) & y["dt"].isin(*known), False)
        .when((rank_of(a).isNotNull() & y["dt"].isin(*known)) | (rank_of(b).isNotNull() & x["dt"].isin(*known)), False)
    )


def less(a: Val, b: Val, or_equal: bool = False) -> Column:
    """a < b; an error for what has no order."""

    def op(x: Column, y: Column) -> Column:
        return x <= y if or_equal else x < y

    if a.kind in RANK and b.kind in RANK:
        return op(a.col, b.col) if a.kind == b.kind else op(number(a), number(b))
    if a.kind == b.kind and a.kind in ("str", "bool", "dt", "date", "dur"):
        return op(a.col, b.col)
    x, y = as_term(a).col, as_term(b).col
    return (
        F.when(rank_of(a).isNotNull() & rank_of(b).isNotNull(), op(number(a), number(b)))
        .when((x["dt"] == XSD + "string") & (y["dt"] == XSD + "string"), op(x["lex"], y["lex"]))
        .when((x["dt"] == XSD + "boolean") & (y["dt"] == XSD + "boolean"), op(parsed(x["lex"], "bool"), parsed(y["lex"], "bool")))
        .when(x["dt"].isin(XSD + "dateTime", XSD + "date") & (x["dt"] == y["dt"]), op(instant(a), instant(b)))
        .when(interval(a).isNotNull() & interval(b).isNotNull(), op(interval(a), interval(b)))
    )


def order_key(v: Val) -> Column:
    """A total order: unbound, blank nodes, IRIs, numbers, times, other literals by text; within native kinds the values."""
    if v.kind not in ("term", "iri", "lang"):
        return v.col
    if v.kind == "iri":
        return text_of(v) if v.extra == "" else F.struct(F.lit(v.extra).alias("a"), v.col.alias("b"))
    if v.kind == "lang":
        return v.col
    t = v.col
    kind = F.when(t["kind"] == BLANK, 0).when(t["kind"] == IRI, 1).when(rank(t).isNotNull(), 2).when(instant(v).isNotNull(), 3).when(t["kind"] == LITERAL, 4).when(t["kind"] == TRIPLE, 5)
    return F.when(t.isNotNull(), F.struct(kind.alias("k"), number(v).alias("n"), instant(v).alias("t"), t["lex"].alias("l"), t["lang"].alias("g")))


def is_var(node: Any) -> bool:
    return isinstance(node, Var)
