"""Scalar functions: SPARQL builtins, XPath fn:, afn: and the extension library, each from typed values to a typed value."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.values import BLANK, IRI, LITERAL, NATIVE, RANK, TRIPLE, Val, as_term, constant, equal, exact, instant, interval, less, null, number, parsed, part_of, plain, quoted, rank_of, same_term, same_text, term_struct, text_of, truth
from graphloom.plans.algebra import AFN, EXT, FN, RDF, XSD, Literal

Function = Callable[..., Val]
BUILTINS: dict[str, Function] = {}


class Unknown(ValueError):
    pass


def named(*names: str) -> Callable[[Function], Function]:
    def add(f: Function) -> Function:
        for n in names:
            BUILTINS[n] = f
        return f

    return add


def b(c: Column) -> Val:
    return Val("bool", c)


def s(c: Column) -> Val:
    return Val("str", c)


def i(c: Column) -> Val:
    return Val("int", c.cast("bigint"))


def d(c: Column) -> Val:
    return Val("dbl", c)


# operators


def product(x: Column, y: Column) -> Column:
    """Of decimals with 18 digits after the point. Whole and broken parts are multiplied apart, as the type of a plain product keeps six
    of them; with more than 19 digits before the point, the plain product follows."""
    whole = [F.floor(c).try_cast("decimal(19,0)") for c in (x, y)]
    rest = [(c - F.floor(c)).cast("decimal(18,18)") for c in (x, y)]
    parts = [whole[0] * whole[1], whole[0] * rest[1], whole[1] * rest[0], rest[0] * rest[1]]
    out = parts[0].try_cast("decimal(38,18)")
    for part in parts[1:]:
        out = F.try_add(out, part.try_cast("decimal(38,18)")).try_cast("decimal(38,18)")
    return F.coalesce(out, F.try_multiply(x.try_cast("decimal(28,9)"), y.try_cast("decimal(28,9)")).try_cast("decimal(38,18)"))


def quotient(x: Column, y: Column, whole: bool) -> Column:
    """Of integers or decimals, 18 digits after the point where both fit ten digits before and after it, or are integers."""
    if whole:
        return F.try_divide(x.cast("decimal(20,0)"), y.cast("decimal(20,0)")).try_cast("decimal(38,18)")
    fine = [c.try_cast("decimal(20,10)") for c in (x, y)]
    fits = (fine[0] == x) & (fine[1] == y)
    wide = F.try_divide(x.try_cast("decimal(28,9)"), y.try_cast("decimal(28,9)")).try_cast("decimal(38,18)")
    return F.when(fits, F.try_divide(*fine).try_cast("decimal(38,18)")).otherwise(wide)


def arithmetic(op: str, x: Val, y: Val) -> Val:
    """Numbers by promotion, and dateTimes with durations. Errors and division by zero are NULL."""
    if x.kind in RANK and y.kind in RANK:
        top = max(RANK[x.kind], RANK[y.kind])
        if top <= 1 and op == "/":
            return Val("dec", quotient(x.col, y.col, x.kind == y.kind == "int"))
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": lambda u, v: u / F.nullif(v, F.lit(0.0))}[op]
        kind = ("int", "dec", "flt", "dbl")[top]
        if top >= 2:
            if op == "/":  # IEEE: by zero gives an infinity
                u, v = x.col.cast("double"), y.col.cast("double")
                q = F.when(v == 0, F.when(u == 0, F.lit(float("nan"))).when(u > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.try_divide(u, v))
                return Val(kind, q.cast(NATIVE[kind][1]))
            u, v = x.col.cast(NATIVE[kind][1]), y.col.cast(NATIVE[kind][1])
            return Val(kind, u + v if op == "+" else u - v if op == "-" else u * v)
        if top == 1:
            u, v = x.col.cast("decimal(38,18)"), y.col.cast("decimal(38,18)")
            return Val("dec", product(u, v) if op == "*" else f(u, v).try_cast("decimal(38,18)"))
        return Val("int", f(x.col, y.col))
    if x.kind in ("dt", "date") and y.kind == "dur":
        return Val("dt", x.col + y.col if op == "+" else x.col - y.col)
    if x.kind == y.kind == "dur" and op in "+-":
        return Val("dur", x.col + y.col if op == "+" else x.col - y.col)
    if x.kind in ("dt", "date") and x.kind == y.kind and op == "-":
        return Val("dur", (x.col - y.col).cast("interval day to second"))
    if x.kind != "term" and y.kind != "term" and not ({x.kind, y.kind} & set(RANK)):
        return null("int")
    top = F.greatest(rank_of(x), rank_of(y))
    ok = rank_of(x).isNotNull() & rank_of(y).isNotNull()
    e = arithmetic(op, Val("dec", exact(x)), Val("dec", exact(y)))
    approx = arithmetic(op, Val("dbl", number(x)), Val("dbl", number(y)))
    exact_int = (top == 0) & F.lit(op != "/")
    dt = F.when(exact_int, XSD + "integer").when(top <= 1, XSD + "decimal").when(top == 2, XSD + "float").otherwise(XSD + "double")
    lex = F.when(top <= 1, text_of(e)).otherwise(text_of(approx))
    out = F.when(ok & lex.isNotNull(), term_struct(LITERAL, lex, dt))
    if op in "+-" and x.kind not in RANK and y.kind not in RANK:
        moved = instant(x) + interval(y) if op == "+" else instant(x) - interval(y)
        out = F.when(instant(x).isNotNull() & interval(y).isNotNull(), as_term(Val("dt", moved)).col).otherwise(out)
        both = interval(x) + interval(y) if op == "+" else interval(x) - interval(y)
        out = F.when(interval(x).isNotNull() & interval(y).isNotNull(), as_term(Val("dur", both)).col).otherwise(out)
        if op == "-":
            out = F.when(instant(x).isNotNull() & instant(y).isNotNull(), as_term(Val("dur", (instant(x) - instant(y)).cast("interval day to second"))).col).otherwise(out)
    return Val("term", out)


for _op in "+-*/":
    BUILTINS[_op] = (lambda o: lambda x, y: arithmetic(o, x, y))(_op)
named("NEG")(lambda x: arithmetic("-", Val("int", F.lit(0).cast("bigint")), x))
named("=")(lambda x, y: b(equal(x, y)))
named("!=")(lambda x, y: b(~equal(x, y)))
named("<")(lambda x, y: b(less(x, y)))
named(">")(lambda x, y: b(less(y, x)))
named("<=")(lambda x, y: b(less(x, y, True)))
named(">=")(lambda x, y: b(less(y, x, True)))
named("&&")(lambda x, y: b(truth(x) & truth(y)))
named("||")(lambda x, y: b(truth(x) | truth(y)))
named("!", FN + "not")(lambda x: b(~truth(x)))
named(FN + "true")(lambda: b(F.lit(True)))
named(FN + "false")(lambda: b(F.lit(False)))
named(FN + "boolean", XSD + "boolean")(lambda x: b(F.coalesce(truth(x) if x.kind in RANK or x.kind == "bool" else F.when(rank_of(x).isNotNull(), truth(x)), parsed(text_of(x), "bool"))))


@named("IN")
def in_(x: Val, *rest: Val) -> Val:
    out = F.lit(False)
    for y in rest:
        out = out | equal(x, y)
    return b(out)


named("NOT IN")(lambda x, *rest: b(~in_(x, *rest).col))

# functional forms


def common(*vals: Val) -> list[Val]:
    """The values as one kind."""
    if len({(v.kind, v.extra) for v in vals}) == 1:
        return list(vals)
    if all(v.kind in RANK for v in vals):
        kind = ("int", "dec", "flt", "dbl")[max(RANK[v.kind] for v in vals)]
        return [Val(kind, v.col.cast(NATIVE[kind][1])) for v in vals] if kind in ("int",) else [as_term(v) for v in vals]
    return [as_term(v) for v in vals]


@named("IF")
def if_(c: Val, x: Val, y: Val) -> Val:
    x, y = common(x, y)
    return x.like(F.when(truth(c), x.col).when(~truth(c), y.col))


@named("COALESCE")
def coalesce(*xs: Val) -> Val:
    xs_ = common(*xs)
    return xs_[0].like(F.coalesce(*(x.col for x in xs_)))


named("SAMETERM")(lambda x, y: b(same_term(x, y)))
named("ISIRI", "ISURI")(lambda x: b(F.when(x.col.isNotNull(), as_term(x).col["kind"] == IRI)))
named("ISBLANK")(lambda x: b(F.when(x.col.isNotNull(), as_term(x).col["kind"] == BLANK)))
named("ISLITERAL")(lambda x: b(F.when(x.col.isNotNull(), as_term(x).col["kind"] == LITERAL)))
named("ISTRIPLE")(lambda x: b(F.when(x.col.isNotNull(), as_term(x).col["kind"] == TRIPLE)))


@named("ISNUMERIC")
def is_numeric(x: Val) -> Val:
    if x.kind != "term":
        return b(F.when(x.col.isNotNull(), F.lit(x.kind in RANK)))
    lex, dt = x.col["lex"], x.col["dt"]
    n = exact(x)
    bounds = {"byte": (-128, 127), "short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1), "unsignedByte": (0, 255), "unsignedShort": (0, 2**16 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedLong": (0, 2**64 - 1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1)}
    ok = F.when(rank_of(x) == 0, lex.rlike(r"^[+-]?\d+$")).when(rank_of(x) == 1, n.isNotNull()).otherwise(number(x).isNotNull())
    for name, (low, high) in bounds.items():
        for edge, cmp in ((low, ">="), (high, "<=")):
            if edge is not None:
                e = F.lit(str(edge)).cast("decimal(38,18)")
                ok = ok & ((dt != XSD + name) | F.coalesce(n >= e if cmp == ">=" else n <= e, F.lit(False)))
    return b(F.when(x.col.isNotNull(), F.coalesce(rank_of(x).isNotNull() & ok, F.lit(False))))


# terms


@named("STR", XSD + "string", FN + "string")
def str_(x: Val) -> Val:
    return s(text_of(x))


@named("LANG")
def lang(x: Val) -> Val:
    t = as_term(x).col
    return s(F.when(t["kind"] == LITERAL, F.coalesce(t["lang"], F.lit(""))))


@named("LANGMATCHES")
def lang_matches(x: Val, y: Val) -> Val:
    tag, want = F.lower(plain(x)), F.lower(plain(y))
    return b(F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))))


@named("DATATYPE")
def datatype(x: Val) -> Val:
    t = as_term(x).col
    return Val("iri", F.when(t["kind"] == LITERAL, t["dt"]), "")


@named("IRI", "URI")
def iri(x: Val) -> Val:
    t = as_term(x).col
    return Val("iri", F.when((t["kind"] == IRI) | (t["dt"] == XSD + "string"), t["lex"]), "")


@named("BNODE")
def bnode(x: Val | None = None) -> Val:
    label = F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit(""))) if x is None else F.concat(F.lit("b"), F.md5(plain(x)))
    return Val("term", F.when(label.isNotNull(), term_struct(BLANK, label)))


named("STRDT")(lambda x, y: Val("term", F.when(plain(x).isNotNull() & text_of(y).isNotNull(), term_struct(LITERAL, plain(x), text_of(y)))))
named("STRLANG")(lambda x, y: Val("term", F.when(plain(x).isNotNull() & plain(y).isNotNull(), term_struct(LITERAL, plain(x), RDF + "langString", F.lower(plain(y))))))
named("UUID")(lambda: Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid()), ""))
named("STRUUID")(lambda: s(F.uuid()))
named("TRIPLE")(quoted)
named("SUBJECT")(lambda x: Val("term", part_of(as_term(x).col, 1)))
named("PREDICATE")(lambda x: Val("term", part_of(as_term(x).col, 2)))
named("OBJECT")(lambda x: Val("term", part_of(as_term(x).col, 3)))
named(AFN + "bnode")(lambda x: s(F.when(as_term(x).col["kind"] == BLANK, as_term(x).col["lex"])))
named(AFN + "localname")(lambda x: s(F.regexp_extract(text_of(x), r"([^#/:]*)$", 1)))
named(AFN + "namespace")(lambda x: s(F.regexp_extract(text_of(x), r"^(.*[#/:])[^#/:]*$", 1)))

# strings


def compatible(x: Val, y: Val, c: Column) -> Column:
    """c, but an error where y has a language that x has not."""
    if x.kind != "term" and y.kind not in ("term", "lang"):
        return c
    a, z = as_term(x).col["lang"], as_term(y).col["lang"]
    return F.when(z.isNull() | (F.coalesce(a, F.lit("")) == z), c)


named("STRLEN", FN + "string-length")(lambda x: i(F.length(plain(x))))
named("UCASE", FN + "upper-case")(lambda x: same_text(x, F.upper(plain(x))))
named("LCASE", FN + "lower-case")(lambda x: same_text(x, F.lower(plain(x))))
named("CONTAINS", FN + "contains")(lambda x, y: b(compatible(x, y, F.contains(plain(x), plain(y)))))
named("STRSTARTS", FN + "starts-with")(lambda x, y: b(compatible(x, y, F.startswith(plain(x), plain(y)))))
named("STRENDS", FN + "ends-with")(lambda x, y: b(compatible(x, y, F.endswith(plain(x), plain(y)))))


@named("SUBSTR", FN + "substring")
def substr(x: Val, start: Val, length: Val | None = None) -> Val:
    """From 1; what lies before the start counts towards the length."""
    text, a = plain(x), F.round(number(start))
    end = F.length(text).cast("double") + 1 if length is None else a + F.round(number(length))
    first = F.greatest(a, F.lit(1.0))
    return same_text(x, F.substring(text, first.cast("int"), F.greatest(end - first, F.lit(0.0)).cast("int")))


@named(AFN + "substring", AFN + "substr")
def afn_substring(x: Val, start: Val, end: Val | None = None) -> Val:
    """From 0, up to before the end."""
    a = number(start)
    n = F.length(plain(x)) if end is None else number(end) - a
    return same_text(x, F.substring(plain(x), (a + 1).cast("int"), n.cast("int")))


@named("STRBEFORE", FN + "substring-before")
def before(x: Val, y: Val) -> Val:
    text, key = plain(x), plain(y)
    at = F.position(key, text)
    found = same_text(x, F.substring(text, F.lit(1), at - 1))
    return maybe_found(x, y, at, found)


@named("STRAFTER", FN + "substring-after")
def after(x: Val, y: Val) -> Val:
    text, key = plain(x), plain(y)
    at = F.position(key, text)
    found = same_text(x, F.substring(text, at + F.length(key), F.length(text)))
    return maybe_found(x, y, at, found)


def maybe_found(x: Val, y: Val, at: Column, found: Val) -> Val:
    """The found part with its tag, or the plain empty string."""
    if found.kind == "str":
        return s(compatible(x, y, F.when(at == 0, "").otherwise(found.col)))
    return Val("term", compatible(x, y, F.when(at == 0, term_struct(LITERAL, F.lit(""), XSD + "string")).otherwise(as_term(found).col)))


@named("CONCAT", FN + "concat")
def concat(*xs: Val) -> Val:
    if not xs:
        return s(F.lit(""))
    text = F.concat(*(plain(x) for x in xs))
    if all(x.kind == "str" for x in xs):
        return s(text)
    tags = [F.coalesce(as_term(x).col["lang"], F.lit("")) for x in xs]
    alike = tags[0] != ""
    for t in tags[1:]:
        alike = alike & (t == tags[0])
    return Val("term", F.when(text.isNotNull(), F.when(alike, term_struct(LITERAL, text, RDF + "langString", tags[0])).otherwise(term_struct(LITERAL, text, XSD + "string"))))


def pattern_with(pattern: Column, flags: Val | None) -> Column:
    """Flags before a pattern; q makes it literal."""
    if flags is None:
        return pattern
    f = plain(flags)
    inner = F.replace(f, F.lit("q"), F.lit(""))
    body = F.when(F.contains(f, F.lit("q")), F.concat(F.lit(r"\Q"), pattern, F.lit(r"\E"))).otherwise(pattern)
    return F.when(inner == "", body).otherwise(F.concat(F.lit("(?"), inner, F.lit(")"), body))


named("REGEX", FN + "matches")(lambda x, p, flags=None: b(F.rlike(plain(x), pattern_with(plain(p), flags))))
named("REPLACE", FN + "replace")(lambda x, p, r, flags=None: same_text(x, F.regexp_replace(plain(x), pattern_with(plain(p), flags), plain(r))))
named("ENCODE_FOR_URI", FN + "encode-for-uri")(lambda x: s(F.replace(F.replace(F.replace(F.url_encode(plain(x)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))))
named(FN + "escape-html-uri")(lambda x: s(F.array_join(F.transform(F.split(plain(x), ""), lambda c: F.when(F.ascii(c) > 127, F.url_encode(c)).otherwise(c)), "")))
named(FN + "compare")(lambda x, y: i(F.when(plain(x) < plain(y), -1).when(plain(x) > plain(y), 1).when(plain(x) == plain(y), 0)))
named(FN + "normalize-space")(lambda x: same_text(x, F.trim(F.regexp_replace(plain(x), r"\s+", " "))))
named(FN + "string-join", AFN + "strjoin")(lambda sep, *xs: s(F.concat_ws("", *[c for n, x in enumerate(xs) for c in ([plain(sep)] if n else []) + [text_of(x)]])))


@named(FN + "normalize-unicode")
def normalize_unicode(x: Val, form: Val | None = None) -> Val:
    """No builtin does this; an Arrow UDF normalises whole batches."""
    @F.pandas_udf("string")
    def run(text: pd.Series, how: pd.Series) -> pd.Series:
        import unicodedata

        return pd.Series([None if t is None else unicodedata.normalize(h, t) if h else t for t, h in zip(text, how, strict=True)])

    return same_text(x, run(plain(x), F.upper(plain(form)) if form is not None else F.lit("NFC")))


# numbers


def rounded(f: Callable[[Column], Column]) -> Function:
    """A function from a number to one of the same type."""

    def run(x: Val) -> Val:
        if x.kind == "int":
            return i(f(x.col))
        if x.kind in ("dec", "flt", "dbl"):
            return Val(x.kind, f(x.col).cast(NATIVE[x.kind][1]))
        if x.kind != "term":
            return null("int")
        lex = F.when(rank_of(x) <= 1, text_of(Val("dec", f(exact(x)).cast("decimal(38,18)")))).otherwise(text_of(d(f(number(x)).cast("double"))))
        dt = F.when(rank_of(x) == 0, XSD + "integer").otherwise(x.col["dt"])
        return Val("term", F.when(rank_of(x).isNotNull() & lex.isNotNull(), term_struct(LITERAL, lex, dt)))

    return run


def half_up(c: Column) -> Column:
    """Halves go up, towards positive infinity."""
    return F.floor(c + F.lit(0.5).cast("decimal(2,1)"))


named("ABS", FN + "abs")(rounded(F.abs))
named("CEIL", FN + "ceiling")(rounded(F.ceil))
named("FLOOR", FN + "floor")(rounded(F.floor))
named("ROUND", FN + "round", FN + "numeric-round")(rounded(half_up))
named(FN + "round-half-to-even")(rounded(lambda c: F.bround(c, 0)))
named("RAND", EXT + "rnd")(lambda *bounds: d(F.rand()) if not bounds else d(F.rand() if len(bounds) == 1 else number(bounds[0]) + F.rand() * (number(bounds[1]) - number(bounds[0]))))


def real(f: Callable[..., Column]) -> Function:
    return lambda *xs: d(f(*(number(x) for x in xs)))


named(AFN + "max")(lambda x, y: d(F.greatest(number(x), number(y))) if not x.kind == y.kind == "int" else i(F.greatest(x.col, y.col)))
named(AFN + "min")(lambda x, y: d(F.least(number(x), number(y))) if not x.kind == y.kind == "int" else i(F.least(x.col, y.col)))
named(AFN + "pi", EXT + "pi")(lambda: d(F.lit(math.pi)))
named(AFN + "e")(lambda: d(F.lit(math.e)))
named(EXT + "e")(real(F.exp))
named(EXT + "sq")(real(lambda x: x * x))
named(EXT + "cube")(real(lambda x: x * x * x))
named(EXT + "sqrt")(real(lambda x: F.when(x >= 0, F.sqrt(x))))
named(EXT + "root")(real(lambda x, n: F.pow(x, F.try_divide(F.lit(1.0), n))))
named(EXT + "pow")(real(F.pow))
named(EXT + "ten")(real(lambda x: F.pow(F.lit(10.0), x)))
named(EXT + "ln")(real(F.ln))
named(EXT + "log")(real(lambda x, base=None: F.log10(x) if base is None else F.ln(x) / F.ln(base)))
named(EXT + "reciprocal")(real(lambda x: F.try_divide(F.lit(1.0), x)))
named(EXT + "factorial")(lambda x: i(F.factorial(number(x).cast("int"))))
named(EXT + "cartesian")(real(lambda *c: F.sqrt(sum(((c[n] - c[n + len(c) // 2]) ** 2 for n in range(len(c) // 2)), F.lit(0.0)))))
named(EXT + "pythagoras")(real(lambda x, y: F.sqrt(x * x + y * y)))
named(EXT + "degrees-to-radians")(real(F.radians))
named(EXT + "radians-to-degrees")(real(F.degrees))
named(EXT + "sin")(real(F.sin))
named(EXT + "cos")(real(F.cos))
named(EXT + "tan")(real(F.tan))
named(EXT + "sec")(real(F.sec))
named(EXT + "cosec")(real(F.csc))
named(EXT + "cotan")(real(F.cot))
named(EXT + "sin-1")(real(lambda x: F.when(F.abs(x) <= 1, F.asin(x))))
named(EXT + "cos-1")(real(lambda x: F.when(F.abs(x) <= 1, F.acos(x))))
named(EXT + "tan-1")(real(F.atan))
named(EXT + "sec-1")(real(lambda x: F.when(F.abs(x) >= 1, F.acos(1 / x))))
named(EXT + "cosec-1")(real(lambda x: F.when(F.abs(x) >= 1, F.asin(1 / x))))
named(EXT + "cotan-1")(real(lambda x: F.atan(F.try_divide(F.lit(1.0), x))))

# dates


def stamp(x: Val) -> Column:
    """The time as written, without its zone."""
    if x.kind in ("dt", "date"):
        return x.col.cast("timestamp")
    lex = F.when(as_term(x).col["dt"].isin(XSD + "dateTime", XSD + "date"), text_of(x))
    return F.regexp_replace(lex, r"(Z|[+-]\d\d:\d\d)$", "").try_cast("timestamp")


def part(name: str) -> Function:
    return lambda x: i(F.extract(F.lit(name), stamp(x)))


named("YEAR", FN + "year-from-dateTime")(part("YEAR"))
named("MONTH", FN + "month-from-dateTime")(part("MONTH"))
named("DAY", FN + "day-from-dateTime")(part("DAY"))
named("HOURS", FN + "hours-from-dateTime")(part("HOUR"))
named("MINUTES", FN + "minutes-from-dateTime")(part("MINUTE"))
named("SECONDS", FN + "seconds-from-dateTime")(lambda x: Val("dec", F.extract(F.lit("SECOND"), stamp(x)).cast("decimal(38,18)")))


@named("TZ")
def tz(x: Val) -> Val:
    if x.kind == "dt":
        return s(F.when(x.col.isNotNull(), "Z"))
    return s(F.when(stamp(x).isNotNull(), F.regexp_extract(text_of(x), r"(Z|[+-]\d\d:\d\d)$", 1)))


@named("TIMEZONE", FN + "timezone-from-dateTime")
def timezone(x: Val) -> Val:
    zone = tz(x).col
    hours, minutes = F.regexp_extract(zone, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(zone, r":(\d\d)", 1).try_cast("int")
    text = F.when(zone == "Z", "PT0S").when(zone != "", F.concat(F.when(zone.startswith("-") & ((hours > 0) | (minutes > 0)), "-").otherwise(""), F.lit("PT"), F.when((hours == 0) & (minutes == 0), "0S").otherwise(F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise("")))))
    return Val("term", F.when(text.isNotNull(), term_struct(LITERAL, text, XSD + "dayTimeDuration")))


named("NOW", AFN + "now")(lambda: Val("dt", F.current_timestamp()))

# hashes


def hashed(f: Callable[[Column], Column]) -> Function:
    return lambda x: s(f(F.when(as_term(x).col["kind"] == LITERAL, text_of(x))))


named("MD5", EXT + "md5hash")(hashed(F.md5))
named("SHA1")(hashed(F.sha1))
named("SHA256", EXT + "sha256hash")(hashed(lambda c: F.sha2(c, 256)))
named("SHA384")(hashed(lambda c: F.sha2(c, 384)))
named("SHA512")(hashed(lambda c: F.sha2(c, 512)))
named(AFN + "sha1sum")(lambda x: s(F.sha1(text_of(x))))

# casts


def cast(kind: str) -> Function:
    def run(x: Val) -> Val:
        if x.kind == kind:
            return x
        text = text_of(x)
        if x.kind == "bool":
            text = F.when(x.col, "1").otherwise(F.when(~x.col, "0"))
        elif x.kind == "term":
            flag = parsed(text, "bool")
            text = F.when(x.col["kind"] != LITERAL, F.lit(None)).when(x.col["dt"] == XSD + "boolean", F.when(flag, "1").when(~flag, "0")).otherwise(text)
        elif x.kind == "iri":
            return null(kind)
        if kind == "int":  # other numbers are cut off
            numeric = x.kind in RANK
            cut = number(x) if x.kind != "term" else F.when(rank_of(x).isNotNull(), number(x))
            return i(F.when(cut.isNotNull(), F.when(cut >= 0, F.floor(cut)).otherwise(F.ceil(cut)))) if numeric else i(F.coalesce(parsed(text, "int"), F.when(cut >= 0, F.floor(cut)).otherwise(F.ceil(cut))))
        if kind == "dec" and x.kind in RANK:
            return Val("dec", x.col.try_cast("decimal(38,18)"))
        if kind in ("flt", "dbl") and x.kind in RANK:
            return Val(kind, x.col.cast(NATIVE[kind][1]))
        if kind == "dt":
            if x.kind == "date":
                return Val("dt", x.col.cast("timestamp"))
            kept = F.when(text.try_cast("timestamp").isNotNull() & text.rlike(r"^-?\d{4,}-\d\d-\d\d"), term_struct(LITERAL, text, XSD + "dateTime"))
            return Val("term", kept)
        return Val(kind, parsed(text, kind))

    return run


for _kind in ("int", "dec", "flt", "dbl", "dt", "date", "dur"):
    BUILTINS[NATIVE[_kind][0]] = cast(_kind)


def call(name: str, args: list[Val], custom: dict[str, Function] | None = None) -> Val:
    """The function of a name; CALL takes the name as its first argument, which must be a constant."""
    f = (custom or {}).get(name) or BUILTINS.get(name)
    if f is None:
        raise Unknown(f"no function {name}")
    return f(*args)


def lit(value: str) -> Val:
    return constant(Literal(value))
