"""Aggregates over typed values: each gives a column for groupBy().agg() and the kind of its result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.values import LITERAL, NATIVE, RANK, Val, as_term, exact, number, order_key, rank_of, term_struct, text_of, truth
from graphloom.plans.algebra import XSD

Made = tuple[Column, str, str | None]


def total(v: Val, distinct: bool, mean: bool) -> Made:
    """SUM and AVG: an error in the group makes the result an error; nothing gives 0."""
    f = (F.sum_distinct if distinct else F.try_sum) if not mean else (lambda c: F.try_avg(c) if not distinct else F.sum_distinct(c) / F.count_distinct(c))
    n, good = F.count(F.lit(1)), F.count(v.col)
    if v.kind in RANK:
        kind = "dec" if mean and v.kind == "int" else v.kind
        col = v.col
        out = F.when(n == 0, F.lit(0)).when(n == good, f(col.cast("decimal(38,18)") if kind == "dec" else col))
        return out.cast(NATIVE[kind][1]), kind, None
    if v.kind != "term":
        return F.when(n == 0, F.lit(0).cast("bigint")), "int", None
    rank, ok = F.max(rank_of(v)), F.count(rank_of(v)) == n
    e, a = f(exact(v)), f(number(v))
    if distinct:  # over distinct terms
        terms = F.collect_set(v.col)
        e = F.aggregate(terms, F.lit(0).cast("decimal(38,18)"), lambda acc, t: (acc + exact(Val("term", t))).cast("decimal(38,18)"))
        a = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + number(Val("term", t)))
        if mean:
            e, a = e / F.size(terms), a / F.size(terms)
    dt = F.when(rank == 0, XSD + ("decimal" if mean else "integer")).when(rank == 1, XSD + "decimal").when(rank == 2, XSD + "float").otherwise(XSD + "double")
    lex = F.when(rank <= 1, text_of(Val("dec", e.cast("decimal(38,18)")))).otherwise(a.cast("string"))
    return F.when(n == 0, term_struct(LITERAL, F.lit("0"), XSD + "integer")).when(ok, term_struct(LITERAL, lex, dt)), "term", None


def extreme(v: Val, largest: bool) -> Made:
    f = F.max if largest else F.min
    if v.kind == "term":
        by = F.max_by if largest else F.min_by
        return by(v.col, order_key(v)), "term", None
    return f(v.col), v.kind, v.extra


def numeric_extreme(v: Val, largest: bool) -> Made:
    """Of what is numeric; an error if nothing is."""
    f = F.max if largest else F.min
    if v.kind in RANK:
        return f(v.col), v.kind, None
    return f(number(v)), "dbl", None


def joined(v: Val, distinct: bool, separator: str) -> Made:
    """Texts in their order; an empty group gives the empty string."""
    texts = (F.collect_set if distinct else F.collect_list)(text_of(v))
    return F.array_join(F.sort_array(texts), separator), "str", None


def median(v: Val, distinct: bool) -> Made:
    """The middle value in order, the lower one of two."""
    pairs = (F.collect_set if distinct else F.collect_list)(F.when(v.col.isNotNull(), F.struct(order_key(v).alias("k"), v.col.alias("v"))))
    sorted_ = F.sort_array(pairs)
    return F.get(sorted_, F.floor((F.size(sorted_) - 1) / 2).cast("int"))["v"], v.kind, v.extra


def mode(v: Val) -> Made:
    """The most frequent value, the smallest of several."""
    return F.mode(v.col, True), v.kind, v.extra


def aggregate(name: str, v: Val | None, all_vars: list[Column], distinct: bool, separator: str | None) -> Made:
    if name == "COUNT":
        if v is None:
            row = F.struct(*all_vars) if all_vars else F.lit(1)
            return (F.count_distinct(row) if distinct else F.count(F.lit(1))), "int", None
        return (F.count_distinct(v.col) if distinct else F.count(v.col)), "int", None
    assert v is not None, f"{name} needs an expression"
    if name in ("SUM", "AVG"):
        return total(v, distinct, name == "AVG")
    if name in ("MIN", "MAX"):
        return extreme(v, name == "MAX")
    if name == "SAMPLE":
        return extreme(v, False) if v.kind != "term" else (F.min(v.col), "term", None)
    if name == "GROUP_CONCAT":
        return joined(v, distinct, " " if separator is None else separator)
    if name == "STRING_JOIN":
        return joined(v, distinct, separator or "")
    if name == "ext:median":
        return median(v, distinct)
    if name == "ext:mode":
        return mode(v)
    if name in ("ext:nmin", "ext:nmax"):
        return numeric_extreme(v, name == "ext:nmax")
    holds = F.coalesce(truth(v), F.lit(False))
    if name == "ext:all":
        return F.bool_and(holds), "bool", None
    if name == "ext:any":
        return F.bool_or(holds), "bool", None
    if name == "ext:none":
        return ~F.bool_or(holds), "bool", None
    raise ValueError(f"no aggregate {name}")


def as_terms(made: Made) -> Column:
    return as_term(Val(made[1], made[0], made[2])).col
