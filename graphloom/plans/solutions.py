"""Solutions: a DataFrame with a column for each variable, and what is known of each variable's type and boundness."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import NATIVE, TERM_TYPE, Val, as_term, text_of


@dataclass(frozen=True)
class Info:
    kind: str
    extra: str | None = None
    maybe: bool = False  # may be unbound


def column(name: str) -> str:
    return f"?{name}"


def ref(name: str, side: str = "") -> Column:
    return F.col(f"`{side}?{name}`")


@dataclass(frozen=True)
class Solutions:
    df: DataFrame
    vars: dict[str, Info]

    def val(self, name: str) -> Val | None:
        return Val(self.vars[name].kind, ref(name), self.vars[name].extra) if name in self.vars else None

    def keep(self, names: list[str]) -> Solutions:
        names = [n for n in names if n in self.vars]
        return Solutions(self.df.select(*(ref(n) for n in names)), {n: self.vars[n] for n in names})

    def with_val(self, name: str, v: Val, maybe: bool = True) -> Solutions:
        return Solutions(self.df.withColumn(column(name), v.col), {**self.vars, name: Info(v.kind, v.extra, maybe)})

    def filtered(self, condition: Column) -> Solutions:
        return Solutions(self.df.filter(condition), self.vars)

    def terms(self) -> Solutions:
        """Every variable as a term."""
        out = {n: as_term(self.val(n)).col.alias(column(n)) for n in self.vars}
        return Solutions(self.df.select(*out.values()), {n: Info("term", None, i.maybe) for n, i in self.vars.items()})


def common_info(a: Info, b: Info) -> Info:
    same = (a.kind, a.extra) == (b.kind, b.extra)
    kind, extra = (a.kind, a.extra) if same else ("iri", "") if a.kind == b.kind == "iri" else ("term", None)
    return Info(kind, extra, a.maybe or b.maybe)


def converted(v: Val, info: Info) -> Column:
    if (v.kind, v.extra) == (info.kind, info.extra):
        return v.col
    return text_of(v) if info.kind == "iri" else as_term(v).col


def aligned(left: Solutions, right: Solutions) -> tuple[DataFrame, DataFrame, dict[str, Info]]:
    """Both sides with shared variables of one kind; the right side's columns are named r?x. Returns shared variables' types, whose maybe is that of either side."""
    shared = {n: common_info(left.vars[n], right.vars[n]) for n in left.vars if n in right.vars}
    l = left.df.select(*((converted(left.val(n), shared[n]) if n in shared else ref(n)).alias(column(n)) for n in left.vars))
    r = right.df.select(*((converted(right.val(n), shared[n]) if n in shared else ref(n)).alias("r" + column(n)) for n in right.vars))
    return l, r, shared


def agree(name: str, left: Info, right: Info) -> Column:
    """Compatible: equal, or either side unbound."""
    a, b = ref(name), ref(name, "r")
    out = a == b
    if left.maybe:
        out = out | a.isNull()
    if right.maybe:
        out = out | b.isNull()
    return out


def merged(joined: DataFrame, left: Solutions, right: Solutions, shared: dict[str, Info], outer: bool = False) -> Solutions:
    """One column for each variable after a join; a bound value replaces an unbound one."""
    cols, info = [], {}
    for n, i in left.vars.items():
        cols.append(F.coalesce(ref(n), ref(n, "r")).alias(column(n)) if n in shared and i.maybe else ref(n))
        info[n] = replace(shared.get(n, i), maybe=i.maybe and (outer or n not in right.vars or right.vars[n].maybe))
    for n, i in right.vars.items():
        if n not in left.vars:
            cols.append(ref(n, "r").alias(column(n)))
            info[n] = replace(i, maybe=i.maybe or outer)
    return Solutions(joined.select(*cols), info)


def both(l: DataFrame, r: DataFrame, condition: Column | None, how: str) -> DataFrame:
    if condition is None:
        return l.crossJoin(r) if how == "inner" else l.join(r, F.lit(True), how)
    return l.join(r, condition, how)


def all_of(conditions: list[Column]) -> Column | None:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def join(left: Solutions, right: Solutions) -> Solutions:
    """Compatible pairs. Variables bound on both sides make an equi-join; where all shared ones may be unbound, rows are told apart by
    what they bind, and only those that have no bound variable in common pair freely."""
    if not left.vars:
        return Solutions(left.df.crossJoin(right.df), right.vars) if left.df.columns else right
    if not right.vars and not right.df.columns:
        return left
    l, r, shared = aligned(left, right)
    return merged(pairs(l, r, cases(list(shared), left, right), []), left, right, shared)


@dataclass(frozen=True)
class Case:
    """Pairs of rows told apart by which of them bind a variable: a test of the left row, one of the right row, and of both."""

    left: list[Column]
    right: list[Column]
    both: list[Column]


def cases(names: list[str], left: Solutions, right: Solutions) -> list[Case]:
    """Disjoint cases that together are all compatible pairs. Each but the one in which neither side binds what the other does
    holds an equality, so that it is an equi-join."""
    if not names or any(not left.vars[n].maybe and not right.vars[n].maybe for n in names):
        return [Case([], [], [agree(n, left.vars[n], right.vars[n]) for n in names])]
    first, *rest = names
    a, b = ref(first), ref(first, "r")
    mine, theirs = ([a.isNotNull()] if left.vars[first].maybe else []), ([b.isNotNull()] if right.vars[first].maybe else [])
    out = [Case(mine, theirs, [a == b, *(agree(n, left.vars[n], right.vars[n]) for n in rest)])]
    others = cases(rest, left, right)
    if left.vars[first].maybe:
        out += [Case([a.isNull(), *c.left], c.right, c.both) for c in others]
    if right.vars[first].maybe:
        out += [Case([*mine, *c.left], [b.isNull(), *c.right], c.both) for c in others]
    return out


def where(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.filter(all_of(conditions)) if conditions else df


def pairs(l: DataFrame, r: DataFrame, found: list[Case], also: list[Column]) -> DataFrame:
    """All pairs of any case."""
    out = None
    for c in found:
        part = both(where(l, c.left), where(r, c.right), all_of([*c.both, *also]), "inner")
        out = part if out is None else out.unionAll(part)
    return out


def matched(l: DataFrame, r: DataFrame, c: Case, also: list[Column], how: str) -> DataFrame:
    """Left rows that have (left_semi) or lack (left_anti) a partner in a case."""
    r = where(r, c.right)
    if not c.both and not also:
        r = r.limit(1)
    return both(l, r, all_of([*c.left, *c.both, *also]), how)


def unmatched(l: DataFrame, r: DataFrame, found: list[Case], also: list[Column]) -> DataFrame:
    """Left rows without a partner in any case."""
    for c in found:
        l = matched(l, r, c, also, "left_anti")
    return l


def env_of(left: Solutions, right: Solutions, shared: dict[str, Info]) -> Callable[[str], Val | None]:
    """Values of variables in a joined row before it is merged."""

    def get(n: str) -> Val | None:
        if n in shared:
            return Val(shared[n].kind, F.coalesce(ref(n), ref(n, "r")) if left.vars[n].maybe else ref(n), shared[n].extra)
        if n in left.vars:
            return Val(left.vars[n].kind, ref(n), left.vars[n].extra)
        if n in right.vars:
            return Val(right.vars[n].kind, ref(n, "r"), right.vars[n].extra)
        return None

    return get


def left_join(left: Solutions, right: Solutions, condition: Callable[[Callable[[str], Val | None]], Column] | None) -> Solutions:
    l, r, shared = aligned(left, right)
    also = [] if condition is None else [F.coalesce(condition(env_of(left, right, shared)), F.lit(False))]
    found = cases(list(shared), left, right)
    if len(found) == 1:
        out = both(l, r, all_of([*found[0].both, *also]), "left")
    else:
        alone = unmatched(l, r, found, also).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in r.schema))
        out = pairs(l, r, found, also).unionAll(alone)
    return merged(out, left, right, shared, outer=True)


def semi_join(left: Solutions, right: Solutions, wanted: bool, condition: Callable[[Callable[[str], Val | None]], Column] | None = None) -> Solutions:
    """EXISTS and NOT EXISTS."""
    l, r, shared = aligned(left, right)
    also = [] if condition is None else [F.coalesce(condition(env_of(left, right, shared)), F.lit(False))]
    *first, last = cases(list(shared), left, right)
    if wanted:
        out = None
        for c in first:
            has, l = matched(l, r, c, also, "left_semi"), matched(l, r, c, also, "left_anti")
            out = has if out is None else out.unionAll(has)
        has = matched(l, r, last, also, "left_semi")
        out = has if out is None else out.unionAll(has)
    else:
        out = unmatched(l, r, [*first, last], also)
    return Solutions(out, {n: replace(shared.get(n, i), maybe=i.maybe) for n, i in left.vars.items()})


def minus(left: Solutions, right: Solutions) -> Solutions:
    """Removes what is compatible with a right solution that shares a bound variable."""
    l, r, shared = aligned(left, right)
    if not shared:
        return left
    r = r.select(*(ref(n, "r") for n in shared))
    found = [c for c in cases(list(shared), left, right) if c.both]  # without an equality nothing is shared
    return Solutions(unmatched(l, r, found, []), {n: replace(shared.get(n, i), maybe=i.maybe) for n, i in left.vars.items()})


def union(left: Solutions, right: Solutions) -> Solutions:
    info = {}
    for n in {**left.vars, **right.vars}:
        a, b = left.vars.get(n), right.vars.get(n)
        info[n] = common_info(a, b) if a and b else replace(a or b, maybe=True)

    def side(s: Solutions) -> DataFrame:
        def value(n: str, i: Info) -> Column:
            if n in s.vars:
                return converted(s.val(n), i)
            return F.lit(None).cast(next((dict(x.df.dtypes)[column(n)] for x in (left, right) if n in x.vars), TERM_TYPE) if i.kind in ("iri", *NATIVE, "lang") else TERM_TYPE)

        return s.df.select(*(value(n, i).alias(column(n)) for n, i in info.items())) if info else s.df

    return Solutions(side(left).unionByName(side(right)), info)
