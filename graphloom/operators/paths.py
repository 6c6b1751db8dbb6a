"""Closure of property paths: semi-naive rounds of joins, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.staging import kept


def closure(edges: DataFrame, start: Column | None, end: Column | None, least: int, most: int | None) -> DataFrame:
    """Pairs (a, b) that least to most steps over edges(a, b) connect; from a fixed start, or to a fixed end, only what is reached.

    A round joins the pairs found last with the edges and drops those seen before, so cycles end. Up to a bound above 1, or
    from a least number above 1, walks of each length are followed, as a longer walk can end where a shorter one did.
    """
    if end is not None and start is None:
        back = closure(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), end, None, least, most)
        return back.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if most == 1 and least == 1:
        return edges
    edges = kept(edges, "edges")
    front = edges if start is None else edges.filter(F.col("a") == start)
    steps = edges.select(F.col("a").alias("m"), F.col("b").alias("n"))

    def onward(pairs: DataFrame) -> DataFrame:
        return pairs.join(steps, pairs["b"] == steps["m"]).select("a", F.col("n").alias("b")).distinct()

    for _ in range(least - 1):
        front = kept(onward(front), "front")
    seen, parts, n = kept(front.distinct(), "front"), [], least
    front = seen
    parts.append(seen)
    while (most is None or n < most) and not front.isEmpty():
        new = onward(front)
        for p in parts:
            new = new.join(p, ["a", "b"], "left_anti")
        front = kept(new, "front")
        parts.append(front)
        n += 1
        if len(parts) > 8:  # few tables to look through
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionAll(p)
            parts = [kept(whole, "seen")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
