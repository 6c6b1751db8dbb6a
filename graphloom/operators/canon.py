"""Canonical labels for blank nodes by hash rounds, graph equality, and the difference of graphs.

A blank node's hash is refined from the quads around it until a round separates no more nodes; nodes that stay alike are told
apart by trying each of them, which terminates for all graphs but is only meant for small groups of alike nodes.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import BLANK
from graphloom.sources.files import lines_of
from graphloom.sources.quads import QuadSource
from graphloom.staging import kept

LABEL = re.compile(r"_:[A-Za-z0-9_.\-]+")


def colours(quads: DataFrame) -> DataFrame:
    """(n, h): blank nodes and hashes of their surroundings; one row of hashes for each round, until no round separates more."""
    def label(c: str) -> F.Column:
        return F.col(f"{c}.lex")

    rows = kept(quads.select("s", "p", "o", F.coalesce("g", F.lit("")).alias("g")), "canon")
    blank = rows.filter(F.col("s.kind") == BLANK).select(label("s").alias("n")).unionAll(rows.filter(F.col("o.kind") == BLANK).select(label("o").alias("n"))).distinct()
    h = kept(blank.withColumn("h", F.lit("b")), "colours")
    count = 1
    while True:
        s, o = h.select(F.col("n").alias("sn"), F.col("h").alias("sh")), h.select(F.col("n").alias("on"), F.col("h").alias("oh"))
        full = rows.join(s, (F.col("s.kind") == BLANK) & (label("s") == F.col("sn")), "left").join(o, (F.col("o.kind") == BLANK) & (label("o") == F.col("on")), "left")
        text = {c: F.when(F.col(f"{c}.kind") == BLANK, F.col(f"{c}h")).otherwise(F.to_json(c)) for c in "so"}
        out = full.filter("sn is not null").select(F.col("sn").alias("n"), F.concat_ws("|", F.lit(">"), "p", text["o"], "g").alias("x"))
        inc = full.filter("on is not null").select(F.col("on").alias("n"), F.concat_ws("|", F.lit("<"), "p", text["s"], "g").alias("x"))
        new = out.unionAll(inc).groupBy("n").agg(F.sort_array(F.collect_list("x")).alias("xs")).join(h, "n").select("n", F.sha2(F.concat_ws("\n", F.col("h"), F.array_join("xs", "\n")), 256).alias("h"))
        h = kept(new, "colours")
        n = h.select("h").distinct().count()
        if n <= count:
            return h
        count = n


def canonical_lines(source: QuadSource | DataFrame) -> list[str]:
    """Sorted N-Quads of a small graph with canonical labels."""
    quads = source.quads if isinstance(source, QuadSource) else source
    h = {r["n"]: r["h"] for r in colours(quads).collect()}
    lines = [r["value"] for r in lines_of(quads).collect()]
    best: list[str] | None = None

    def refine(c: dict[str, str]) -> dict[str, str]:
        while True:
            new = {n: hashlib.sha256("\n".join([c[n], *sorted(LABEL.sub(lambda m, n=n: "_:me" if m[0][2:] == n else "_:" + c.get(m[0][2:], ""), x) for x in lines if f"_:{n}" in LABEL.findall(x))]).encode()).hexdigest() for n in c}
            if len(set(new.values())) <= len(set(c.values())):
                return new
            c = new

    def walk(c: dict[str, str]) -> None:
        nonlocal best
        groups: dict[str, list[str]] = {}
        for n, x in c.items():
            groups.setdefault(x, []).append(n)
        alike = next((sorted(v) for _, v in sorted(groups.items()) if len(v) > 1), None)
        if alike is None:
            names = {n: f"c14n{i}" for i, (_, n) in enumerate(sorted((x, n) for n, x in c.items()))}
            done = sorted(LABEL.sub(lambda m: "_:" + names.get(m[0][2:], m[0][2:]), x) for x in lines)
            best = done if best is None or done < best else best
            return
        for n in alike:
            walk(refine({**c, n: c[n] + "!"}))

    walk(refine(h) if h else {})
    return best or []


def isomorphic(a: QuadSource, b: QuadSource) -> bool:
    return canonical_lines(a) == canonical_lines(b)


def difference(a: QuadSource, b: QuadSource) -> tuple[DataFrame, DataFrame]:
    """(removed, added) quads between graphs whose blank nodes keep their labels."""
    x, y = (s.quads.select("s", "p", "o", "g") for s in (a, b))
    return x.exceptAll(y), y.exceptAll(x)
