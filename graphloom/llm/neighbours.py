"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to length one, spun by pseudo-random rotations (three rounds of random signs and a fast Hadamard transform) and
named by the signed axis that lies nearest; a table joins the names of two rotations. A query looks into several buckets of each
table, those whose axes come nearest next, until the buckets hold about `candidates` vectors by count, but never fewer than LEAST_SHARE
of all buckets, so that recall doesn't fall as the table grows; all that lie there are ranked again by exact cosine in double precision.
A query whose buckets hold fewer vectors than are asked for looks into all buckets of one table, which hold every vector.

Equal vectors are indexed once: only the smallest few ids of a vector can be among its nearest, so that hot copies cost nothing.
Buckets above BLOCK rows are split into blocks that queries visit one by one; no bucket is cut off.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do vectors of another
length than the most frequent one (the smaller, on a tie); ties in score go to the smaller id; ids that repeat count as rows; with
too few candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import join_counted, staged

TABLES, CANDIDATES, BLOCK = 12, 6000, 4096
#: Of a table's buckets, the share that a query looks into at least, whatever the number of rows.
LEAST_SHARE = 0.01
SEED = 5


def rotations(width: int, tables: int) -> np.ndarray:
    """Signs of three rounds for both rotations of each table."""
    return np.random.default_rng(SEED).choice(np.array([-1.0, 1.0]), (tables, 2, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform along the last axis, whose length is a power of two."""
    n, step = x.shape[-1], 1
    while step < n:
        y = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.concatenate([y[..., :1, :] + y[..., 1:, :], y[..., :1, :] - y[..., 1:, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x / np.sqrt(n)


def spun(units: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """units (rows, width) under one rotation."""
    for s in signs:
        units = hadamard(units * s)
    return units


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: no square overflows or vanishes, no cosine changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]) if vectors.size else vectors


def padded(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, with zeros up to a power of two (at least 4)."""
    width = max(4, 1 << (vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), width))
    vectors = scaled(vectors)
    out[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return out


def axis_names(x: np.ndarray) -> np.ndarray:
    """The nearest signed axis: its number, plus the width if negative."""
    a = np.abs(x).argmax(axis=1)
    return a + x.shape[1] * (x[np.arange(len(x)), a] < 0)


def bucket_names(units: np.ndarray, signs: np.ndarray) -> np.ndarray:
    return axis_names(spun(units, signs[0])) * (2 * units.shape[1]) + axis_names(spun(units, signs[1]))


def probes_each(n: int, names: int, tables: int, candidates: int) -> int:
    """How many buckets of each table a query looks into, of names * names, if n vectors are indexed."""
    wanted = -(-candidates * names * names // (tables * max(1, n)))
    return min(names * names, max(1, math.ceil(LEAST_SHARE * names * names), wanted))


def probes(units: np.ndarray, signs: np.ndarray, n: int) -> np.ndarray:
    """For each row the names of the n buckets that lie nearest: pairs of axes by how far each falls short of the nearest axis."""
    width = 2 * units.shape[1]
    n = min(n, width * width)
    most = min(width, n)
    lack, names = [], []
    for s in signs:
        x = spun(units, s)
        both = np.concatenate([x, -x], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :most]
        short = both.max(axis=1, keepdims=True) - np.take_along_axis(both, order, axis=1)
        lack.append(short**2)
        names.append(order)
    pairs = [(i, j) for i in range(most) for j in range(most) if (i + 1) * (j + 1) <= n]  # a pair has all better pairs before it
    i, j = np.array(pairs).T
    out = np.empty((len(units), n), np.int64)
    for r in range(len(units)):
        cost = lack[0][r, i] + lack[1][r, j]
        best = np.argpartition(cost, n - 1)[:n] if n < len(cost) else np.arange(n)
        out[r] = names[0][r, i[best]] * width + names[1][r, j[best]]
    return out


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact cosines of rows, pair by pair, each summed in one fixed order."""
    queries, vectors = scaled(queries), scaled(vectors)
    return (queries * vectors).sum(axis=1) / (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((vectors * vectors).sum(axis=1)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(__id, __v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"), v.alias("__v")).filter(F.col("__id").isNotNull() & F.col("__v").isNotNull())
    bad = F.exists("__v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("__v", lambda x: x != 0.0))
    most = rows.groupBy(F.size("__v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("__v") == (most["n"] if most else 0))


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def nearest(vectors: DataFrame, queries_every: int = 50, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tables: int = TABLES, candidates: int = CANDIDATES, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for every row whose id is divisible by queries_every."""
    rows = staged(usable(vectors, id_col, vector_col), "ann-rows")
    by = Window.partitionBy("__v").orderBy("__id")
    few = rows.withColumn("__r", F.row_number().over(by)).filter(F.col("__r") <= k + 1)  # limited before the shuffle, too
    distinct = staged(few.groupBy("__v").agg(F.min("__id").alias("__key"), F.array_sort(F.collect_list("__id")).alias("__ids")), "ann-distinct")
    n, first = distinct.count(), distinct.select(F.size("__v").alias("n")).first()
    width = max(4, 1 << ((first["n"] if first else 1) - 1).bit_length())
    signs, names = rotations(width, tables), 2 * width
    each = probes_each(n, names, tables, candidates)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = padded(matrix(batch, "__v"))
            for t in range(tables):
                b = bucket_names(units, signs[t])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), t * names) + b // names, pa.int32()), pa.array(b % names, pa.int32()), batch.column(0), batch.column(1)], ["__place", "__axis", "__key", "__v"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                units = padded(matrix(part, "__v"))
                for t in range(tables):
                    got = probes(units, signs[t], each)
                    owner = np.repeat(np.arange(len(got)), got.shape[1])
                    first, second = got.ravel() // names, got.ravel() % names
                    order = np.lexsort((second, first, owner))
                    owner, first, second = owner[order], first[order], second[order]
                    cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(second)], pa.int32()), pa.array(second, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(t * names + first[cut], pa.int32()), lists, part.column(0).take(pa.array(owner[cut])), part.column(1).take(pa.array(owner[cut]))], ["__place", "__axes", "__key", "__v"])

    made = staged(distinct.select("__key", "__v").mapInArrow(index, "__place int, __axis int, __key long, __v array<double>"), "ann-index")
    own = rows.filter(F.col("__id") % queries_every == 0)
    wanted = staged(own.select("__v").join(distinct.select("__v", "__key"), "__v").select("__key", "__v").dropDuplicates(["__key"]), "ann-asked")
    # a place is a table and the first axis, of which there is a fixed number; its rows are dealt to blocks of bounded size
    blocks = made.groupBy("__place").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__blocks"))
    left = made.join(F.broadcast(blocks), "__place").withColumn("__block", F.pmod(F.xxhash64("__key"), F.col("__blocks")).cast("int")).drop("__blocks")

    def search(there: pa.Table, asks: pa.Table) -> pa.Table:
        found: list[tuple] = []

        def best_of(qi: np.ndarray, xi: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.lexsort((keys[xi], -score, qi))
            order = order[np.arange(len(qi)) - np.searchsorted(qi[order], qi[order]) <= k]
            return qi[order], xi[order], score[order]

        if there.num_rows and asks.num_rows:
            there, asks = there.combine_chunks(), asks.combine_chunks()
            x, q = (np.asarray(t.column("__v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (there, asks))
            xn, qn = padded(x), padded(q)
            keys, owners = there.column("__key").to_numpy(), asks.column("__key").to_numpy()
            axis = there.column("__axis").to_numpy()
            lists = asks.column("__axes").combine_chunks()
            second, of = np.asarray(lists.flatten()), np.repeat(np.arange(len(owners)), np.diff(np.asarray(lists.offsets)))
            for a in np.unique(axis):
                at, who = np.flatnonzero(axis == a), of[second == a]
                for i in range(0, len(who), 1024):
                    some = who[i : i + 1024]
                    s = qn[some] @ xn[at].T
                    m = min(k + 1, len(at))  # and all that come so near to the last of them that exact scores may turn them
                    i_, j_ = np.nonzero(s >= -np.partition(-s, m - 1, axis=1)[:, m - 1 : m] - 1e-9)
                    for e in range(0, len(i_), 1 << 16):
                        qi, xi = some[i_[e : e + (1 << 16)]], at[j_[e : e + (1 << 16)]]
                        found.append(best_of(qi, xi, cosines(q[qi], x[xi])))
        if not found:
            return pa.table({"__query": pa.array([], pa.int64()), "__key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qi, xi, score = best_of(*(np.concatenate([f[i] for f in found]) for i in range(3)))
        return pa.table({"__query": owners[qi], "__key": keys[xi], "score": score})

    def ranked(there: DataFrame, asks: DataFrame, name: str) -> DataFrame:
        """(__query, score, __ids) of the nearest vectors in the places that are asked for."""
        at = ["__place", "__block"]
        asks = asks.join(F.broadcast(blocks), "__place").withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
        pairs = there.groupBy(*at).cogroup(asks.groupBy(*at)).applyInArrow(search, "__query long, __key long, score double")
        pairs = pairs.groupBy("__query", "__key").agg(F.max("score").alias("score"))
        best = Window.partitionBy("__query").orderBy(F.desc("score"), "__key")
        pairs = pairs.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= k + 1).drop("__r")
        return staged(pairs.join(distinct.select("__key", "__ids"), "__key").select("__query", "score", "__ids"), name)

    named = ranked(left, wanted.mapInArrow(asked, "__place int, __axes array<int>, __key long, __v array<double>"), "ann-pairs")
    # queries that lie so far from all others that their buckets hold too few look into every bucket of one table
    enough = named.groupBy(F.col("__query").alias("__key")).agg(F.sum(F.size("__ids")).alias("n")).filter(F.col("n") >= min(k + 1, rows.count()))
    short = staged(wanted.join(enough, "__key", "left_anti"), "ann-short")
    if not short.isEmpty():
        every = short.select(F.explode(F.sequence(F.lit(0), F.lit(names - 1))).alias("__place"), F.sequence(F.lit(0), F.lit(names - 1)).alias("__axes"), "__key", "__v")
        whole = ranked(left.filter(F.col("__place") < names), every, "ann-whole")
        named = named.join(short.select(F.col("__key").alias("__query")), "__query", "left_anti").unionByName(whole)
    named = named.select("__query", "score", F.explode("__ids").alias("vec_id"))
    asking = own.join(distinct.select("__v", "__key"), "__v").select(F.col("__id").alias("query_id"), F.col("__key").alias("__query")).distinct()
    out = asking.join(named, "__query").filter(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
