"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its shingles of five words, each weighing as often as it occurs. Hashed darts are thrown at the
regions of its elements (one region for each unit of weight, a dart's height decides whether it lies under a fractional weight);
each dart falls to one of K coordinates, and a coordinate keeps its earliest dart. Two documents agree in a coordinate with a
chance equal to their weighted Jaccard similarity. Only darts early enough to matter are looked at: about K log K of them for a
document of any length, with a later limit where a coordinate stayed empty.

Coordinates are joined by bands. In a bucket every member is first compared with one leader, by exact similarity. In buckets that
then still hold several classes all members are compared, block against block by a product of matrices, and each pair of blocks
gives only the links that join its classes; pairs within a bucket are never rows. So every two documents that share a bucket end
in one class or have been compared. Equal texts are one node throughout, so copies cost nothing.

Defined results: a null text is never a duplicate; equal texts (empty ones, too) are one class; a text of one to four words has
one shingle, all its words; rows of one id are one document; a row with a null id gets the class of its equal texts, or null; a
class is named by its smallest id; whole texts count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import join_counted, staged
from graphloom.llm.words import hashed, mixed

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and coordinates in each: a pair at the similarity above shares no band with a chance of 3e-6.
FIRST = (32, 5)
#: Members of a bucket in a block, and shingles (columns) that are multiplied at once.
BLOCK, COLUMNS = 1024, 2048
_RNG = np.random.default_rng(9)
_TURN = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        return mixed(np.array([(words * _TURN[:n]).sum() + np.uint64(n)], np.uint64))
    out = words[: n - SHINGLE + 1] * _TURN[0]
    for j in range(1, SHINGLE):
        out = out + words[j : n - SHINGLE + 1 + j] * _TURN[j]
    return mixed(out)


def weighted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles and how often each occurs."""
    return np.unique(shingles(words), return_counts=True)


def units(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regions: an element for each unit of weight begun, and how much of the unit the weight fills."""
    n = np.ceil(weights).astype(np.int64)
    layer = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mixed(np.repeat(elements, n) + layer.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.minimum(1.0, np.repeat(weights, n) - layer)


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def darts(elements: np.ndarray, weights: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The signature of one weighted set: for each of k coordinates the earliest dart's number."""
    return thrown(elements, weights, np.zeros(len(elements), np.int64), 1, k, seed)[0]


def thrown(elements: np.ndarray, weights: np.ndarray, of: np.ndarray, n: int, k: int, seed: int, widen: float = 1.0) -> np.ndarray:
    """Signatures (n, k) of n weighted sets at once; of: the set of each element. Weights are positive, and no set is empty."""
    weights = np.asarray(weights, np.float64)
    layers = np.ceil(weights).astype(np.int64)
    region, filled = units(elements, weights)
    region, of_unit = region ^ mixed(np.array([seed + 1], np.uint64)), np.repeat(of, layers)
    whole = np.bincount(of, weights, n)
    limit = (widen * (np.log(k) + 2.0) * k / whole)[of_unit]
    # darts reach a region at the times of a Poisson process: the next follows after an exponential pause
    time, live, step = np.zeros(len(region)), np.arange(len(region)), 0
    numbers, times, owners = [], [], []
    while len(live):
        h = mixed(region[live] + np.uint64((step * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        now = time[live] - np.log(uniform(h))
        early = now <= limit[live]
        live, h, now = live[early], h[early], now[early]
        time[live] = now
        part = filled[live]
        if part.min(initial=1.0) < 1.0:  # a dart above a fractional weight misses
            inside = uniform(mixed(h + np.uint64(1))) <= part
            numbers.append(h[inside]), times.append(now[inside]), owners.append(of_unit[live][inside])
        else:
            numbers.append(h), times.append(now), owners.append(of_unit[live])
        step += 1
    number, at, owner = np.concatenate(numbers), np.concatenate(times), np.concatenate(owners)
    place = owner * k + ((number >> np.uint64(7)) % np.uint64(k)).astype(np.int64)
    order = np.argsort(-at)  # the earliest is written last, and stays
    out, hit = np.zeros(n * k, np.uint64), np.zeros(n * k, bool)
    out[place[order]] = mixed(number[order])
    hit[place] = True
    out, short = out.reshape(n, k), ~hit.reshape(n, k).all(axis=1)
    if short.any() and widen < 1e6:  # a coordinate that is empty still needs later darts
        again = np.flatnonzero(short)
        some = short[of]
        out[again] = thrown(elements[some], weights[some], np.searchsorted(again, of[some]), len(again), k, seed, widen * 2)
    return out


def band_names(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = mixed(signature.reshape(-1, bands, rows) + np.arange(rows, dtype=np.uint64))
    return mixed(x.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signed(docs: DataFrame, bands: int, rows: int, seed: int) -> DataFrame:
    """(__id, __bands) of the rows (__id, __text) that have a word."""
    step = max(8, 16_000 // (bands * rows))  # documents at once: their darts take some tens of megabytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = hashed(part.column(1))
                some = [i for i in range(part.num_rows) if texts.first[i + 1] > texts.first[i]]
                flat = pa.array([], pa.int64())
                if some:
                    own = [weighted(texts.of(i)) for i in some]
                    of = np.repeat(np.arange(len(own)), [len(e) for e, _ in own])
                    marks = thrown(np.concatenate([e for e, _ in own]), np.concatenate([w for _, w in own]), of, len(own), bands * rows, seed)
                    flat = pa.array(band_names(marks, bands, rows).ravel(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some, pa.int64())), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), flat)], ["__id", "__bands"])

    return docs.mapInArrow(run, "__id long, __bands array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """(__id, __set) of the rows (__id, __text): 32-bit hashes of the units of weight, so that sets' Jaccard is the documents' weighted
    one, but for chance: two documents of 500 units share a hash of different units with a chance of 6e-5, which adds 1 to 500."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = hashed(part.column(1))
                own = [np.unique((units(*weighted(texts.of(i)))[0] >> np.uint64(32)).astype(np.uint32)).view(np.int32) for i in range(part.num_rows)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*own, np.zeros(0, np.int32)]), pa.int32()))], ["__id", "__set"])

    return docs.mapInArrow(run, "__id long, __set array<int>")


def leaders(bands: DataFrame, seed: int) -> DataFrame:
    """bands(__id, __bands) to (__bucket, __id, __leader) of the buckets that documents share."""
    rows = bands.select("__id", F.explode("__bands").alias("__bucket"))
    rank = F.struct(F.xxhash64("__id", F.lit(seed)).alias("r"), F.col("__id").alias("i"))
    lead = rows.groupBy("__bucket").agg(F.min("__id").alias("lo"), F.max("__id").alias("hi"), F.min(rank).alias("m")).filter("lo <> hi")
    return rows.join(lead.select("__bucket", F.col("m.i").alias("__leader")).hint("shuffle_merge"), "__bucket").select("__bucket", "__id", "__leader")


def common_units(sets_: list[np.ndarray], split: int) -> np.ndarray:
    """How many units each of the first split sets shares with each of the others, or the sets with each other if there are no others."""
    flat, of = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), [len(x) for x in sets_])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    column, of = (np.cumsum(n > 1) - 1)[column[shared]], of[shared]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    out = np.zeros((split, len(sets_) - split or split), np.float32)  # counts are whole, and exact below 2^24
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(sets_), COLUMNS), np.float32)
        x[of[a:b], column[a:b] - at] = 1
        out += x[:split] @ (x[split:] if split < len(sets_) else x).T
    return out


def joining(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of the links a[i], b[i] between n classes so many, by number, as join what all of them join: less than n."""
    label, chosen = np.arange(n), []
    left = np.arange(len(a))
    while True:
        lo, hi = np.minimum(label[a[left]], label[b[left]]), np.maximum(label[a[left]], label[b[left]])
        apart = lo < hi
        left, lo, hi = left[apart], lo[apart], hi[apart]
        if not len(left):
            return np.concatenate(chosen) if chosen else left
        order = np.lexsort((lo, hi))
        heads = order[np.r_[True, np.diff(hi[order]) > 0]]  # each hangs itself on the smallest, so that no cycle can arise
        chosen.append(left[heads])
        up = np.arange(n)
        up[hi[heads]] = lo[heads]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def block_links(rows: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Links (__id, __leader) of at least the similarity that join the classes in each bucket of rows(__bucket, __n, __id, __class): all
    members of different classes are compared, in pairs of blocks that hold at most about BLOCK of them each."""
    blocks = F.ceil(F.col("__n") / BLOCK).cast("int")
    dealt = rows.withColumn("__blocks", blocks).withColumn("__own", F.pmod(F.xxhash64("__id"), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    dealt = dealt.select("__bucket", F.least("__own", "__other").alias("__x"), F.greatest("__own", "__other").alias("__y"), "__own", "__id", "__class")
    wide = dealt.join(members.hint("shuffle_merge"), "__id").select("__bucket", "__x", "__y", "__own", "__id", "__class", "__set")

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own, first, second = (group.column(c).to_numpy() for c in ("__own", "__x", "__y"))
        order = np.argsort(own, kind="stable")
        split = int((own == first[0]).sum())
        ids, of = group.column("__id").to_numpy()[order], np.unique(group.column("__class").to_numpy()[order], return_inverse=True)[1]
        none = np.zeros(0, np.int64)
        i, j = none, none
        if of.max() > 0 and (first[0] == second[0] or split < len(own)):
            lists = group.column("__set").combine_chunks()
            flat, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            own_sets = [flat[ends[r] : ends[r + 1]] for r in order]
            size = np.array([len(x) for x in own_sets])
            both = common_units(own_sets, split).astype(np.float64)
            there = np.arange(split, len(size)) if split < len(size) else np.arange(split)
            i, j = np.nonzero((both >= least * (size[:split, None] + size[there][None, :] - both)) & (of[:split, None] != of[there][None, :]))
            j = there[j]
            some = joining(of[i], of[j], int(of.max()) + 1)
            i, j = i[some], j[some]
        return pa.table({"__id": pa.array(ids[i], pa.int64()), "__leader": pa.array(ids[j], pa.int64())})

    return wide.groupBy("__bucket", "__x", "__y").applyInArrow(compared, "__id long, __leader long")


def verified(pairs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Of the pairs (__id, __leader) those of at least the similarity."""
    one = pairs.join(members.hint("shuffle_merge"), "__id")
    other = members.select(F.col("__id").alias("__leader"), F.col("__set").alias("__other"))
    both = F.size(F.array_intersect("__set", "__other"))
    out = one.join(other.hint("shuffle_merge"), "__leader").withColumn("__both", both)
    return out.filter(F.col("__both") >= least * (F.size("__set") + F.size("__other") - F.col("__both"))).select("__id", "__leader")


def absorbed(names: DataFrame, links: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """names(__id, __class) after links (__id, __leader) join classes, and how many links joined two. rows bounds the links and names.

    A class hangs itself on the smallest class that it is linked with, if that is smaller, so that no cycle can arise; then every
    name is replaced by its root. Links that still lie between classes are taken again.
    """
    joined = 0
    while True:
        ends = named(named(links, names, "__id", "__a"), names, "__leader", "__b").filter("__a <> __b")
        ends = staged(ends.groupBy(F.greatest("__a", "__b").alias("x")).agg(F.min(F.least("__a", "__b")).alias("p")), "near-parents", rows)
        n = ends.count()
        if n == 0:
            return names, joined
        joined += n
        roots, moved = ends, True
        while moved:
            up = roots.select(F.col("x").alias("p"), F.col("p").alias("q"))
            roots = staged(roots.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "near-roots", rows)
            moved = not roots.filter("moved").isEmpty()
        to = roots.select(F.col("x").alias("__class"), "p")
        names = names.join(to, "__class", "left").select("__id", F.coalesce("p", "__class").alias("__class"))
        names = staged(names.unionAll(roots.select(F.col("x").alias("__id"), F.col("p").alias("__class"))), "near-names", rows)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document: id, class_id (the smallest id among its near duplicates), kept (whether it stands for its class)."""
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    texts = staged(rows.select("__id", F.unhex(F.md5("__text")).alias("__hash")), "near-texts")
    nodes = staged(texts.filter("__hash is not null").groupBy("__hash").agg(F.min("__id").alias("__node")), "near-nodes")
    known = nodes.select(F.col("__node").alias("__id")).filter("__id is not null").distinct()
    words = rows.filter("__id is not null and __text is not null")
    # every row is hashed where it lies; of equal texts the smallest id goes on
    first = staged(staged(signed(words, *FIRST, seed=0), "near-all-bands").join(known.hint("shuffle_merge"), "__id", "left_semi").dropDuplicates(["__id", "__bands"]), "near-bands")
    buckets = staged(leaders(first, 0), "near-buckets")
    ids = staged(buckets.select("__id").distinct(), "near-ids")
    n = ids.count()
    # one row for each node: rows of one id are one document, whichever text comes first
    members = staged(sets(join_counted(words, ids, "__id", "left_semi", n, 16)).groupBy("__id").agg(F.max("__set").alias("__set")), "near-sets")
    names = docs.sparkSession.createDataFrame([], "__id long, __class long")
    pairs = staged(buckets.filter("__id <> __leader").groupBy("__id", "__leader").agg(F.count(F.lit(1)).alias("__n")), "near-pairs")
    # the leader that shares most bands comes first; the others only where that left a document apart from them
    best = pairs.groupBy("__id").agg(F.max_by("__leader", F.struct("__n", -F.col("__leader"))).alias("__leader"))
    names, _ = absorbed(names, staged(verified(best, members, similarity), "near-links", n, heavy=True), n)
    apart = named(named(pairs, names, "__id", "__a"), names, "__leader", "__b").filter("__a <> __b")
    names, _ = absorbed(names, staged(verified(apart.select("__id", "__leader"), members, similarity), "near-links", n, heavy=True), n)
    # in buckets that still hold several classes all members are compared; buckets of the same members count once
    own = staged(named(buckets.select("__bucket", "__id"), names, "__id", "__a"), "near-own")
    several = own.groupBy("__bucket").agg(F.min("__a").alias("lo"), F.max("__a").alias("hi"), F.count(F.lit(1)).alias("__n"), F.bit_xor(F.xxhash64("__id")).alias("x"), F.sum(F.xxhash64("__id", F.lit(1)).cast("decimal(20,0)")).alias("y"))
    several = staged(several.filter("lo <> hi and __n > 2").groupBy("__n", "x", "y").agg(F.min("__bucket").alias("__bucket")).select("__bucket", "__n"), "near-several")
    mixed_ = own.join(several.hint("shuffle_merge"), "__bucket").select("__bucket", "__n", "__id", F.col("__a").alias("__class"))
    names, _ = absorbed(names, staged(block_links(mixed_, members, similarity), "near-links"), n)
    found = texts.join(nodes.hint("shuffle_merge"), "__hash", "left").select("__id", "__node")
    found = found.join(names.select(F.col("__id").alias("__node"), "__class").hint("shuffle_merge"), "__node", "left")
    class_id = F.coalesce("__class", "__node", "__id")
    return found.select(F.col("__id").alias(id_col), class_id.alias("class_id"), F.coalesce(F.col("__id") == class_id, F.lit(True)).alias("kept"))


def named(rows: DataFrame, names: DataFrame, of: str, to: str) -> DataFrame:
    """rows with the class of a column, an id without links being its own."""
    return rows.join(names.select(F.col("__id").alias(of), F.col("__class").alias(to)), of, "left").withColumn(to, F.coalesce(to, of))


def without_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class, that of the smallest id; all columns stay. Of several rows of one id the one of the
    smallest text hash stays, once; rows without an id stay."""
    found = staged(classes(docs, id_col=id_col, text_col=text_col, similarity=similarity), "near-found")
    drop = staged(found.filter(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id")).distinct(), "near-drop")
    out = docs.withColumn("__id", F.col(id_col).cast("long"))
    out = join_counted(out, drop, "__id", "left_anti", drop.count(), 16)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    again = found.filter(F.col("kept") & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = staged(again.select("__id"), "near-again")
    n = again.count()
    if not n:
        return out.select(*cols)
    several = join_counted(out, again, "__id", "left_semi", n, 16).withColumn("__own", F.struct(*cols))
    one = several.groupBy("__id").agg(F.min_by("__own", F.struct(F.xxhash64(F.col(f"`{text_col}`")), F.xxhash64("__own"))).alias("__own"))
    return join_counted(out, again, "__id", "left_anti", n, 16).select(*cols).unionAll(one.select(*(F.col(f"__own.`{c}`") for c in docs.columns)))
