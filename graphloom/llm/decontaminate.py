"""Benchmark decontamination by the CGK embedding.

Words are numbered by hash. From a start, a CGK walk reads a word at each step and advances or stays by a random bit of the word
and the step: two passages a small edit distance apart soon walk in step again, so their walks differ in few places. A hash
reads the walk at a few random steps; several hashes, over windows at every second word (those whose hash is even, in items and
documents alike), reach the recall wanted. The walk covers the item: short items are walked for SHORT steps, others for LONG ones.
Walks alone lose copies with many edits, so items are also met by runs of equal words, which lose none: e edits of n words leave a
run of (n - e) / (e + 1) words or more untouched, and every such run of an item is looked for at every word of a document.
What shares a hash or a run with an item is verified by the exact word edit distance of the item to the best passage of the document there.

Items are taken in blocks of bounded size, each broadcast; documents are never shuffled.

Defined results: null and empty texts match nothing, and an item of fewer than LEAST_WORDS words only matches its words
as they are, without an edit; equal documents give equal hits; items of equal text are all reported; the best passage for an item and document is reported once for
each place where it occurs; empty tables give no rows;
rows without an id are searched and items without one reported as such; ids are of any type; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_type, slices
from graphloom.llm.words import hashed

LEAST_WORDS = 8
SHORT, LONG, LONG_FROM = 16, 40, 30
HASHES, SAMPLES = 9, 7
#: A passage is a copy if its edits are at most this share of the item's words.
EDITS = 0.2
#: Items of a block, and characters of their texts, that are sent to the executors at once.
ITEMS_AT_ONCE, ITEM_CHARS = 20_000, 4 << 20
HASHED_AT_ONCE = 20_000
_RNG = np.random.default_rng(21)
#: For each hash the steps it reads, and odd factors to mix what it reads.
STEPS = {s: np.sort(np.array([_RNG.choice(s, SAMPLES, replace=False) for _ in range(HASHES)]), axis=1) for s in (SHORT, LONG)}
FACTORS = _RNG.integers(1, 1 << 62, (HASHES, SAMPLES), dtype=np.uint64) | np.uint64(1)
SIEVE_BITS = 22
#: The longest run of equal words that is looked for; a shorter one than the bound leaves loses nothing.
MOST_RUN = 4


def anchors(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(words >> np.uint64(63) == 0)


def walked(words: np.ndarray, starts: np.ndarray, classes: tuple[int, ...] = (SHORT, LONG)) -> Iterator[tuple[int, int, np.ndarray]]:
    """(class, hash number, hash of each start). Past the end, a walk reads zeros."""
    steps = max(classes, default=0)
    x = np.concatenate([words, np.zeros(steps + 1, np.uint64)])
    used = {c: {int(s): None for s in np.unique(STEPS[c])} for c in classes}
    at = starts.copy()
    for j in range(steps):
        now = x[at]
        for c in classes:
            if j in used[c]:
                used[c][j] = now
        at = at + ((now >> np.uint64(j + 8)) & np.uint64(1)).view(np.int64)
    for c in classes:
        for h in range(HASHES):
            out = np.full(len(starts), h * 2 + (c == LONG), np.uint64)
            for i, s in enumerate(STEPS[c][h]):
                out = (out ^ used[c][int(s)]) * FACTORS[h, i]
                out ^= out >> np.uint64(31)
            yield c, h, out


def most_edits(n: int, share: float) -> int:
    return int(share * n) if n >= LEAST_WORDS else 0


def run_length(n: int, share: float) -> int:
    """Words that stay together in any copy of n words within the bound, up to MOST_RUN."""
    e = most_edits(n, share)
    return min(MOST_RUN, -(-(n - e) // (e + 1)))


def word_runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for i in range(n):
        out = (out ^ words[i : i + len(out)]) * FACTORS[0, i]
        out ^= out >> np.uint64(31)
    return out


def edits(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits that turn the item into some part of the passage, and that part's start and end: the exact distance by
    rows, where a word of the passage before or after the part costs nothing."""
    n = len(passage)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, w in enumerate(item):
        diagonal = cost[:-1] + (passage != w)
        above = cost + 1
        new = above.copy()
        new[1:] = np.minimum(above[1:], diagonal)
        come = begin.copy()
        better = diagonal <= above[1:]
        come[1:][better] = begin[:-1][better]
        # words of the passage between those matched: a running minimum along the row
        low = np.minimum.accumulate(new - ramp)
        source = np.maximum.accumulate(np.where(new - ramp == low, ramp, 0))
        cost, begin = low + ramp, come[source]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class Items:
    """The items' words, and by hash which item and at which word of it. share: of an item's words, the edits that hits() may take."""

    def __init__(self, rows: list[tuple[int, str]], share: float = EDITS):
        self.ids, self.words, self.sizes = [], [], []
        keys, places = [], []
        texts = hashed(pa.array([t for _, t in rows], pa.string()))
        for i, (item, _) in enumerate(rows):
            words = texts.of(i)
            if not len(words):
                continue
            if len(words) >= LEAST_WORDS:
                c = LONG if len(words) >= LONG_FROM else SHORT
                reach = min(len(words), (c + 1) // 2)  # a walk of c steps reads about half as many words
                starts = anchors(words)
                starts = np.union1d(starts[starts <= len(words) - reach], [0])
                for _, _, h in walked(words, starts, (c,)):
                    keys.append(h)
                    places.append(np.stack([np.full(len(starts), len(self.ids)), starts], axis=1))
            n = run_length(len(words), share)
            keys.append(word_runs(words, n))
            places.append(np.stack([np.full(len(words) - n + 1, len(self.ids)), np.arange(len(words) - n + 1)], axis=1))
            self.ids.append(item)
            self.words.append(words)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], (np.concatenate(places)[order] if len(order) else np.zeros((0, 2), np.int64))
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.keys >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        self.runs = sorted({run_length(len(w), share) for w in self.words})
        self.classes = tuple(c for c in (SHORT, LONG) if any((len(w) >= LONG_FROM) == (c == LONG) for w in self.words if len(w) >= LEAST_WORDS))

    def candidates(self, words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Rows (place in words where the item would start, item) that share a hash; words holds documents one after the other,
        each from a place in firsts on and followed by a 0, where walks stop. Starts are rounded, as nearby ones mean one place."""
        found = []
        chosen = (words >> np.uint64(63) == 0) & (words != 0)
        chosen[firsts] = True
        starts = np.flatnonzero(chosen)
        every = [(np.arange(len(words) - n + 1), word_runs(words, n)) for n in self.runs if n <= len(words)]
        for starts, h in itertools.chain(((starts, h) for _, _, h in walked(words, starts, self.classes)), every):
            hit = np.flatnonzero(self.sieve[(h >> np.uint64(64 - SIEVE_BITS)).view(np.int64)])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(self.keys, h[hit], "left"), np.searchsorted(self.keys, h[hit], "right")
            n = hi - lo
            at = np.repeat(starts[hit], n)
            place = self.places[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            doc = np.searchsorted(firsts, at, "right") - 1
            found.append(np.stack([doc, place[:, 0], (at - firsts[doc] - place[:, 1]) // 4 * 4], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def hits(self, docs: list[np.ndarray], share: float) -> list[list[tuple[int, int, int, int]]]:
        """For each document (item, first word, end, edits) of the copies in it."""
        out: list[dict[tuple[int, int], tuple[int, int]]] = [{} for _ in docs]
        if not len(self.keys):
            return [[] for _ in docs]
        at = 0
        while at < len(docs):  # documents are hashed together, so many that the arrays stay in a core's cache
            n, to = 0, at
            while to < len(docs) and (to == at or n + len(docs[to]) < HASHED_AT_ONCE):
                n, to = n + len(docs[to]) + 1, to + 1
            some = docs[at:to]
            ends = np.cumsum([len(d) + 1 for d in some])
            words = np.concatenate([x for d in some for x in (d, np.zeros(1, np.uint64))])
            for doc, item, start in self.candidates(words, ends - [len(d) + 1 for d in some]).tolist():
                own, text = self.words[item], some[doc]
                most = most_edits(len(own), share)
                slack = 4 + most
                a, b = max(0, start - slack), min(len(text), start + len(own) + slack + 4)
                if np.isin(own, text[a:b]).sum() < len(own) - most:
                    continue  # within the bound, all but so many of the item's words occur there
                n, first, end = edits(own, text[a:b])
                if n <= most:
                    key, into = (item, a + first), out[at + doc]
                    into[key] = min(into.get(key, (n, a + end)), (n, a + end))
            at = to
        return [sorted((item, a, b, n) for (item, a), (n, b) in o.items()) for o in out]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, at_once: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most at_once, and of ITEM_CHARS characters or one item more, in the order of their ids."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    block: list[tuple[int, str]] = []
    size = 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if len(block) == at_once or size >= ITEM_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def found(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = EDITS, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """A row for each copy of an item in a document: id, item, start and end as code points, edits, item_words."""
    spark, out = docs.sparkSession, None
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind, item_type = benchmark.schema[item_col].dataType.simpleString(), arrow_type(benchmark, item_col)
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, start long, end long, edits int, item_words int"
    names = [id_col, item_col, "start", "end", "edits", "item_words"]
    for block in item_blocks(benchmark, item_col, item_text, at_once):
        sent = spark.sparkContext.broadcast(Items(block, share))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                rows, got = [], []
                at = 0
                for part in slices(batch, 1, 128):
                    texts = hashed(part.column(1))
                    for i, hits in enumerate(items.hits([texts.of(i) for i in range(len(texts.first) - 1)], share)):
                        for item, a, b, n in hits:
                            rows.append(at + i)
                            got.append((items.ids[item], *texts.span(i, a, b), n, len(items.words[item])))
                    at += part.num_rows
                cols = list(zip(*got, strict=True)) if got else [[]] * 5
                types = (item_type, pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names)

        part = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_copies(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = EDITS, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """docs without the documents that hold a copy of an item; all columns stay, and nothing is shuffled."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text, at_once):
        sent = spark.sparkContext.broadcast(Items(block, share))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                keep: list[bool] = []
                for part in slices(batch, at, 128):
                    texts = hashed(part.column(at))
                    keep += [not h for h in items.hits([texts.of(i) for i in range(len(texts.first) - 1)], share)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
