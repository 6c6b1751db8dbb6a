"""Substring dedup by sliding sentence spans.

Every run of RUN consecutive sentences, or of as many more as it takes to have LEAST_WORDS words, is hashed, and so is every single
sentence of LONE_WORDS words; the hashes are joined over all documents. The first run of its hash, by id and place, stays; the
sentences that any other run of it covers are removed, wherever runs overlap, too.

A sentence ends at . ! or ? unless a letter or digit follows, at their full-width forms, or at a line's end; a stretch of more than
LONGEST words without an end is cut after words chosen by their hash, so that equal stretches are cut alike wherever they begin.
Case, punctuation and spacing are ignored in hashing. Short runs agree by chance, the more often the larger the corpus, hence
the number of words.

Defined results: a null text stays null, texts of fewer words than a run, and of fewer sentences if none is long, stay whole;
repeats inside one document count like those between documents; of rows with equal ids the one with the smaller text hash is the
earlier, and of equal rows all stay or go alike after the first place; null ids come first; columns of the result's names
(n_removed, removed) are replaced, all other columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices, staged
from graphloom.llm.words import hashed, mixed

RUN, LEAST_WORDS, LONE_WORDS = 2, 20, 25
#: Words from which a stretch without an end is cut, one in how many words ends a piece there, and the most words of a piece.
LONGEST, CUT_ONE_IN, PIECE = 50, 16, 25
SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?]+(?=\w)[^.!?。！？\n]*)*(?:[.!?。！？]+|\n|$)\s*")
WORD = re.compile("[0-9A-Za-z_\x80-\U0010ffff]+")
_BASE = 0x9E3779B97F4A7C15
_TURN = np.random.default_rng(17).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans that cover the text: each sentence with the white space after it."""
    return [m.span() for m in SENTENCE.finditer(text) if m.end() > m.start()]


def pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the pieces of a stretch without an end: cut after each word that its hash chooses, and after PIECE words without one."""
    words = list(WORD.finditer(text, start, end))
    marks = [i + 1 for i, m in enumerate(words) if zlib.crc32(m[0].lower().encode()) % CUT_ONE_IN == 0]
    cuts: list[int] = []
    for a, b in zip([0, *marks], [*marks, len(words)], strict=True):
        cuts += [*range(a + PIECE, b, PIECE), b]
    edges = [start, *(words[c].start() for c in cuts if c < len(words)), end]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


@dataclass(frozen=True)
class Runs:
    """Of a text: the spans of its sentences; own: those that have words. A run has a hash, and its first and last one of own."""

    spans: list[tuple[int, int]]
    own: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray


def runs(text: str, run: int = RUN, least: int = LEAST_WORDS) -> Runs:
    spans = sentences(text)
    words = hashed(pa.array([text[a:b] for a, b in spans], pa.string()))
    n = np.diff(words.first)
    if (n > LONGEST).any():
        spans = [p for (a, b), m in zip(spans, n.tolist(), strict=True) for p in (pieces(text, a, b) if m > LONGEST else [(a, b)])]
        words = hashed(pa.array([text[a:b] for a, b in spans], pa.string()))
        n = np.diff(words.first)
    own = np.flatnonzero(n)
    n = n[own]
    none = np.zeros(0, np.int64)
    if not len(own):
        return Runs(spans, own, none, none, none)
    head = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(head, n)
    each = mixed(np.add.reduceat(words.hashes * (_TURN[place & 63] + (place >> 6).astype(np.uint64)), head) + n.astype(np.uint64))
    first = np.arange(len(own))
    last = np.maximum(np.searchsorted(np.cumsum(n), head + least), first + run - 1)
    first, last = first[last < len(own)], last[last < len(own)]
    lone = np.flatnonzero(n >= max(LONE_WORDS, least)) if run > 1 else none
    first, last = np.concatenate([first, lone]), np.concatenate([last, lone])
    # hash of sentences i to j from prefix sums of powers of an odd number, which has an inverse
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(own), x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * up[:-1], dtype=np.uint64)])
    segment = (sums[last + 1] - sums[first]) * down[first]
    return Runs(spans, own, mixed(segment + (last - first).astype(np.uint64)).view(np.int64), first, last)


def hashed_runs(rows: DataFrame, run: int, least: int) -> DataFrame:
    """(__id, __tie, __at, __hash) of rows(__id, __tie, __text): a row for each run; __at is its number, and equal runs are numbered by place."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                got = [(r.hashes, np.arange(len(r.hashes))) for r in (runs(t or "", run, least) for t in part.column(2).to_pylist())]
                of = pa.array(np.repeat(np.arange(part.num_rows), [len(h) for h, _ in got]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(np.concatenate([a for _, a in got]), pa.int32()), pa.array(np.concatenate([h for h, _ in got]), pa.int64())], ["__id", "__tie", "__at", "__hash"])

    return rows.mapInArrow(go, "__id long, __tie long, __at int, __hash long")


def repeated(rows: DataFrame, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """(__id, __tie, __starts): for each document the runs that came before."""
    all_ = staged(hashed_runs(rows, run, least), "span-runs")
    place = F.struct("__id", "__tie", "__at")
    # counted before the shuffle, so that a hash that all documents share is a row of each task; written, so that both sides of
    # the join are plain shuffles, whose hot keys adaptive execution splits
    first = all_.groupBy("__hash").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("__hash", "f")
    first = staged(first, "span-first")
    later = all_.join(first.hint("shuffle_merge"), "__hash").filter(place > F.col("f"))
    # a text's hash stands for it: a row that is repeated whole shares its place with the first and stays
    return staged(later.groupBy("__id", "__tie").agg(F.sort_array(F.collect_set("__at")).alias("__starts")), "span-found")


def covered(text: str, starts: list[int], run: int, least: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the sentences that the runs of these numbers cover, joined where they touch, and the number of sentences."""
    r = runs(text, run, least)
    edge = np.zeros(len(r.spans) + 1, np.int64)
    np.add.at(edge, r.own[r.first[starts]], 1)
    np.add.at(edge, r.own[r.last[starts]] + 1, -1)
    gone = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    out: list[list[int]] = []
    for i in gone.tolist():
        a, b = r.spans[i]
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out], len(gone)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """docs with the repeated sentences taken out of the text, and with n_removed (sentences) and removed (their spans in the old text)."""
    tie = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), tie.alias("__tie"), F.col(text_col).alias("__text"))
    found = repeated(rows, run, least)
    kept = [c for c in docs.columns if c not in ("n_removed", "removed")]
    left = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(id_col).cast("string"), F.lit("~")).alias("__key"), tie.alias("__tie"))
    found = found.select(F.coalesce(F.col("__id").cast("string"), F.lit("~")).alias("__key"), "__tie", "__starts")
    joined = left.join(found.hint("shuffle_merge"), ["__key", "__tie"], "left")  # both sides grow with the corpus
    at = kept.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, starts = batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist()
            both = [covered(t, s, run, least) if t and s else ([], 0) for t, s in zip(old, starts, strict=True)]
            gone, count = [g for g, _ in both], [n for _, n in both]
            new = [t if not g else "".join(t[a:b] for a, b in zip([0, *(e for _, e in g)], [*(s for s, _ in g), len(t)], strict=True)) for t, g in zip(old, gone, strict=True)]
            cols = [batch.column(i) for i in range(len(kept))]
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int32()), pa.array([[{"start": a, "end": b} for a, b in g] for g in gone], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*kept, "n_removed", "removed"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return joined.select(*(F.col(f"`{c}`") for c in kept), "__starts").mapInArrow(go, f"{fields}, n_removed int, removed array<struct<start:long,end:long>>")
