"""Toxicity by multiple-instance learning.

A document is a bag of sentences, of which only the bag has a label. A sentence's score is logistic in its features (words,
their beginnings and their n-grams of characters); a document's score is the noisy-or of its sentences: 1 - prod(1 - p). The
weights are trained through the noisy-or from document labels, and then locate the offending sentences.

Only labels of rows whose crc32(id as text) mod 3 is not 1 are learned from; label, language, source and id are no features.
The training sample is bounded (SAMPLE documents of each label, the first by hash, none above SAMPLE_CHARS characters).

Defined results: null and empty texts have no sentence and score 0; equal texts score alike; whole texts are scored however long;
rows with a null id score too and are never learned from; of several labels of one id the highest counts, of several texts the
first in order; other columns are ignored by the query; without any usable label every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import sampled, texts_in

SAMPLE, SAMPLE_CHARS = 2000, 20_000
THRESHOLD = 0.7
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
TOKEN = re.compile(r"\w+")
GRAM, BEGINNINGS = 5, range(3, 9)


def features(word: str) -> list[str]:
    """The word itself, its beginnings, and its n-grams."""
    out = ["=" + word]
    out += ["^" + word[:n] for n in BEGINNINGS if len(word) >= n]
    out += [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
    return out


def sentences(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text or "") if m[0].strip()]


class WordWeights(dict):
    """A word's weight, the sum of its features' weights; kept for words that came before, up to a bound."""

    def __init__(self, weights: dict[str, float], most: int = 100_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        got = self.weights.get
        self[word] = out = sum(got(f, 0.0) for f in features(word))
        return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def sentence_scores(self, text: str | None, words: WordWeights) -> list[tuple[int, int, float]]:
        text = (text or "")
        out = []
        for a, b in sentences(text):
            z = self.bias + sum(map(words.__getitem__, TOKEN.findall(text[a:b].lower())))
            out.append((a, b, 1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z))))))
        return out


def noisy_or(scores: list[float]) -> float:
    return float(min(1.0, max(0.0, 1.0 - np.exp(np.log1p(-np.minimum(np.array(scores), 1 - 1e-12)).sum())))) if scores else 0.0


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def telling(pos: int, neg: int, all_pos: int, all_neg: int) -> float:
    """Log-likelihood ratio by which a feature's share of toxic documents exceeds the share among all; 0 if it doesn't."""
    n, all_ = pos + neg, all_pos + all_neg
    if pos * all_ <= n * all_pos:
        return 0.0
    return 2 * (pos * np.log(pos * all_ / (n * all_pos)) + (neg * np.log(neg * all_ / (n * all_neg)) if neg else 0.0))


def trained(bags: list[list[list[str]]], labels: list[int], rounds: int = 200, decay: float = 2e-5, least: float = 12.0) -> Model:
    """Fits by gradient steps (Adam) through the noisy-or. bags: for each document, for each sentence, its words.

    Only features that tell toxic documents by a log-likelihood ratio of `least` get a weight: in a bag, it takes evidence for
    the label to mark a sentence, and all other sentences share the bias.
    """
    number: dict[str, int] = {}
    of = lru_cache(50_000)(features)
    docs_with: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for wanted in (1, 0):  # others than those of several toxic documents need not be counted
        some = None if wanted else {f for f, n in docs_with[1].items() if n > 1}
        for bag, label in zip(bags, labels, strict=True):
            if label == wanted:
                found = {f for w in {w for s in bag for w in s} for f in of(w)}
                for f in found if some is None else found & some:
                    docs_with[label][f] = docs_with[label].get(f, 0) + 1
    all_pos = sum(labels)
    for f, n in docs_with[1].items():
        if n > 1 and telling(n, docs_with[0].get(f, 0), all_pos, len(labels) - all_pos) >= least:
            number[f] = len(number)
    docs_with = ({}, {})
    if not number or len(set(labels)) < 2:
        return Model({}, -30.0)
    cols, row_len, doc_of = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            got = [number[f] for w in s for f in of(w) if f in number]
            cols.append(np.array(got, np.int32))
            row_len.append(len(got))
            doc_of.append(d)
    col, row = np.concatenate(cols), np.repeat(np.arange(len(row_len)), row_len)
    doc, y = np.array(doc_of), np.array(labels, bool)
    n, m = len(number), len(row_len)
    w, b = np.zeros(n), -5.0
    state, bstate = (np.zeros(n), np.zeros(n)), [0.0, 0.0]
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(row, w[col], m) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        q = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of the chance that no sentence offends
        keep = np.exp(np.minimum(q, -1e-9))
        g = p * np.where(y, -keep / (1 - keep), 1.0)[doc] / len(y)
        gw, gb = np.bincount(col, g[row], n) + decay * w, g.sum()
        for s, x in ((state, gw), (bstate, gb)):
            for i, e in ((0, 0.9), (1, 0.99)):
                if s is state:
                    s[i][:] = e * s[i] + (1 - e) * x ** (i + 1)
                else:
                    s[i] = e * s[i] + (1 - e) * x ** (i + 1)
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= 0.15 * fix * state[0] / (np.sqrt(state[1]) + 1e-8)
        b -= 0.05 * fix * bstate[0] / (np.sqrt(bstate[1]) + 1e-8)
    return Model({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 0.02}, float(b))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """Trained from a bounded sample of labelled rows that aren't held out."""
    own = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter(~held_out(F.col("__id")) & F.col("__y").isin(0, 1)).groupBy("__id").agg(F.max("__y").alias("__y"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).filter(~held_out(F.col("__id")) & (F.length("__t") <= SAMPLE_CHARS))
    got = []
    for y in (0, 1):
        # the sample is chosen among ids first, so that only its texts are joined
        some = sampled(own.filter(F.col("__y") == y), [F.col("__id")], sample)
        one = rows.join(F.broadcast(some), "__id").groupBy("__id", "__y").agg(F.min("__t").alias("__t"))  # a row for each id, however often it occurs
        got += one.select("__id", "__t", "__y").collect()
    got.sort(key=lambda r: (r["__y"], r["__id"]))
    bags = [[TOKEN.findall(r["__t"][a:b].lower()) for a, b in sentences(r["__t"])] for r in got]
    return trained(bags, [r["__y"] for r in got])


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: id, held_out, score, predicted, and the offending sentences (start, end, score), all without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordWeights(model.weights)
        for batch in batches:
            at = 0
            for (texts,) in texts_in([batch], ["__text"]):
                each = [model.sentence_scores(t, words) for t in texts]
                total = [noisy_or([p for _, _, p in e]) for e in each]
                spans = [[{"start": a, "end": b, "score": p} for a, b, p in e if p >= 0.5] for e in each]
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total, pa.float64()), pa.array([int(s >= threshold) for s in total], pa.int32()), pa.array(spans, found)], [id_col, "held_out", "score", "predicted", "offending"])

    rows = docs.select(F.col(id_col).alias("__id"), held_out(F.col(id_col)).alias("__held"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score the threshold or more; all columns stay, and each row is judged where it lies."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordWeights(model.weights)
        for batch in batches:
            keep: list[bool] = []
            for start in range(0, batch.num_rows, 256):
                keep += [noisy_or([p for _, _, p in model.sentence_scores(t, words)]) < threshold for t in batch.column(at).slice(start, 256).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
