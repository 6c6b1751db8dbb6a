"""Secret scan: three exact rules, and character Markov models for what the rules don't name.

Two first-order models over a small character alphabet, one of random strings and one of ordinary identifiers and words, are
trained from labelled samples. A run of token characters becomes a span where the log-likelihood ratio of the two models, in
total and for each character, is high enough and it mixes kinds of characters. Spans of the rules always stay; the model only
adds spans that don't overlap them.

Defined results: a null text counts as empty and has no spans; positions are code points, ends exclusive; every row gives one
row, equal rows too; whole texts are read however long; an empty table gives no rows and then the model is trained from the
synthetic samples alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_type, sampled, texts_in

# The three base rules, by kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters of the models, each its own state, then one state for all others.
ALPHABET = string.ascii_letters + string.digits + "+/_=-."
#: Words that ordinary identifiers in code are made of, as labelled samples beside those of the corpus.
PARTS = "get set user name list item count index value node file path data load save test config server client request response handler manager service table column row key map size time date start end first last next max min sum total error message default option parent child event type class method string number array object buffer stream reader writer factory builder context session cache query result filter order group".split()
#: At most so many documents of the corpus, none of more characters than this, serve as samples of ordinary text.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 1000, 20_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of what the rules find, leftmost and without overlap for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]  # runs are maximal, so short ones need not be matched first
    return sorted(out)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@dataclass(frozen=True)
class MarkovPair:
    """ratio[a, b]: log-likelihood ratio of random strings to ordinary ones for character b after a; the last row is the start."""

    ratio: np.ndarray

    @classmethod
    def trained(cls, secrets: list[str], ordinary: list[str]) -> MarkovPair:
        def model(samples: list[str]) -> np.ndarray:
            n = len(ALPHABET) + 1
            counts = np.full((n + 1, n), 0.5)
            for s in samples:
                x = codes(s)
                np.add.at(counts, (np.r_[n, x[:-1]], x), 1)
            return np.log(counts / counts.sum(axis=1, keepdims=True))

        return cls(model(secrets) - model(ordinary))

    def score(self, s: str) -> float:
        x = codes(s)
        return float(self.ratio[np.r_[len(ALPHABET) + 1, x[:-1]], x].sum()) if len(x) else 0.0


_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))


def codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]


def random_strings(n: int, seed: int = 11) -> list[str]:
    """Labelled samples of secrets: keys in the usual encodings."""
    rng = random.Random(seed)
    sets = ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-")
    return ["".join(rng.choices(rng.choice(sets), k=rng.randint(16, 48))) for _ in range(n)]


def identifiers(n: int, seed: int = 12) -> list[str]:
    """Labelled samples of ordinary identifiers: words joined as in code, paths and versions."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = rng.choices(PARTS, k=rng.randint(2, 6))
        joined = rng.choice(("_".join(words), "-".join(words), "/".join(words), "".join(w.title() for w in words), "_".join(words).upper(), "".join(words)))
        out.append(joined + rng.choice(("", "", str(rng.randint(0, 99)), f"_{rng.randint(1990, 2030)}", f"-{rng.randint(0, 9)}.{rng.randint(0, 9)}")))
    return out


def fitted(docs: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE_DOCUMENTS) -> MarkovPair:
    """Trained from synthetic samples, and from at most `sample` documents: what the rules match there is labelled secret, all other words ordinary."""
    rows = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("i")).filter(F.col("t").isNotNull())
    rows = sampled(rows, [F.col("i"), F.col("t")], sample).filter(F.length("t") <= SAMPLE_CHARS).select("t").collect()
    secrets, ordinary = random_strings(4000), identifiers(4000)
    for (text,) in rows:
        rest = list(text)
        for a, _, b in base_spans(text):
            secrets.append(re.split(r"[:=\"' ]+", text[a:b])[-1])
            rest[a:b] = " " * (b - a)
        ordinary += re.findall(r"[A-Za-z0-9+/_=.-]+", "".join(rest))
    return MarkovPair.trained(secrets, ordinary)


def model_spans(text: str, model: MarkovPair, taken: list[tuple[int, int, int]], least: float = 12.0, each: float = 0.5) -> list[tuple[int, int, int]]:
    out, held, at = [], [], 0
    for x, _, y in taken:  # base spans in order, joined where they overlap
        if held and x <= held[-1][1]:
            held[-1][1] = max(held[-1][1], y)
        else:
            held.append([x, y])
    for m in RUN.finditer(text):
        a, b, s = m.start(), m.end(), m[0]
        mixed = any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)
        while at < len(held) and held[at][1] <= a:
            at += 1
        if mixed < 2 or (at < len(held) and held[at][0] < b):
            continue
        llr = model.score(s)
        if llr >= least and llr >= each * len(s):
            out.append((a, 3, b))
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: MarkovPair | None = None) -> DataFrame:
    """A row for each document: its id, base and all spans as arrays of (kind, start, end), and their digests. Nothing is shuffled."""
    model = model or fitted(docs, id_col, text_col)
    kind, id_type = docs.schema[id_col].dataType.simpleString(), arrow_type(docs, id_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in texts_in(batches, ["__id", "__text"]):
            base = [base_spans(t or "") for t in texts]
            more = [sorted(b + model_spans(t or "", model, b)) for t, b in zip(texts, base, strict=True)]
            named = [[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in m] for m in more]
            n = [[sum(k == i for _, k, _ in m) for m in more] for i in range(4)]
            cols = [pa.array(ids), *(pa.array(x, pa.int64()) for x in n), pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b in base], pa.string()), pa.array([digest(m) for m in more], pa.string()), pa.array(named, span)]
            yield pa.RecordBatch.from_arrays([cols[0].cast(id_type), *cols[1:]], [id_col, "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans", "found"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>")
