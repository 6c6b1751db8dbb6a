"""Words of many texts at once, as numbers: hashed from the UTF-8 bytes of Arrow arrays, without a Python object for each word.

A word is a run of ASCII letters, digits, underscores or characters outside ASCII, in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(3)
_FACTORS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), ord("_"), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Words:
    """hashes of all texts' words one after the other; text i has those from first[i] to first[i + 1]."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def span(self, i: int, a: int, b: int) -> tuple[int, int]:
        """Start and end in code points of the words from a to before b of text i."""
        own = self.data[self.offsets[i] : self.offsets[i + 1]]
        leads = (own & 0xC0) != 0x80
        at, to = self.starts[self.first[i] + a] - self.offsets[i], self.ends[self.first[i] + max(a, b - 1)] - self.offsets[i]
        return int(leads[:at].sum()), int(leads[:to].sum())


def hashed(texts: pa.Array) -> Words:
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    offsets = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, low.offset * 4).astype(np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]  # a text's first word isn't the rest of the text before
    at = np.flatnonzero(inside)
    heads = np.flatnonzero(begins[at])
    starts = at[heads]
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(low) + 1, np.int64), starts, starts, data, offsets)
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    values = (data[at].astype(np.uint64) + np.uint64(1)) * (_FACTORS[place & 63] + (place >> 6).astype(np.uint64))
    hashes = mixed(np.add.reduceat(values, heads))
    return Words(np.where(hashes == 0, np.uint64(1), hashes), np.searchsorted(starts, offsets), starts, starts + lengths, data, offsets)
