"""Block codec for token ids: an adaptive context-mixing range coder.

A block is split into lanes of equal length that are coded side by side, in chunks of steps. What is known of the ids of earlier
chunks predicts the next chunk's; all models start anew in each block. Order 0 gives every id a share by the number of ids it
followed. Order 1 gives those that followed the last id their discounted counts, and the discounts as weight to order 0; both are
summed, id by id, into one distribution. Order 2 names the id that followed the last two most often; its share mixes how sure
order 2 is and how likely the lower orders find that id, by counts learned for each pair of both. A flag by that share says
whether it is the id; if not, the id is coded by the sum of orders 1 and 0 without it. A carryless 64-bit range coder in each
lane turns shares into 16-bit words.

Places in the sum of both orders lie in one array over all contexts. The encoder numbers all pairs of its block once, so that an id's
place is a look-up; the decoder finds it by a guide, which has as many ranges for a context as the context has places.

A block: magic, header (counts, lengths, checksums), the documents' ids and lengths, the lanes' word counts, the words. Blocks
can be decoded alone, and a file is blocks one after the other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAGIC = b"GLCM"
HEAD = struct.Struct("<4sHHIIIIIIII")
VERSION = 3
MAX_LANES, LEAST_STEPS = 8192, 128
#: Bits of the flag's share, of the sum of orders 0 and 1, of order 0's shares in it, and of the table of order 2.
FLAG_BITS, SUM_BITS, SHARE_BITS, TABLE_BITS = 16, 30, 19, 19
#: Levels of how likely the lower orders find a guess, and bits of a state, which pairs that with how sure order 2 is.
LEVELS, STATE_BITS = 23, 10
TOP, LOW = np.uint64(1 << 48), np.uint64((1 << 48) - 1)
ONE, U16, U32, U48 = (np.uint64(x) for x in (1, 16, 32, 48))
#: Steps that are prepared at once.
AT_ONCE = 4


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[at], np.diff(np.r_[at, len(keys)])


class Model:
    """What both sides know of the ids of the chunks so far."""

    def __init__(self, vocab: int, guided: bool = False):
        """guided: whether ids are to be found by their places."""
        self.guided = guided
        self.vocab, self.bits, self.share_bits = vocab, max(1, (vocab - 1).bit_length()), max(SHARE_BITS, vocab.bit_length() + 3)
        self.weight_bits = SUM_BITS - self.share_bits
        #: ids and pairs of ids, and tables, in the narrowest type
        self.kind, self.pair_kind = (np.int32, np.uint32) if vocab < 1 << 16 else (np.int64, np.uint64)
        self.tried, self.right = np.full(1 << STATE_BITS, 1.0), np.full(1 << STATE_BITS, 0.5)
        none = np.zeros(0, np.int64)
        self.learn(none, none, none, none, none)

    def learn(self, ids: np.ndarray, last: np.ndarray, before: np.ndarray, states: np.ndarray, hits: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """All ids so far with the one and the two before; states and hits: those of the last chunk that had a guess; known: the
        distinct pairs of the last id and the id in order, and how often each occurs, where that was counted."""
        bits, vocab, one, kind = self.bits, self.vocab, 1 << self.share_bits, self.kind
        ids, last, before = (x.astype(np.int64) for x in (ids, last, before))
        pairs, n = known or counted((last << bits | ids).astype(self.pair_kind))
        keys, pairs = pairs, pairs.astype(np.int64)
        of, x = pairs >> bits, pairs & ((1 << bits) - 1)
        # order 0: by the number of ids that each followed
        share = np.bincount(x, minlength=vocab) * (one - vocab) // max(1, len(pairs)) + 1
        share[int(share.argmax())] += one - int(share.sum())
        below = np.r_[0, np.cumsum(share)]
        self.below, self.which = below.astype(kind), np.repeat(np.arange(vocab, dtype=kind), share)
        # order 1: counts less a half, and order 0 by the weight of what was taken away
        kinds, all_ = np.bincount(of, minlength=vocab), np.bincount(of, n, vocab).astype(np.int64)
        most = 1 << self.weight_bits
        weight0 = np.where(all_ > 0, np.clip(kinds * most // np.maximum(1, 2 * all_), 1, most - 1), most)
        self.weight0 = weight0
        part = 2 * n - 1
        sums, heads = np.cumsum(part), np.cumsum(kinds) - kinds
        sums -= np.r_[0, sums][heads[of]]
        total, weight0 = (2 * all_ - kinds)[of], weight0[of]
        weight1 = most - weight0
        low = weight1 * (((sums - part) << self.share_bits) // total) + weight0 * below[x]
        end = weight1 * ((sums << self.share_bits) // total) + weight0 * below[x + 1]
        # places of all contexts in one array, each with its bounds, its id, and what order 0 has up to it; a context begins with a place of no id
        at = np.arange(len(pairs)) + of + 1
        self.entry = np.zeros((len(pairs) + vocab, 4), kind)
        for column, values in enumerate((low, end, x, below[x + 1])):
            self.entry[at, column] = values
        if self.guided:  # ranges of a context: a power of two, no fewer than its places; up to each, how many places there are
            fine = np.frexp(kinds.astype(np.float64))[1]
            self.coarse, ranges = SUM_BITS - fine, np.int64(1) << fine
            self.ranges = np.cumsum(ranges) - ranges
            there = np.bincount(self.ranges[of] + (low >> self.coarse[of]), minlength=int(ranges.sum()))
            there[self.ranges] += 1
            self.guide, self.begins = np.r_[0, np.cumsum(there)].astype(kind) - 1, self.entry.ravel()
        # order 2: the most frequent follower of each pair of ids, in a table by hash of the pair
        triples, n = counted((last << 2 * bits) | (before << bits) | ids)
        context = triples >> bits
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][: len(context)])
        context = context[first]
        best = np.maximum.reduceat(n << bits | (triples & ((1 << bits) - 1)), first) if len(first) else first
        seen, best, guess = (np.add.reduceat(n, first) if len(first) else first), best >> bits, best & ((1 << bits) - 1)
        sure = (best * 8 - 1) // np.maximum(seen, 1) * 4 + (best > 1) + (best > 2) + (best > 5)
        where = np.searchsorted(keys, ((context >> bits) << bits | guess).astype(self.pair_kind))
        level = np.clip(np.frexp((end - low).astype(np.float64))[1] - SUM_BITS + LEVELS - 1, 0, LEVELS - 1)[where]  # by powers of two
        rows = np.stack([context.astype(kind), (guess << STATE_BITS | (sure * LEVELS + level)).astype(kind), low[where].astype(kind), end[where].astype(kind)], axis=1)
        self.table = np.full((1 << TABLE_BITS, 4), -1, kind)
        slot = self.slot(rows[:, 0])
        for some in (seen == 1, seen > 1):  # what was seen again stays in its slot
            self.table[slot[some]] = rows[some]
        self.tried += np.bincount(states, minlength=len(self.tried))
        self.right += np.bincount(states[hits], minlength=len(self.right))
        flag = 1 << FLAG_BITS
        self.flag = np.clip((self.right / self.tried * flag).astype(np.int64), 16, flag - 16)

    @staticmethod
    def slot(context: np.ndarray) -> np.ndarray:
        return (context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).view(np.int64)

    def found(self, context: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The last place of each context that is no greater than the value, by number."""
        i = self.ranges.take(context) + (value >> self.coarse.take(context))
        low, high = self.guide.take(i), self.guide.take(i + 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            a, b = low[open_], high[open_]
            middle = (a + b + 1) >> 1
            fits = self.begins.take(middle * 4) <= value[open_]
            low[open_], high[open_] = np.where(fits, middle, a), np.where(fits, b, middle - 1)
            open_ = open_[low[open_] < high[open_]]
        return low

    def guessed(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Whether there is a guess, the flag's share (0 without one), the guessed id, its bounds, and the state."""
        context = last << self.bits | before
        row = self.table.take(self.slot(context), axis=0)
        any_ = (row[:, 0] == context) & (row[:, 1] >= 0)
        state = row[:, 1] & ((1 << STATE_BITS) - 1)
        return any_, self.flag.take(state) * any_, row[:, 1] >> STATE_BITS, row[:, 2], row[:, 3], state


def numbered(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in order, and the number of each pair among them."""
    if pairs.itemsize > 4 or len(pairs) > 1 << 32:
        return np.unique(pairs, return_inverse=True)
    both = np.sort(pairs.astype(np.uint64) << U32 | np.arange(len(pairs), dtype=np.uint64))
    at, keys = (both & np.uint64((1 << 32) - 1)).view(np.int64), (both >> U32).astype(pairs.dtype)
    new = np.r_[True, keys[1:] != keys[:-1]]
    out = np.empty(len(pairs), np.int32 if len(pairs) < 1 << 31 else np.int64)
    out[at] = np.cumsum(new) - 1
    return keys[new], out


def chunks(steps: int) -> Iterator[tuple[int, int]]:
    """Chunks of steps, each about as long as all before it; in long blocks the last two thirds are one."""
    cuts, at = [steps], steps // (3 if steps >= 256 else 2)
    while at:
        cuts.append(at)
        at //= 2
    at = 0
    for to in reversed(cuts if steps else []):
        yield at, to
        at = to


def shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(MAX_LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


def narrowed(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lanes whose range fell below 2**48: the larger part of it that crosses no multiple of 2**48."""
    room = TOP - (low & LOW)
    over = room < size
    upper = over & (size - room > room)
    return np.where(upper, low + room, low), np.where(upper, size - room, np.where(over, room, size))


def encoded(ids: np.ndarray, vocab: int) -> tuple[bytes, int]:
    """Payload and number of lanes."""
    n = len(ids)
    if n == 0:
        return b"", 0
    lanes, steps = shape(n)
    model = Model(vocab)
    grid = np.zeros(lanes * steps, model.kind)
    grid[:n] = ids
    past = np.vstack([np.zeros((2, lanes), model.kind), grid.reshape(lanes, steps).T])  # a row for each step
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    cap = 64
    words, used = np.zeros((cap, lanes), np.uint16), np.zeros(lanes, np.int64)
    whole, flag = 1 << SUM_BITS, 1 << FLAG_BITS
    pairs, number = numbered((past[1 : steps + 1].astype(model.pair_kind) << model.pair_kind(model.bits) | past[2:].astype(model.pair_kind)).ravel())
    seen = np.zeros(len(pairs), np.int64)
    place = np.zeros(len(pairs), np.int32 if len(pairs) < 1 << 30 else np.int64)  # twice the number of pairs before that were seen, and whether this one was

    def renew() -> None:
        nonlocal words, cap
        need = np.flatnonzero(size < TOP)
        while len(need):
            if int(used.max()) + 4 > cap:
                words, cap = np.vstack([words, np.zeros((cap, lanes), np.uint16)]), cap * 2
            lo, rg = narrowed(low[need], size[need])
            words[used[need], need] = lo >> U48
            used[need] += 1
            low[need], size[need] = (lo & LOW) << U16, rg << U16
            need = need[size[need] < TOP]

    for a, b in chunks(steps):
        states, hits = [], []
        for c in range(a, b, AT_ONCE):  # so many steps at once that the arrays stay in a core's cache
            d = min(b, c + AT_ONCE)
            x, last, before = past[c + 2 : d + 2].ravel(), past[c + 1 : d + 1].ravel(), past[c:d].ravel()
            any_, share, guess, g_low, g_end, state = model.guessed(last, before)
            hit = any_ & (guess == x)
            states.append(state[any_])
            hits.append(hit[any_])
            i = place.take(number[c * lanes : d * lanes])
            own = (i & 1).astype(bool)
            row = model.entry.take((i >> 1) + last + own, axis=0)
            s, width = row[:, 0].astype(np.int64), (row[:, 1] - row[:, 0]).astype(np.int64)
            new = np.flatnonzero(~own)  # ids that never followed the last one lie between two places
            y, rest = x[new], model.weight0[last[new]]
            s[new] = row[new, 1] + rest * (model.below[y] - row[new, 3])
            width[new] = rest * (model.below[y + 1] - model.below[y])
            held = (g_end - g_low) * any_  # what the guess held is left out if it was wrong
            s -= held * (s >= g_end)
            cols = (np.where(hit, 0, share), np.where(hit, share, flag - share), np.where(hit, 0, s), np.where(hit, 1, width), np.where(hit, 1, whole - held.astype(np.int64)))
            f_low, f_size, s_low, s_size, s_all = (z.view(np.uint64).reshape(d - c, lanes) for z in cols)
            for t in range(d - c):
                r = size >> U16
                low += f_low[t] * r
                r = f_size[t] * r // s_all[t]
                low += s_low[t] * r
                size = s_size[t] * r
                renew()
        if b < steps:
            seen += np.bincount(number[a * lanes : b * lanes], minlength=len(seen))
            there = seen > 0
            place[:] = 2 * (np.cumsum(there) - there) + there
            model.learn(past[2 : b + 2].ravel(), past[1 : b + 1].ravel(), past[:b].ravel(), np.concatenate(states), np.concatenate(hits), (pairs[there], seen[there]))
    if int(used.max()) + 2 > cap:
        words = np.vstack([words, np.zeros((2, lanes), np.uint16)])
    low = (low + np.uint64((1 << 32) - 1)) >> U32  # two words that lie in the range, whatever follows
    for shift in (16, 0):
        words[used, np.arange(lanes)] = (low >> np.uint64(shift)) & np.uint64(0xFFFF)
        used += 1
    flat = words.T[np.arange(len(words))[None, :] < used[:, None]]
    return zlib.compress(used.astype("<u4").tobytes(), 1) + flat.astype("<u2").tobytes(), lanes


def decoded(payload: bytes, n: int, lanes: int, vocab: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.int64)
    inflate = zlib.decompressobj()
    used = np.frombuffer(inflate.decompress(payload), "<u4").astype(np.int64)
    data = np.concatenate([np.frombuffer(inflate.unused_data, "<u2"), np.zeros(4, np.uint16)]).astype(np.uint64)
    at = np.cumsum(used) - used
    steps = -(-n // lanes)
    code = (data[at] << U48) | (data[at + 1] << U32) | (data[at + 2] << U16) | data[np.minimum(at + 3, len(data) - 1)]
    at = at + 4
    model = Model(vocab, guided=True)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    past = np.zeros((steps + 2, lanes), model.kind)
    whole, flag = 1 << SUM_BITS, 1 << FLAG_BITS

    def renew() -> None:
        need = np.flatnonzero(size < TOP)
        while len(need):
            lo, rg = narrowed(low[need], size[need])
            low[need], size[need] = (lo & LOW) << U16, rg << U16
            code[need] = ((code[need] & LOW) << U16) | data[np.minimum(at[need], len(data) - 1)]
            at[need] += 1
            need = need[size[need] < TOP]

    for a, b in chunks(steps):
        states, hits = [], []
        for t in range(a, b):
            last = past[t + 1]
            any_, share, x, g_low, g_end, state = model.guessed(last, past[t])
            r = size >> U16
            edge = share.view(np.uint64) * r
            hit = code - low < edge
            states.append(state[any_])
            hits.append(hit[any_])
            m = np.flatnonzero(~hit)
            if len(m):
                c, g, held = last[m].astype(np.int64), g_low[m], ((g_end - g_low) * any_)[m].astype(np.int64)
                total, from_ = (whole - held).view(np.uint64), low[m] + edge[m]
                r = (flag - share[m]).view(np.uint64) * r[m] // total
                v = np.minimum((code[m] - from_) // r, total - ONE).view(np.int64)
                skip = held * (v >= g)
                v += skip
                row = model.entry.take(model.found(last[m], v), axis=0)
                y, s, width = row[:, 2], row[:, 0].astype(np.int64), (row[:, 1] - row[:, 0]).astype(np.int64)
                new = np.flatnonzero(v >= row[:, 1])  # between two places
                rest, end, next_ = model.weight0[c[new]], row[new, 1], row[new, 3]
                z = model.which[(v[new] - end) // rest + next_]
                y[new], s[new], width[new] = z, end + rest * (model.below[z] - next_), rest * (model.below[z + 1] - model.below[z])
                low[m] = from_ + (s - skip).view(np.uint64) * r
                edge[m] = width.view(np.uint64) * r
                x[m] = y
            size = edge
            renew()
            past[t + 2] = x
        if b < steps:
            model.learn(past[2 : b + 2].ravel(), past[1 : b + 1].ravel(), past[:b].ravel(), np.concatenate(states), np.concatenate(hits))
    return np.ascontiguousarray(past[2:].T).ravel()[:n].astype(np.int64)


@dataclass(frozen=True)
class Block:
    """Documents in order: their ids (None allowed), and the token ids of each."""

    doc_ids: list
    lengths: np.ndarray
    ids: np.ndarray


def pack(block: Block, vocab: int) -> bytes:
    payload, lanes = encoded(block.ids, vocab)
    names = [0 if d is None else d for d in block.doc_ids]
    index = zlib.compress(np.array(names, "<i8").tobytes() + np.array([d is None for d in block.doc_ids], np.uint8).tobytes() + block.lengths.astype("<u4").tobytes(), 6)
    head = HEAD.pack(MAGIC, VERSION, lanes, len(names), len(block.ids), vocab, len(index), len(payload), zlib.crc32(index), zlib.crc32(payload), zlib.crc32(block.ids.astype("<u4").tobytes()))
    return head + index + payload


def unpack(data: bytes, at: int = 0) -> tuple[Block, int]:
    """The block that starts at a place in data, and where the next one starts. Damage raises ValueError."""
    magic, version, lanes, docs, n, vocab, index_len, payload_len, index_crc, payload_crc, crc = HEAD.unpack_from(data, at)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of token ids")
    start = at + HEAD.size
    index, payload = data[start : start + index_len], data[start + index_len : start + index_len + payload_len]
    if zlib.crc32(index) != index_crc or zlib.crc32(payload) != payload_crc:
        raise ValueError("a block's checksum differs")
    raw = zlib.decompress(index)
    names, null, lengths = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, np.uint8, docs, 8 * docs), np.frombuffer(raw, "<u4", docs, 9 * docs)
    ids = decoded(payload, n, lanes, vocab)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's ids differ from their checksum")
    return Block([None if z else int(d) for d, z in zip(names, null, strict=True)], lengths.astype(np.int64), ids), start + index_len + payload_len
