"""Token-ID output: documents as token ids in ascending id order, in blocks of the context-mixing range coder, and back.

Texts are dealt out by range of the id and sorted, tokenized and coded in one pass; each partition writes its blocks. A block holds
whole documents, is coded anew and carries its checksums. Spark's writer commits the blocks (one binary value each), so that a
lost executor or a repeated task leaves no damage, on any file system that Spark writes; `export` joins them to one plain file.

Defined results: a null text counts as empty and yields the end id alone; null ids come first; documents of one id come in the
order of their texts' hashes; a text longer than a block makes a longer block; an empty table gives no block; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import codec
from graphloom.llm.common import join_counted, staged_path, texts_in

BLOCK_TOKENS = 1 << 21
END_ID = 0


class Known(dict):
    """Numbers of words; a word that isn't known yet gets the next one, and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        self.new.append(word)
        return out


class Merges:
    """Byte-pair merges of many pieces at once. In each round every piece merges all places of its pair of lowest rank, from the left;
    that is the order of one merge after the other, as each merge's parts are made by earlier merges (`merges_of` sees to it).

    A symbol is the rank of the pair that it begins, and its id; a piece ends with a symbol of no id, which begins no pair."""

    NO_ID, LATE, END = np.uint32(0xFFFF), np.uint32(0xFFFF), np.uint32(0xFFFFFFFF)
    #: Bytes from here on begin characters of which the regular expression may think otherwise than Python.
    FOREIGN = 0xC9

    def __init__(self, first: np.ndarray, pairs: np.ndarray, made: np.ndarray):
        """first: the id of each byte; pairs (left << 16 | right) and the ids they make, by rank. Ids and ranks are below 65,534."""
        self.first, self.made, self.tables = first.astype(np.uint32), made.astype(np.uint32), []
        self.first[10] = self.NO_ID
        left, bits = np.arange(len(pairs)), max(4, (4 * len(pairs)).bit_length())
        while len(left):  # what loses its slot goes to the next table
            turn = np.uint32(0x9E3779B1 + 2 * 0x3C6EF372 * len(self.tables) & 0xFFFFFFFF)
            slot = pairs[left] * turn >> np.uint32(32 - bits)
            table = np.full(1 << bits, self.END, np.uint64)
            table[slot] = pairs[left].astype(np.uint64) << np.uint64(32) | left.astype(np.uint64)
            self.tables.append((table, turn, np.uint32(32 - bits)))
            left, bits = left[table[slot] & np.uint64(0xFFFFFFFF) != left.astype(np.uint64)], max(4, bits - 2)

    def symbols(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbols of ids a that ids b follow."""
        key = a << np.uint32(16) | b
        rank = np.full(len(key), self.LATE)
        for table, turn, shift in self.tables:
            row = table.take(key * turn >> shift)
            np.copyto(rank, row.astype(np.uint32), where=(row >> np.uint64(32)).astype(np.uint32) == key)
        return rank << np.uint32(16) | a

    def __call__(self, pieces: list[str], at_once: int = 16384) -> list[bytes | None]:
        """Ids of each piece as 16-bit numbers; None for those with foreign characters. No piece is empty or holds a line's end."""
        out: list[bytes | None] = []
        for i in range(0, len(pieces), at_once):
            some = pieces[i : i + at_once]
            out += self.merged("\n".join(["", *some, ""]).encode("utf-8", "surrogatepass"), len(some))
        return out

    def merged(self, lines: bytes, n: int) -> list[bytes | None]:
        raw = np.frombuffer(lines, np.uint8)
        token = self.first.take(raw)
        x = np.append(self.symbols(token[:-1], token[1:]), self.END)  # an end's symbol: late, and no id
        out: list[bytes | None] = [None] * n
        who = np.arange(n)
        while True:
            ends = np.flatnonzero(x == self.END)
            heads, length = ends[:-1] + 1, np.diff(ends)
            best = np.minimum.reduceat(x, heads) >> np.uint32(16)
            open_ = best < self.LATE
            left = int(np.count_nonzero(open_))
            if 4 * left <= 3 * len(open_):  # finished pieces leave
                stay = np.repeat(open_, length)
                flat = (x[1:][~stay] & self.NO_ID).astype(np.uint16).tobytes()
                to = (2 * np.cumsum(length[~open_])).tolist()
                for i, a, b in zip(who[~open_].tolist(), [0, *to], to, strict=False):
                    out[i] = flat[a : b - 2]
                if not left:
                    break
                x, who, best, length = np.append(self.END, x[1:][stay]), who[open_], best[open_], length[open_]
            best[best == self.LATE] = self.LATE - 1
            hit = np.flatnonzero(x[1:] >> np.uint32(16) == np.repeat(best, length)) + 1
            follows = hit[1:] - hit[:-1] == 1
            if follows.any():  # of places that overlap every other one, from the left
                follows = np.r_[False, follows]
                run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            x[hit] = self.made.take(x[hit] >> np.uint32(16))
            keep = np.ones(len(x), bool)
            keep[hit + 1] = False
            x = x[keep]
            hit -= np.arange(len(hit))
            token = x[hit]
            before, after = x[hit - 1] & self.NO_ID, x[hit + 1] & self.NO_ID
            x[hit] = self.symbols(token, after)
            some = before != self.NO_ID
            hit, before, token = hit[some] - 1, before[some], token[some]
            x[hit] = self.symbols(before, token)
        if raw.max(initial=0) >= self.FOREIGN:
            for i in np.unique(np.searchsorted(np.flatnonzero(raw == 10), np.flatnonzero(raw >= self.FOREIGN)) - 1).tolist():
                out[i] = None
        return out


def merges_of(config: str) -> Merges | None:
    """The merges of a tokenizer, if it is one whose pieces of letters they alone decide."""
    made = json.loads(config)
    model, vocab = made["model"], made["model"].get("vocab")
    split = {k: v for k, v in (made.get("pre_tokenizer") or {}).items() if k in ("type", "add_prefix_space", "use_regex")}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or made.get("normalizer") or split != {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or max([*vocab.values(), len(model["merges"])]) >= Merges.LATE - 1:
        return None
    if any(all(c.isalpha() or c == " " for c in t["content"]) for t in made.get("added_tokens", [])):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}  # how byte-level tokenizers write bytes
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if not pairs or len(set(pairs)) < len(pairs) or any(c not in vocab for c in letter.values()) or any(x not in vocab for a, b in pairs for x in (a, b, a + b)):
        return None
    rank: dict[str, int] = {}
    for i, (a, b) in enumerate(pairs):
        rank[a + b] = i  # the latest merge that makes it
    if any(rank.get(a, -1) >= i or rank.get(b, -1) >= i for i, (a, b) in enumerate(pairs)):
        return None
    return Merges(np.array([vocab[letter[b]] for b in range(256)]), np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32), np.array([vocab[a + b] for a, b in pairs]))


class Words:
    """Ids of texts. A space between two characters that aren't white space always starts a new piece of the byte-level
    pre-tokenizer, and a line's end between two such characters is a piece, so that what lies between can be encoded alone, once
    each; texts where white space lies otherwise are encoded whole."""

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.vocab = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        begins = [i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]  # how this pre-tokenizer writes a space
        self.spaced = np.zeros(self.vocab, bool)
        self.spaced[begins] = True
        self.splits, self.merges = self.safe(), merges_of(self.tokenizer.to_str())
        self.forget()

    def forget(self) -> None:
        """Words by number: their ids lie in one array, from starts on, sizes of them."""
        self.known, self.ends = Known(), {"": b""}
        self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, self.kind), 0

    def safe(self) -> bool:
        """Whether this tokenizer treats white space in that way, tried on a sample."""
        a, b, c = "one two,three", "five!", "six 7."
        whole = self.tokenizer.encode(f"{a} {b}\n{c}", add_special_tokens=False).ids
        return whole == [i for t in (a, f" {b}", "\n", c) for i in self.tokenizer.encode(t, add_special_tokens=False).ids]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, words: list[str]) -> list[bytes]:
        """Each word's ids with the space before it: encoded together, and told apart by the ids that begin with a space."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join([f" {w}" for w in words])], add_special_tokens=False)[0].ids, self.kind)
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(words) or (len(at) and at[0]):
            return self.encode([f" {w}" for w in words])
        raw, step = ids.tobytes(), ids.itemsize
        ends = [*(at[1:] * step).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip((at * step).tolist(), ends, strict=True)]

    def parts(self, word: str) -> tuple[str, str]:
        """The word without punctuation at its end, which is a piece of its own after a letter, and that end."""
        out = word.rstrip(",.!")
        return (out, word[len(out) :]) if out and out[-1].isalpha() else (word, "")

    def learn(self, words: list[str]) -> None:
        """Ids of new words, in the order of their numbers: each is made of stems, ends, and line's ends between them. Words whose stems
        are letters are merged all at once."""
        first, made, left = len(self.known) - len(words), [b""] * len(words), range(len(words))
        if self.merges:
            stems, tails, at, lines, left, marks = [], [], [], [], [], string.punctuation
            for i, w in enumerate(words):
                if w.isalpha():
                    stems.append(w), tails.append(""), at.append(i)
                elif "\n" not in w:
                    s = w.rstrip(marks)
                    if s.isalpha():
                        stems.append(s), tails.append(w[len(s) :]), at.append(i)
                    else:
                        left.append(i)
                else:
                    parts = [self.parts(x) for x in w.split("\n")]
                    if all([x.isalpha() for x, _ in parts]):
                        lines.append((i, parts))
                    else:
                        left.append(i)
            inner = [x for _, parts in lines for x, _ in parts[1:]]  # a line's first word has no space before it
            spaced = [f" {x}" for x in stems] + [f" {parts[0][0]}" for _, parts in lines]
            ids = self.merges(spaced + inner)
            self.ends_of(["\n", *tails, *(y for _, parts in lines for _, y in parts)])
            ends = self.ends
            for i, x, y in zip(at, ids, tails, strict=False):
                if x is None:
                    left.append(i)
                else:
                    made[i] = x + ends[y]
            head, rest, newline = iter(ids[len(stems) : len(spaced)]), iter(ids[len(spaced) :]), ends["\n"]
            for i, parts in lines:
                got = [next(head), *(next(rest) for _ in parts[1:])]
                if None in got:
                    left.append(i)
                else:
                    made[i] = newline.join([x + ends[y] for x, (_, y) in zip(got, parts, strict=True)])
        if left:
            left = sorted(left)
            for i, x in zip(left, self.looked_up([words[i] for i in left]), strict=True):
                made[i] = x
        flat = np.frombuffer(b"".join(made), self.kind)
        sizes = np.fromiter(map(len, made), np.int32, len(made)) // flat.itemsize
        while len(self.known) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[first : len(self.known)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : len(self.known)] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def ends_of(self, wanted: list[str]) -> None:
        """Notes the ids of ends and of first words of lines, which come again and again."""
        wanted = [x for x in set(wanted) if x not in self.ends]
        self.ends.update(zip(wanted, self.encode(wanted), strict=True))

    def looked_up(self, words: list[str]) -> list[bytes]:
        """Ids of words by the library, each of its stems once; none for words with other white space."""
        cut = [self.parts(w) if "\n" not in w else None for w in words]
        lines = {w: [self.parts(x) for x in w.split("\n")] for w, c in zip(words, cut, strict=True) if c is None}
        stems = {c[0] for c in cut if c} | {x[0][0] for x in lines.values()}
        odd = {x for x in stems if x.split() != [x]}
        new, ids = list(stems - odd), {}
        for i in range(0, len(new), 2000):
            ids.update(zip(new[i : i + 2000], self.encode_pieces(new[i : i + 2000]), strict=True))
        self.ends_of([*(c[1] for c in cut if c), *(x for parts in lines.values() for _, x in parts), *("\n" + x for parts in lines.values() for x, _ in parts[1:])])
        ends, out = self.ends, []
        for word, c in zip(words, cut, strict=True):
            if c:
                out.append(b"" if c[0] in odd else ids[c[0]] + ends[c[1]])
            else:
                parts = lines[word]
                bad = parts[0][0] in odd or any(x.split() != [x] for x, _ in parts[1:])
                out.append(b"" if bad else ids[parts[0][0]] + ends[parts[0][1]] + b"".join([ends["\n" + x] + ends[y] for x, y in parts[1:]]))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes of the kind."""
        if not self.splits or not texts:
            return self.encode(texts)
        if len(self.known) > self.most:
            self.forget()
        pieces = pc.split_pattern(pa.array(texts, pa.string()), " ")
        bounds, coded = np.asarray(pieces.offsets).astype(np.int64), pieces.flatten().dictionary_encode()
        count, of, first = np.diff(bounds) - 1, np.asarray(coded.indices), bounds[:-1]
        begins = coded.dictionary.take(pa.array(of[first])).to_pylist()
        of = np.delete(of, first)
        used = np.zeros(len(coded.dictionary), bool)  # each distinct word is looked up once
        used[of] = True
        known, at = self.known, np.flatnonzero(used)
        words = coded.dictionary.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.new:
            new, known.new = known.new, []
            self.learn(new)
        # texts with other white space than single spaces and line's ends between other characters are encoded whole
        plain = [x != "" and not x[-1].isspace() for x in begins]
        sizes, starts = np.zeros(len(used), np.int32), np.zeros(len(used), np.int32)
        sizes[at], starts[at] = self.sizes.take(number), self.starts.take(number)
        size, start = sizes.take(of), starts.take(of)
        none = np.flatnonzero(size == 0)
        for i in np.unique(np.searchsorted(np.cumsum(count), none, "right")).tolist():
            plain[i] = False
        ends = np.cumsum(size)
        ids = self.flat.take(np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)).tobytes()
        edges = (np.r_[0, ends][np.r_[0, np.cumsum(count, dtype=np.int64)]] * self.flat.itemsize).tolist()
        heads = self.encode([x if ok else t for t, ok, x in zip(texts, plain, begins, strict=True)])
        return [h + ids[a:b] if ok else h for h, ok, a, b in zip(heads, plain, edges, edges[1:], strict=False)]


@lru_cache(2)
def words_for(path: str) -> Words:
    """One for each Python worker, so that what is known of words lasts from task to task."""
    return Words(path)


def write(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the blocks of docs to path: rows (part, block, docs, tokens, data), parts and blocks in ascending order of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, number = words_for(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], words.kind).tobytes()
        names, lengths, held, size = [], [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal names, lengths, held, size, number
            ids = np.frombuffer(b"".join(held), words.kind).astype(np.int64)
            data = codec.pack(codec.Block(names, np.array(lengths, np.int64), ids), words.vocab)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "block", "docs", "tokens", "data"])
            names, lengths, held, size, number = [], [], [], 0, number + 1
            return out

        for ids, texts in texts_in(batches, ["__id", "__text"], rows=2048):
            for name, coded in zip(ids, words([t or "" for t in texts]), strict=True):
                held += (coded, end)
                names.append(name)
                lengths.append(len(coded) // len(end) + 1)
                size += lengths[-1]
                if size >= block_tokens:
                    yield packed()
        if names:
            yield packed()

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    rows = rows.repartitionByRange(F.col("__id").asc_nulls_first()).sortWithinPartitions(F.col("__id").asc_nulls_first(), F.xxhash64("__text"))
    rows.mapInArrow(run, "part int, block int, docs long, tokens long, data binary").write.option("compression", "none").option("parquet.block.size", 4 << 20).parquet(path)


def read_back(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row for each document in the blocks: id, start (tokens of all documents before it), n_tokens, ids_crc32, and ids if asked for."""
    blocks = spark.read.schema("part int, block int, docs long, tokens long, data binary").parquet(path)
    meta = blocks.select("part", "block", "tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = meta.groupBy("part").agg(F.sum("tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("o"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = meta.join(F.broadcast(parts), "part").select("part", "block", (F.col("o") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).alias("__start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, data in texts_in(batches, ["part", "block", "data"], rows=1):
            block, _ = codec.unpack(data[0])
            ends = np.cumsum(block.lengths)
            begins = ends - block.lengths
            raw = [block.ids[a:b].astype("<u4") for a, b in zip(begins, ends, strict=True)]
            n = len(raw)
            cols = [pa.array(part * n, pa.int32()), pa.array(number * n, pa.int32()), pa.array(block.doc_ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(block.lengths, pa.int64()), pa.array([zlib.crc32(r.tobytes()) for r in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array([r.tolist() for r in raw], pa.list_(pa.int64()))] if with_ids else []), ["part", "block", "__id", "__at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    rows = blocks.select("part", "block", "data").mapInArrow(run, "part int, block int, __id long, __at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    out = join_counted(rows, starts, ["part", "block"], "inner", blocks.count(), 32)
    return out.select(F.col("__id").alias(id_col), (F.col("__start") + F.col("__at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def export(spark: SparkSession, path: str, to: str) -> int:
    """Joins the blocks at path to one plain local file, one block at a time; returns its bytes."""
    n = 0
    with open(to, "wb") as f:
        for row in spark.read.parquet(path).orderBy("part", "block").select("data").toLocalIterator():
            n += f.write(row["data"])
    return n


def file_blocks(path: str) -> Iterator[codec.Block]:
    """The blocks of a plain file."""
    with open(path, "rb") as f:
        data = f.read()
    at = 0
    while at < len(data):
        block, at = codec.unpack(data, at)
        yield block


def round_trip(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs to the shared folder and reads what was written."""
    path = staged_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, id_col=id_col, text_col=text_col)
    return read_back(docs.sparkSession, path, id_col=id_col)
