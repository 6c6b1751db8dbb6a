"""Each operator against a brute-force version, exact round trips or held-out accuracy, and the edge cases of its docstring."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import codec, decontaminate, lines, mixing, neardup, neighbours, secrets, sharding, spans, tokens, toxicity
from graphloom.llm.words import hashed

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 61}." for i in range(30_000))
    rows = [(1, "one two three four five six", "en", "a", 5), (1, "one two three four five six", "en", "a", 5), (2, None, None, None, None), (None, "no id here at all", "en", "b", 1), (3, "", "en", "a", 0), (4, long, "en", "b", len(long)), (5, long, None, "b", None), (6, " \n\t ", "de", None, 4)]
    out = spark.createDataFrame(rows, SCHEMA)
    for c in ("size", "target", "bucket", "score", "shard", "n_removed", "ids", "key", "held_out"):
        out = out.withColumn(c, F.lit("clash"))
    return out


def collected(df):
    return [r.asDict() for r in df.collect()]


# mixing


def test_mix_meets_targets(docs):
    rows = collected(mixing.mix_table(docs))
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    level = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    left, open_, want = float(sum(sizes.values())), set(sizes), {}
    while open_:  # share by weight, stop at three times, share the excess again
        weight = sum(level[s] for s in open_)
        full = {s for s in open_ if left * level[s] / weight > 3 * sizes[s]}
        if not full:
            want |= {s: left * level[s] / weight for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    most = {s: max(r["size"] for r in rows if source[r["doc_id"]] == s) for s in sizes}
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= most[s]
    assert rows and sorted(map(str, rows)) == sorted(map(str, collected(mixing.mix_table(docs.repartition(5)))))


def test_mix_edges(spark, odd):
    rows = collected(mixing.mix_table(odd))
    assert len(rows) == 8 and {r["size"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0}
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns and got.count() == sum(r["copies"] for r in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_table(empty).count() == mixing.mixed_documents(empty).count() == 0


# secrets


def naive_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for i, (pattern, n) in enumerate((("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)), 1):
        found += [(m.start(), i, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= n]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_base_spans(docs, odd):
    for table in (docs, odd.select("doc_id", "text")):
        for r, t in zip(sorted(collected(secrets.scan(table)), key=str), sorted(collected(table.select("doc_id", "text")), key=str), strict=True):
            pass
        texts = {(r.doc_id, hashlib.sha256(naive_spans(r.text or "").encode()).hexdigest()) for r in table.select("doc_id", "text").collect()}
        assert {(r["doc_id"], r["base_sha256"]) for r in collected(secrets.scan(table))} == texts


def test_secret_overlaps_and_model(spark):
    text = "secret=token:abcdefg TOKEN = 'Zx81kQm2PqL0vT7yWb3n' key Xk29vLq0ZmP4tRw8YbN1cD7f plain getUserNameFromDatabase README_FILE_PATH_NAME"
    model = secrets.MarkovPair.trained(secrets.random_strings(2000), secrets.identifiers(2000))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in collected(secrets.scan(df, model=model))}
    found = [text[x["start"] : x["end"]] for x in rows[1]["found"] if x["kind"] == "markov"]
    assert found == ["Xk29vLq0ZmP4tRw8YbN1cD7f"] and rows[1]["n_assign"] == 1 and rows[2]["spans"] == ""
    held = [(s, 1) for s in secrets.random_strings(500, seed=99)] + [(s, 0) for s in secrets.identifiers(500, seed=98)]
    assert sum((model.score(s) > 0) == bool(y) for s, y in held) > 970


# near duplicates


def words(t):
    return hashed(pa.array([t], pa.string())).of(0)


def test_words_are_those_of_each_text():
    t = ["Ab cd, EF_9 é!x", "", None, "x"]
    w = hashed(pa.array(t, pa.string()))
    assert w.first.tolist() == [0, 5, 5, 5, 6]
    assert w.of(0)[4] == w.of(3)[0] and w.span(0, 1, 3) == (3, 11)
    assert (words("ab CD ef_9 é x") == w.of(0)).all()


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    e = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    a, b = rng.random(300) * 3 + 0.1, rng.random(300) * 3 + 0.1
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = np.mean([np.mean(neardup.darts(e, a, 128, s) == neardup.darts(e, b, 128, s)) for s in range(40)])
    assert got == pytest.approx(want, abs=0.03)
    many = neardup.thrown(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 128, 3)
    assert (many[0] == neardup.darts(e, a, 128, 3)).all() and (many[1] == neardup.darts(e, b, 128, 3)).all()


def brute_classes(rows):
    sets = {}
    for i, (k, t) in enumerate(rows):
        sets[i] = set(neardup.units(*neardup.weighted(words(t)))[0].tolist()) if t is not None else None
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a is not None and b is not None and (rows[i][1] == rows[j][1] or (a and b and len(a & b) >= 0.8 * len(a | b))):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return {k: min(g) for g in groups.values() for k in g}


def test_near_duplicates(spark, docs):
    rng = random.Random(3)
    base = [f"word{rng.randrange(3000)}" for _ in range(150)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for i in range(60):  # a large group of near copies of near copies
        base = base[:]
        base[rng.randrange(150)] = f"new{i}"
        rows.append((10_000 + i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in collected(neardup.classes(df))}
    assert got == brute_classes(sorted(rows))
    assert sorted(r.doc_id for r in neardup.without_duplicates(df).collect()) == sorted(set(got.values()))


def test_near_duplicates_of_one_template(spark):
    """Many texts just below and above the similarity, and blocks smaller than their buckets."""
    rng, rows = random.Random(11), []
    base = [f"t{i}" for i in range(120)]
    for k in range(500):
        own = rows[rng.randrange(len(rows))][1].split() if rows and rng.random() < 0.3 else base[:]
        for i in range(rng.choice((2, 3, 3, 4))):
            own[rng.randrange(120)] = f"n{k}x{i}"
        rows.append((k, " ".join(own)))
    want = brute_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in collected(neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert 50 < len(set(want.values())) < 480 and got == want


def test_links_of_blocks_join_what_all_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(12)
    own = [np.unique(rng.choice(40, 34, replace=False)).astype(np.int32) for _ in range(90)]
    members = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(own)], "__id long, __set array<int>")
    rows = spark.createDataFrame([(7, 90, i, i // 2) for i in range(90)], "__bucket long, __n long, __id long, __class long")

    def joined(links):
        label = [i // 2 for i in range(90)]
        for a, b in links:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    pairs = [(i, j) for i in range(90) for j in range(i) if len(np.intersect1d(own[i], own[j])) >= 0.8 * len(np.union1d(own[i], own[j]))]
    links = [(r["__id"], r["__leader"]) for r in neardup.block_links(rows, members, 0.8).collect()]
    assert set(links) <= set(pairs) | {(b, a) for a, b in pairs} and joined(links) == joined(pairs) and len(set(joined(pairs))) < 45


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "other words are here now", "z"), (3, "and two texts of one id", "z"), (None, "a b c d e f g", None), (4, None, None), (4, None, None)]
    got = collected(neardup.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert sorted((str(r["doc_id"]), r["source"]) for r in got) == [("1", "x"), ("3", "z"), ("4", None), ("None", None)]


def test_near_duplicate_edges(spark, odd):
    rows = collected(neardup.classes(odd))
    assert len(rows) == 8
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert got[5] == 4 and got[1] == 1 and got[2] == 2 and got[None] is None
    assert neardup.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    short = spark.createDataFrame([(1, "a b"), (2, "A, b"), (3, "a c"), (4, ""), (5, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in collected(neardup.classes(short))} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


# token ids


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_codec_round_trips():
    rng = np.random.default_rng(2)
    for ids in ([], [7], [50256] * 3, np.zeros(5000, int), rng.integers(0, 50257, 9000), np.tile(rng.integers(0, 50257, 40), 3000)):
        ids = np.asarray(ids, np.int64)
        data = codec.pack(codec.Block([None, 5], np.array([len(ids), 0]), ids), 50257)
        block, end = codec.unpack(data + b"rest")
        assert (block.ids == ids).all() and end == len(data) and block.doc_ids == [None, 5]
    assert len(data) < 2 * len(ids) / 3  # repeats are predicted
    for at in (3, len(data) // 2, len(data) - 1):
        with pytest.raises((ValueError, zlib.error)):
            codec.unpack(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_codec_of_small_and_large_vocabularies():
    rng = np.random.default_rng(3)
    for vocab, n in ((1, 5), (2, 1), (2, 3000), (100, 40_000), (65_536, 20_000), (65_537, 20_000), (200_000, 30_000)):
        ids = np.minimum(rng.zipf(1.3, n) - 1, vocab - 1).astype(np.int64)
        ids[: n // 2] = ids[n - n // 2 :]
        payload, lanes = codec.encoded(ids, vocab)
        assert (codec.decoded(payload, n, lanes, vocab) == ids).all()


def test_codec_mixes_contexts(spark):
    """All ids of a table take 15 % less than an adaptive order-0 model would spend, and 7 bits at most."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    w = tokens.Words(tokenizer_path())
    ids = np.frombuffer(b"".join(w(texts)), w.kind).astype(np.int64)
    counts = np.bincount(ids)
    # an adaptive model with a count of 1/2 for each id at first, whatever the order of the ids
    from math import lgamma

    order0 = (lgamma(len(ids) + w.vocab / 2) - lgamma(w.vocab / 2) - sum(lgamma(c + 0.5) - lgamma(0.5) for c in counts.tolist())) / np.log(2)
    payload, lanes = codec.encoded(ids, w.vocab)
    assert 8 * len(payload) < 0.85 * order0 and 8 * len(payload) < 7.0 * len(ids)
    assert (codec.decoded(payload, len(ids), lanes, w.vocab) == ids).all()


def test_words_agree_with_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    w = tokens.Words(tokenizer_path(), most=50)
    texts = ["", "  a b", " x", "x ", "a  b c", "a\n b", "a b\t", "é è x, y.", "<|endoftext|> a<|endoftext|> b", "don't you're  's", "日本 語,. テ", "a  b", "1 2 34 5.6,.", "w., w. w,", "x y\n\nz q", "a b \n c", "\n", "a\n", "hello, world! it's John's\nNew line.\nAnother 12,5% x y z", "a b.\n.c d", "don't\n'tis", "end!!!\n!!x y", "É,! ö.,\nà", "ab\x1cc d", "a\rb c\r\nd"] + [f"t{i} u{i}." for i in range(99)]
    for t, b in zip(texts + texts, w(texts) + w(texts), strict=True):
        assert np.frombuffer(b, w.kind).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_merges_agree_with_the_tokenizer():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(tokenizer_path()), random.Random(6)
    merges = tokens.merges_of(whole.to_str())
    made = ["".join(rng.choices("etaoinshrdlu" if k % 3 else "aeéèüßçñžøABZz", k=rng.randint(1, 14))) for k in range(3000)]
    pieces = [(" " if k % 2 else "") + w for k, w in enumerate(["a", "aaaa", "aaaaa", "zzzzzzz", "e" * 300, "日本", "ɐb", "наука", *made])]
    got = merges(pieces, at_once=700)
    assert [p for p, g in zip(pieces, got, strict=True) if g is None] == [pieces[i] for i in (5, 6, 7)]
    for p, g in zip(pieces, got, strict=True):
        assert g is None or np.frombuffer(g, np.uint16).tolist() == whole.encode(p, add_special_tokens=False).ids
    # where a merge needs a token that a later one makes, another order could come out
    config = json.loads(whole.to_str())
    config["model"]["merges"].reverse()
    assert tokens.merges_of(json.dumps(config)) is None


def test_new_words_of_letters_are_merged_together(monkeypatch):
    """Words that were never seen go through no call of the library each; that was most of the work."""
    w, asked = tokens.Words(tokenizer_path()), []
    monkeypatch.setattr(w, "encode_pieces", lambda words: asked.extend(words) or [b""] * len(words))
    w(["First xqzlum, yvoräch. Brimçon!\nOrdlef mubtan *** plain*** end"] * 2)
    assert asked == ["***"]


def test_places_are_found():
    """The guide's place is that of a search through all places, and numbers of pairs are those of the distinct pairs in order."""
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.2, 30_000) - 1, 499).astype(np.int64)
    none = np.zeros(0, np.int64)
    model = codec.Model(500, guided=True)
    model.learn(ids[2:], ids[1:-1], ids[:-2], none, none)
    context, value = rng.integers(0, 500, 20_000), rng.integers(0, 1 << codec.SUM_BITS, 20_000)
    pairs, n = codec.counted(ids[1:-1] << model.bits | ids[2:])
    of = np.sort(np.r_[np.arange(500), pairs >> model.bits])  # a place without an id, then those of the context
    places = of << codec.SUM_BITS | model.entry[:, 0]
    assert (np.diff(places) >= 0).all()
    assert (model.found(context, value) == np.searchsorted(places, context << codec.SUM_BITS | value, "right") - 1).all()
    for kind in (np.uint32, np.uint64):
        some = rng.integers(0, 900, 5000).astype(kind)
        keys, number = codec.numbered(some)
        want = np.unique(some, return_inverse=True)
        assert (keys == want[0]).all() and (number == want[1]).all()


def test_token_files(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    path = str(tmp_path / "blocks")
    tokens.write(docs, path, tokenizer_path(), block_tokens=20_000)
    rows, at = sorted(collected(tokens.read_back(spark, path, with_ids=True)), key=lambda r: r["doc_id"]), 0
    for r, d in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*whole.encode(d.text, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (d.doc_id, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    n = tokens.export(spark, path, str(tmp_path / "plain"))
    assert n < 2 * at and [i for b in tokens.file_blocks(str(tmp_path / "plain")) for i in b.ids.tolist()] == [i for r in rows for i in r["ids"]]
    got = collected(tokens.round_trip(odd, tokenizer_path()))
    assert len(got) == 8 and sorted(r["n_tokens"] for r in got)[:2] == [1, 1]
    assert tokens.round_trip(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


# neighbours


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    h = neighbours.hadamard(x)
    assert np.allclose(np.linalg.norm(h, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(neighbours.hadamard(h), x)


def test_nearest_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    unit, hit, n = x / np.linalg.norm(x, axis=1, keepdims=True), 0, 0
    got = defaultdict(list)
    for r in neighbours.nearest(df, 50, candidates=1000, block=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[i] = -2
        want = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        mine = got[ids[i]]
        assert len(mine) == 5 and [m[1] for m in mine] == sorted((m[1] for m in mine), reverse=True)
        assert all(abs(v - s[list(ids).index(k)]) < 1e-12 for k, v in mine)
        hit, n = hit + len(want & {k for k, _ in mine}), n + 5
    assert hit / n >= 0.9


def test_probes_hold_recall_on_a_large_table():
    """Random vectors, all tables and probes of the operator, against brute force."""
    rng, n, width, names = np.random.default_rng(8), 200_000, 64, 128
    x = rng.normal(size=(n, width)).astype(np.float32)
    unit, asked = neighbours.padded(x), np.arange(0, n, 5000)
    signs, each = neighbours.rotations(width, neighbours.TABLES), neighbours.probes_each(n, names, neighbours.TABLES, neighbours.CANDIDATES)
    score = unit[asked] @ unit.T
    score[np.arange(len(asked)), asked] = -2
    want, seen = np.argsort(-score, axis=1)[:, :5], np.zeros((len(asked), 5), bool)
    near = unit[want.ravel()]
    for s in signs:  # found if the neighbour's bucket is among those probed, as ranking is exact
        there, looked = neighbours.bucket_names(near, s).reshape(-1, 5), neighbours.probes(unit[asked], s, each)
        seen |= (there[:, :, None] == looked[:, None, :]).any(axis=2)
    assert seen.mean() >= 0.9


def test_nearest_edges(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 1.0]), (50, [1.0, 0.0]), (51, [1.0, 2.0, 3.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (100, [2.0, 0.0])] + [(200 + i, [1.0, 0.0]) for i in range(9)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {0: [1, 50, 100, 200, 201], 50: [0, 1, 100, 200, 201], 100: [0, 1, 50, 200, 201], 200: [0, 1, 50, 100, 201]}
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id in (0, 5)")).collect()[0][:3] == (0, 1, 5)


def test_nearest_of_queries_far_from_all_others(spark):
    """Where the buckets that are looked into hold too few vectors, all are ranked."""
    rng, axis = np.random.default_rng(3), np.eye(16)[0]
    rows = [(i, (axis + 0.05 * rng.normal(size=16)).tolist()) for i in range(1, 3000) if i % 50]
    rows += [(5000, (-axis).tolist()), (5050, (np.eye(16)[1] * 0.1 - axis).tolist())]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.array([v for _, v in rows])
    for q, v in rows[-2:]:
        score = neighbours.cosines(np.broadcast_to(np.array(v), x.shape), x)
        assert got[q] == [(i, -s) for s, i in sorted((-float(s), i) for s, (i, _) in zip(score, rows, strict=True) if i != q)[:5]]
    assert len(got) == 2


# decontamination


def test_nearest_of_collinear_and_of_huge_vectors(spark):
    """Ties go to the smaller ids, and squares that overflow or vanish don't matter."""
    rows = [(i, [2.0 ** (20 * i - 600), 0.0, 2.0 ** (20 * i - 599)]) for i in [*range(1, 50), *range(51, 62)]] + [(50 * 40, [1.0, 0.0, 2.0]), (3, None)]
    df = spark.createDataFrame(rows + [(100, [1e200, 1e200, 0.0])], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in collected(neighbours.nearest(df, 50)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    exact = sorted((-float(neighbours.cosines(np.array([[1.0, 0.0, 2.0]]), np.array([v]))[0]), i) for i, v in rows if v and i != 2000)[:5]
    assert [(v, s) for _, v, s in sorted(got[2000])] == [(i, -s) for s, i in exact] and [i for _, i in exact] == [1, 2, 3, 4, 5]
    assert len(got[100]) == 5 and all(np.isfinite(s) for _, _, s in got[100])


def test_edits_are_exact():
    rng = random.Random(5)

    def brute(item, text):
        best = len(item)
        for a in range(len(text) + 1):
            row = list(range(len(item) + 1))
            best = min(best, row[-1])
            for w in text[a:]:
                new = [row[0] + 1]
                for j, x in enumerate(item):
                    new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
                row = new
                best = min(best, row[-1])
        return best

    for _ in range(60):
        item, text = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        n, a, b = decontaminate.edits(np.array(item, np.uint64), np.array(text, np.uint64))
        assert n == brute(item, text) and 0 <= a <= b <= len(text) and brute(item, text[a:b]) == n


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {(k, i) for k, t in rows for i, b in items if b in t}
    got = {(r["doc_id"], r["item_id"]): r for r in collected(decontaminate.found(docs, bench))}
    assert want <= set(got)
    text = dict(rows)
    for (k, i), r in got.items():  # what was found is within the bound, by another way
        own, there = dict(items)[i].lower().split(), text[k][r["start"] : r["end"]].lower().split()
        assert r["edits"] <= 0.2 * r["item_words"] and len(set(own) & set(there)) >= 0.6 * len(set(own))
    kept = {r.doc_id for r in decontaminate.without_copies(docs, bench, at_once=7).collect()}
    assert kept == set(text) - {k for k, _ in got}


def test_decontamination_recall_on_edited_items(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(15, 60)))) for i in range(100)]
    index, hits = decontaminate.Items(items), 0
    for i, t in items:
        w = t.split()
        for _ in range(max(1, len(w) // 10)):
            w[rng.randrange(len(w))] = "changed"
        host = [f"h{rng.randrange(500)}" for _ in range(50)] + w + [f"h{rng.randrange(500)}" for _ in range(50)]
        hits += any(h[0] == i for h in index.hits([words(" ".join(host))], 0.2)[0])
    clean = [words(" ".join(f"w{rng.randrange(500)}" for _ in range(400))) for _ in range(50)]
    assert hits >= 90 and not any(index.hits(clean, 0.2))


def edited(rng, words, n):
    """words after n edits, each at another word: a substitution, an insertion after it or a deletion."""
    out, at = [], set(rng.sample(range(len(words)), n))
    for i, w in enumerate(words):
        kind = rng.randrange(3) if i in at else 3
        out += [[f"new{rng.randrange(10**6)}"], [w, f"new{rng.randrange(10**6)}"], [], [w]][kind]
    return out


def recall_of_copies(n, k, trials=60):
    rng = random.Random(n * 100 + k)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(n))) for i in range(trials)]
    index, host = decontaminate.Items(items), lambda: [f"h{rng.randrange(5000)}" for _ in range(rng.randrange(20, 60))]
    docs = [words(" ".join(host() + edited(rng, t.split(), k) + host())) for _, t in items]
    return sum(any(h[0] == i for h in hits) for i, hits in enumerate(index.hits(docs, 0.2))) / trials


@pytest.mark.parametrize("n", [30, 35, 40, 59])
def test_decontamination_finds_every_copy_at_the_bound(n):
    assert recall_of_copies(n, int(0.2 * n)) == 1


@pytest.mark.parametrize("n", range(1, 16))
def test_decontamination_finds_every_copy_of_short_items(n):
    assert recall_of_copies(n, 0) == recall_of_copies(n, int(0.2 * n) if n >= 8 else 0) == 1


def test_decontamination_of_string_ids(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([("a", f"head {item} tail"), (None, item), ("c", "clean")], "doc_id string, text string")
    bench = spark.createDataFrame([("x1", item, 1), (None, item, 2), ("x3", None, 3)], "item_id string, text string, edits int")
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["start"], r["edits"]) for r in collected(decontaminate.found(docs, bench)))
    assert got == [("None", "None", 0, 0), ("None", "x1", 0, 0), ("a", "None", 5, 0), ("a", "x1", 5, 0)]


def test_short_items_match_only_as_they_are():
    index = decontaminate.Items([(1, "red green blue"), (2, "one two three four five six seven"), (3, "")])
    texts = ["a red green blue b", "a red green x blue b", "one two three four five six seven", "one two three four x six seven", ""]
    assert [[h[0] for h in hits] for hits in index.hits([words(t) for t in texts], 0.2)] == [[0], [], [1], [], []]


def test_decontamination_edges(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "w1 w2")], "item_id long, text string")
    assert decontaminate.found(odd, bench).count() == 0
    assert decontaminate.without_copies(odd, bench).columns == odd.columns and decontaminate.without_copies(odd, bench).count() == 8
    assert decontaminate.found(odd, bench.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "One two three, four five six seven eight nine ten")], "doc_id long, text string")
    r = decontaminate.found(short, bench).collect()[0]
    assert (r.item_id, r.start, r.end, r.edits) == (1, 0, 49, 0)


# toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fitted(docs, labels, "doc_id", "text", "toxic")
    rows = toxicity.scored(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = Counter((r.toxic, r.predicted) for r in rows)
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.8 and right[0, 1] / (right[0, 0] + right[0, 1]) < 0.02
    bad = [r for r in rows if r.toxic and r.predicted]
    assert sum(bool(r.offending) for r in bad) > 0.9 * len(bad)


def test_noisy_or_learns_the_sentence():
    rng = random.Random(1)
    bags, labels = [], []
    for i in range(400):
        bag = [[f"w{rng.randrange(60)}" for _ in range(6)] for _ in range(5)]
        if i % 2:
            bag[rng.randrange(5)].append("awful")
        bags.append(bag)
        labels.append(i % 2)
    m = toxicity.trained(bags, labels)
    s = m.sentence_scores("W1 w2 w3. This is awful! w4 w5.", toxicity.WordWeights(m.weights))
    assert max(s, key=lambda x: x[2])[:2] == (9, 24) and toxicity.noisy_or([x[2] for x in s]) > 0.7 > toxicity.noisy_or([s[0][2]])


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(odd, labels, "doc_id", "text", "toxic")
    rows = collected(toxicity.scored(odd, model))
    assert len(rows) == 8 and all(r["score"] < 1e-6 and r["predicted"] == 0 for r in rows)
    assert toxicity.without_toxic(odd, model).columns == odd.columns and toxicity.scored(odd.limit(0), model).count() == 0


# sentence spans


def brute_pieces(t, a, b):
    """Pieces of a sentence, word by word."""
    found = list(re.finditer(r"[0-9a-zA-Z_\u0080-\U0010ffff]+", t[a:b]))
    if len(found) <= spans.LONGEST:
        return [[m[0].lower() for m in found]]
    out = [[]]
    for m in found:
        if len(out[-1]) == spans.PIECE or (out[-1] and zlib.crc32(out[-1][-1].encode()) % spans.CUT_ONE_IN == 0):
            out.append([])
        out[-1].append(m[0].lower())
    return out


def brute_spans(rows):
    seen, out = set(), {}
    for k, t in sorted(rows):
        own = [w for a, b in spans.sentences(t) for w in brute_pieces(t, a, b) if w]
        gone = set()
        for i in range(len(own)):
            long = next((j for j in range(i + spans.RUN, len(own) + 1) if sum(map(len, own[i:j])) >= spans.LEAST_WORDS), None)
            for j in (long, i + 1 if len(own[i]) >= spans.LONE_WORDS else None):
                if j is not None:
                    key = str(own[i:j])
                    if key in seen:
                        gone.update(range(i, j))
                    seen.add(key)
        out[k] = len(gone)
    return out


def test_sentence_spans(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r["doc_id"]: r for r in collected(spans.deduplicated(docs))}
    want = brute_spans(rows)
    for k, t in rows:
        assert got[k]["n_removed"] == want[k]
        cut = "".join(t[a:b] for a, b in zip([0, *(g["end"] for g in got[k]["removed"])], [*(g["start"] for g in got[k]["removed"]), len(t)], strict=True))
        assert got[k]["text"] == cut and "".join(t[a:b] for a, b in spans.sentences(t)) == t


def test_sentence_span_edges(spark, odd):
    p = "First one is here now. Second one follows after it with words. Third closes the whole thing at last for them!"
    df = spark.createDataFrame([(1, f"Intro text here. {p} End."), (2, f"{p} Other tail words."), (3, None), (4, ""), (5, "Of. Is. A."), (6, "Of. Is. A.")], "doc_id long, text string").withColumn("removed", F.lit(0))
    got = {r["doc_id"]: r for r in collected(spans.deduplicated(df))}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "Other tail words." and got[2]["n_removed"] == 3
    assert got[3]["text"] is None and got[5]["n_removed"] == got[6]["n_removed"] == 0
    rows = collected(spans.deduplicated(odd))
    assert len(rows) == 8 and {r["doc_id"]: r["n_removed"] > 0 for r in rows}[5] and {r["doc_id"]: r["n_removed"] for r in rows}[1] == 0
    assert spans.deduplicated(odd.limit(0)).count() == 0


def test_short_passages_of_many_words(spark):
    two = "This passage holds only two whole sentences here and no more. It is still repeated in another document that comes later."
    lone = " ".join(f"word{i}" for i in range(25)) + "."
    rows = [(1, f"Some start. {two} One end."), (2, f"Another start. {two} Another end."), (3, f"Head here. {lone} Tail here."), (4, f"Front now. {lone} Back now."), (5, lone), (6, lone[6:])]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in collected(spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[2] == (2, "Another start. Another end.") and got[4] == (1, "Front now. Back now.") and got[5] == (1, "")
    assert [got[k][0] for k in (1, 3, 6)] == [0, 0, 0]


def test_sentence_ends():
    cut = lambda t: [t[a:b] for a, b in spans.sentences(t)]
    assert cut("Version 1.5 of a.b is out.*** Next one.\"") == ["Version 1.5 of a.b is out.", "*** Next one.", '"']
    assert cut("一句。二句！three? four\nfive") == ["一句。", "二句！", "three? ", "four\n", "five"]


def test_stretches_without_an_end(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(120))
    rows = [(1, f"head alone {long} tail alone"), (2, f"other beginning of a text {long} and its end"), (3, "la " * 20_000), (4, "x y z " + "la " * 90)]
    got = {r["doc_id"]: r for r in collected(spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[1]["n_removed"] == 0 and len(got[2]["text"].split()) < 60 and "beginning" in got[2]["text"] and "end" in got[2]["text"]
    assert got[3]["n_removed"] > 100 and got[4]["text"].startswith("x y z")


def test_spans_of_one_passage_in_most_documents(spark):
    p = "This is the notice that nearly everyone repeats below what they write. It has a second sentence, too, with some more words."
    rows = [(i, f"Own words number {i} here. {p} Then words of number {i} again.") for i in range(500)]
    got = {r["doc_id"]: r["n_removed"] for r in collected(spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)))}
    assert got[0] == 0 and all(got[i] == 2 for i in range(1, 500))


# sharding


def test_shards(docs, odd, spark):
    rows = collected(sharding.shard_table(docs, 24))
    text = {r.doc_id: r.text for r in docs.collect()}
    load, held = Counter(), defaultdict(list)
    for r in rows:
        t = text[r["doc_id"]].encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        held[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in held.values()) and len(held) == 24
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    got = collected(sharding.shard_table(odd, 24))
    assert len(got) == 8 and {r["size"] for r in got if r["doc_id"] in (2, 3)} == {8} and sharding.shard_table(odd.limit(0)).count() == 0
    assert {r["virtual_slot"] for r in got if r["doc_id"] == 1} == {next(r["virtual_slot"] for r in got if r["doc_id"] == 1)}
    out = sharding.sharded_documents(odd)
    assert out.count() == 8 and {"text", "shard", "virtual_slot"} <= set(out.columns)


def test_shards_of_one_id(spark):
    rows = [(7, f"text number {i}" * 9) for i in range(2000)] + [(i + 10, f"other {i}" * 9) for i in range(2000)] + [(None, f"none {i}" * 9) for i in range(500)]
    got = collected(sharding.shard_table(spark.createDataFrame(rows, "doc_id long, text string"), 8))
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.01 * sum(load.values()) / 8 + max(r["size"] for r in got)


def test_slot_map_versions(spark, tmp_path):
    rng = random.Random(4)
    sizes = {v: rng.randrange(1, 1000) for v in range(sharding.SLOTS)}
    m = sharding.SlotMap.dealt(sizes, 24)
    m.store(spark, str(tmp_path / "map"))
    assert sharding.stored(spark, str(tmp_path / "map")) == m
    g = m.rebalanced(sizes, 25)
    moved = [(a, b) for a, b in zip(m.shard, g.shard, strict=True) if a != b]
    assert g.version == 2 and all(b == 24 for _, b in moved) and len(moved) < sharding.SLOTS / 20
    assert max(g.loads()) < 1.02 * sum(sizes.values()) / 25 + 1000 and min(g.loads()) > 0.97 * sum(sizes.values()) / 25
    sizes |= {v: 20_000 for v in range(50)}
    h = g.rebalanced(sizes)
    h.store(spark, str(tmp_path / "map"))
    assert sharding.stored(spark, str(tmp_path / "map")).version == 3 and sharding.stored(spark, str(tmp_path / "map"), 1) == m
    assert max(h.loads()) - min(h.loads()) < 40_000


# line dedup


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_line_dedup(spark, docs):
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stock = [f"{'abcdefghij'[i % 10]} line of some text number {i // 3} ends" for i in range(40)]
    for i in range(80):
        t = list(rng.choice(stock))
        for _ in range(rng.randrange(3)):
            p = rng.randrange(len(t))
            rng.choice((lambda p=p: t.insert(p, "z"), lambda p=p: t.pop(p), lambda p=p: t.__setitem__(p, "é")))()
        rows.append((10_000 + i, "".join(t)))
    got = {r["doc_id"]: r for r in collected(lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")))}
    before = []
    for k, t in sorted(rows):
        keep, n = [], 0
        for x in t.split("\n"):
            q = x.strip("\t\n\x0b\x0c\r ")
            if q and any(q == y or within_one(q, y) for y in before):
                n += 1
            else:
                keep.append(x)
            if q:
                before.append(q)
        assert (got[k]["n_removed"], got[k]["text"]) == (n, "\n".join(keep))
    assert sum(r["n_removed"] for k, r in got.items() if k >= 10_000) > 20


def test_line_dedup_edges(spark, odd):
    s = "abcdefghijklmnopqrstuvwxyz"
    rows = [(0, f"{s}\n\nshort\n{s}"), (1, f"{s[:5] + s[6:]}\nsh0rt\n {s[:9]}!{s[9:]}"), (2, f"Z{s[1:]}\n{s[:25]}\nshort"), (3, None), (4, ""), (None, "ab" + s), (5, s[:3] + s[4:] + "Q")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in collected(lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {0: (f"{s}\n\nshort", 3, 1), 1: ("", 3, 3), 2: ("", 3, 3), 3: (None, 0, 0), 4: ("", 0, 0), None: ("ab" + s, 1, 0), 5: (s[:3] + s[4:] + "Q", 1, 0)}
    rows = collected(lines.deduplicated(odd))
    assert len(rows) == 8 and {r["doc_id"]: r["text"] for r in rows}[5] == "" and lines.deduplicated(odd.limit(0)).count() == 0


def test_line_dedup_of_short_and_very_long_lines(spark):
    long = "".join(random.Random(5).choices("abcdefgh ij", k=200_000)) + "x"
    edge = "e" * 4095
    rows = [(0, "a\nbb"), (1, "ab\nxyz"), (2, "b\nwxyz\nqq"), (3, long), (4, long[:77_777] + long[77_778:]), (5, "new" + long), (6, edge), (7, edge + "e"), (8, edge + "eee")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in collected(lines.deduplicated(df))}
    assert [got[k] for k in (0, 1, 2)] == ["a\nbb", "xyz", "qq"] and got[3] == long and got[4] == "" and got[5] == "new" + long and [got[k] for k in (6, 7)] == [edge, ""]
    assert got[8] == edge + "eee" and {r["doc_id"]: r["n_removed"] for r in collected(lines.deduplicated(df, fuzzy_from=10))}[2] == 0


def test_line_dedup_of_one_line_in_most_documents(spark):
    rows = [(i, f"All rights reserved.\nown line of {i} {hashlib.md5(str(i).encode()).hexdigest()}") for i in range(1000)]
    got = collected(lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)))
    assert all(r["n_removed"] == int(r["doc_id"] > 0) for r in got)
