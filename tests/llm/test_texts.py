"""Operators over texts against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import random
import re
import sys
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from blockloom.llm import bpe, components, decontaminate, hashing, jaccard, pieces, pii, spans, substring, token_store

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Naïve,", "été", "\x1c", "Ünder"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))) for _ in range(n)]
    for i in range(0, n, 4):
        base = texts[i].split(" ")
        if len(base) > 10:
            base[rng.randrange(len(base))] = "changed"
            texts[(i + 1) % n] = " ".join(base)
            texts[(i + 2) % n] = texts[i]
    return [*texts, None, "", " ", "one", "One  two", "\t\n", " ".join(["same"] * 300), "x" * 5000, "the end"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = corpus(2) + ["a " * 200_000 + "b"]
    for lower in (False, True):
        seen = {}
        for lo, hi, h, at in hashing.Hasher(lower).documents(pa.array(texts)):
            for i in range(lo, hi):
                raw = (texts[i] or "").encode()
                words = (raw.lower() if lower else raw).split()
                own = h[at[i - lo] : at[i - lo + 1]]
                assert len(own) == len(words)
                for w, x in zip(words, own.tolist(), strict=True):
                    assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_sequences_are_position_free():
    h = hashing.mix(np.arange(400, dtype=np.uint64) % np.uint64(50))
    for k in (3, 35):
        x = hashing.sequences(h, k)
        assert np.array_equal(x[:50], x[50:100]) and len(set(x.tolist())) == 50


@pytest.mark.parametrize("text", ["", " ", "a", "a b", " a  b \n c ", "a  b", "don't  stop\n\n x", "x " * 300_000, "y" * 600_000, "é" * 10 + " ü"])
def test_pieces_lose_nothing(text):
    whole = [p if i == 0 and j == 0 else " " + p for i, s in enumerate(pieces.segments(text)) for j, p in enumerate(pieces.split(s))]
    assert "".join(whole) == text


def test_bpe_round_trip(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*corpus(), "it's we'll I'd  \n\n  x  ", "<|endoftext|> 1234567 ¿qué?", "日本語 テスト", "word " * 80_000]
    df = frame(spark, texts).withColumn("n_tokens", F.lit("clash"))
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    decoded = {r["doc_id"]: r for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert decoded[i]["token_ids"] == ids and decoded[i]["n_tokens"] == len(ids) and bytes(decoded[i]["decoded"]) == (t or "").encode()
    digests = {r["doc_id"]: r for r in bpe.digests(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    ids = encoding.encode_ordinary(texts[0])
    assert digests[0]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("as_text", [True, False])
def test_token_store(spark, tmp_path, as_text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    if as_text:
        tokenizer.encode_special_tokens = True
    texts = [*corpus(), "<|endoftext|>", "a  b\n c", "a <|endoftext|> b<|endoftext|>\nc  <|endoftext|>", "x.\nYes,\n***no***\n \"q\n", "w(1)\n\nz\r\ny\tz don't\nI'll!"]
    folder = (tmp_path / "t").as_uri()
    shards = token_store.write(token_store.encode(token_store.in_order(frame(spark, texts), 3), TOKENIZER, 0, special_as_text=as_text), folder, length=16)
    rows = {r["doc_id"]: r for r in token_store.checksums(token_store.read(spark, folder, shards)).collect()}
    start, flat = 0, []
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        flat += ids
    first = shards.orderBy("least").first()
    import pyarrow as pa

    with pa.memory_map(str(tmp_path / "t" / f"{first['shard']}.arrow")) as source:
        ids, mask = token_store.ShardReader(source).sequence(1)
    assert ids.tolist() == flat[16:32] and mask.all()
    none = token_store.write(token_store.encode(token_store.in_order(frame(spark, texts).where("false"), 2), TOKENIZER, 0), (tmp_path / "e").as_uri())
    assert token_store.read(spark, (tmp_path / "e").as_uri(), none).count() == 0


def test_token_store_with_null_and_tied_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "a b"), (2, "c"), (None, None), (2, "c d"), (-1, "")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    folder = (tmp_path / "n").as_uri()
    rows = token_store.read(spark, folder, token_store.write(token_store.encode(token_store.in_order(df), TOKENIZER, 0), folder)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == [("-1", 1), ("2", 2), ("2", 3), ("None", 1), ("None", 3)]
    order = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == [None, None, -1, 2, 2] and order[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(order, order[1:], strict=False))


def test_long_pieces_and_tiny_caches_change_nothing(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(pieces, "WAITING", 40)
    monkeypatch.setattr(pieces, "SEGMENT", 60)
    tokenizer, rng = Tokenizer.from_file(TOKENIZER), random.Random(3)
    parts = ["the", "Naïve", "été,", "x.", "\n", " ", "  ", "\t", "don't", "12", "a\nb", "c.\nD,\nE", "***", "\u00a0", "日本", "q\"", "(w)"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    for room in (0, 5, 1000):
        monkeypatch.setattr(pieces, "CACHED_PIECES", room)
        got = token_store.JsonTokenizer(TOKENIZER).encode(texts)
        assert [np.frombuffer(b, np.uint32).tolist() for b in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


ODD = ["the", "Naïve", "été,", "x.", " ", "  ", "\n", "\n\n", "\t", "\r\n", "don't", "'t", "''s", "'S", "12", "\u00b2", "a1b", "_", "***", "(w)", "\u00a0", "\u0085", "\u3000", "\u2003", "\u1680", "\u180e", "\u200b", "\u00d7", "\u00f7", "日本", "слово", "\u201cq\u201d", "e\u0301", "\u00aa", "\U0001f600", "\x1c", "\x7f", "\x00", "<|endoftext|>", "<|endof", "text|>", "\u017f", "\u0663", "\ufeff"]


@pytest.mark.parametrize("as_text", [True, False])
def test_spans_give_the_ids_of_whole_texts(monkeypatch, as_text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    whole.encode_special_tokens = as_text
    for seed in range(8):
        rng = random.Random(seed)
        some = rng.sample(ODD, rng.randrange(2, len(ODD)))
        texts = ["".join(rng.choice(some) + rng.choice(["", "", " "]) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, ""]
        monkeypatch.setattr(spans, "BLOCK", rng.choice([3, 17, 64, 4 << 20]))
        monkeypatch.setattr(spans, "GENERATION", rng.choice([0, 5, 300_000]))
        monkeypatch.setattr(token_store, "PIECES", rng.choice([1, 7, 16384]))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        tokenizer = token_store.JsonTokenizer(TOKENIZER, as_text)
        for _ in range(2):
            got = tokenizer.encode_column(pa.array([None, "left out", *texts], pa.string()).slice(2))
            assert [np.frombuffer(b, np.uint32).tolist() for b in got] == want
        tokenizer.by_pattern = False
        assert [np.frombuffer(b, np.uint32).tolist() for b in tokenizer.encode(texts)] == want
    assert token_store.JsonTokenizer(TOKENIZER).encode([]) == []


class _Counting:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, []

    def encode_batch_fast(self, texts, **more):
        self.given += texts
        return self.inner.encode_batch_fast(texts, **more)


def test_the_library_gets_a_word_once_whatever_stands_around_it():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(200)]
    around = ["{}", "({})", "{}.", "[{}],", "{}!!", "*{}*", "{0}\n{0}", '"{}"', "{}'s"]
    texts = [" ".join(rng.choice(around).format(rng.choice(words)) for _ in range(500)) for _ in range(20)]
    tokenizer = token_store.JsonTokenizer(TOKENIZER)
    tokenizer.tokenizer = counting = _Counting(tokenizer.tokenizer)
    got = tokenizer.encode(texts)
    assert [np.frombuffer(b, np.uint32).tolist() for b in got] == [e.ids for e in counting.inner.encode_batch_fast(texts, add_special_tokens=False)]
    assert sum(map(len, counting.given)) < 2 * 200 * 9 + 100


def test_frequent_spans_stay_known_when_a_cache_is_full(monkeypatch):
    monkeypatch.setattr(spans, "GENERATION", 60)
    monkeypatch.setattr(pieces, "CACHED_PIECES", 120)
    tokenizer = token_store.JsonTokenizer(TOKENIZER)
    tokenizer.tokenizer = counting = _Counting(tokenizer.tokenizer)
    for i in range(30):
        tokenizer.encode([" ".join(["start", "common", *(f"{'xyz'[j % 3] * (j + 1)}{'abcdefghij'[i % 10] * (i // 10 + 1)}" for j in range(20))])])
    assert sum(t.count("common") for t in counting.given) == 1
    assert len(tokenizer.spans.young) <= 60 and len(tokenizer.spans.old) <= 60


def test_token_store_takes_one_python_process_a_task(spark, tmp_path):
    folder = (tmp_path / "p").as_uri()
    encoded = token_store.encode(token_store.in_order(frame(spark, corpus()), 3), TOKENIZER, 0)
    read_back = token_store.read(spark, folder, token_store.write(encoded, folder))
    sums = token_store.checksums(read_back)
    assert sums._jdf.queryExecution().toString().count("MapInArrow") == read_back._jdf.queryExecution().toString().count("MapInArrow")
    ids = {r["doc_id"]: bytes(r["ids"]) for r in encoded.collect()}
    assert {r["doc_id"]: bytes(r["ids"]) for r in read_back.collect()} == ids
    assert {r["doc_id"]: r["ids_crc32"] for r in sums.collect()} == {i: zlib.crc32(np.frombuffer(b, np.uint16).astype("<u4").tobytes()) for i, b in ids.items()}


def test_workers_keep_no_other_operators_caches(spark, monkeypatch):
    import pyarrow as pa

    tasks, docs = [], frame(spark, ["a b c d e f"])
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: tasks.append(run) or plain(self, run, schema))
    monkeypatch.setattr(sys, "_blockloom_process_cache", {}, raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([0], pa.int64()), "text": ["a b c d e f"]})
    bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    encode = tasks.pop()
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    benchmark = spark.createDataFrame([(1, "q w e r t y")], "item_id bigint, text string")
    others = [(["text"], lambda: jaccard.frequent_words(docs)), (["doc_id", "text"], lambda: jaccard.signatures(docs, none, 5, 80, 100)), (["doc_id", "text"], lambda: decontaminate.without_contaminated(docs, benchmark))]
    for columns, other in others:
        ids = [x["token_ids"].to_pylist() for x in encode(iter([batch]))]
        codec = weakref.ref(bpe.Codec.get(RANKS, public_tokenizers.PATTERN))
        assert [x["token_ids"].to_pylist() for x in encode(iter([batch]))] == ids and codec() is bpe.Codec.get(RANKS, public_tokenizers.PATTERN)
        tasks.clear()
        other()
        assert list(tasks[0](iter([batch.select(columns)]))) and codec() is None


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 50)])
def test_similarity_components(spark, k, num, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    rng = random.Random(k)
    texts = corpus(k, 50)
    base = [f"v{i}" for i in range(60)]
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(60)] = f"u{rng.randrange(99)}"
        texts.append(" ".join(copy))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(frame(spark, texts), k, num, 100).collect()}
    assert got == brute_components(texts, k, num, 100)


def test_similarity_with_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (1, "A B C D"), (2, None)], "doc_id bigint, text string").withColumn("token", F.lit("clash")).withColumn("n", F.lit(0))
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(df, 3, 90, 100).collect())
    assert got == [("1", 2, 1), ("2", 0, 2), ("3", 2, 1), ("3", 2, 1), ("None", 2, None)]
    assert jaccard.similarity_components(df.where("false"), 3, 90, 100).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_long_chain_of_links_takes_few_rounds(spark, monkeypatch):
    rounds = []
    small_star = components._small_star
    monkeypatch.setattr(components, "_small_star", lambda links: rounds.append(1) or small_star(links))
    links = spark.range(10_000).selectExpr("id a", "id + 1 b")
    found = components.components(links)
    assert found.where("component <> 0").count() == 0 and found.count() == 10_001 and len(rounds) < 20


def test_star_of_a_hot_node(spark):
    links = spark.range(1, 4000).selectExpr("5000 a", "id b").unionByName(spark.range(6000, 6010).selectExpr("id a", "id + 1 b"))
    found = components.components(links)
    assert {tuple(r) for r in found.groupBy("component").count().collect()} == {(1, 4000), (6000, 11)}
    assert components.components(links.where("false")).count() == 0


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"v{i}" for i in range(150)]
    texts = [" ".join([*base[: 150 - 2 * i], *(f"z{j}" for j in range(2 * i))]) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(frame(spark, texts), 5, 80, 100).collect()}
    assert got == brute_components(texts, 5, 80, 100)


def test_similar_classes_give_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    rng = random.Random(21)
    base = [f"v{i}" for i in range(50)]
    texts = corpus(5, 30)
    for _ in range(20):
        copy = list(base)
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(50)] = f"u{rng.randrange(99)}"
        texts.append(" ".join(copy))
    links, classes = jaccard.similar_classes(frame(spark, texts), 3, 80, 100)
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    least = {}
    for i, x in sets.items():
        least.setdefault(x, i)
    assert {r["doc_id"]: r["class_id"] for r in classes.collect()} == {i: least[x] if x else i for i, x in sets.items()}
    reps = [(i, x) for x, i in least.items() if x]
    assert {tuple(r) for r in links.collect()} == {(min(i, j), max(i, j)) for i, x in reps for j, y in reps if i != j and 100 * len(x & y) >= 80 * len(x | y)}


def test_repeated_windows(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(70)]
    texts = corpus(7, 30)
    for _ in range(12):
        a = rng.randrange(0, 30)
        texts.append(" ".join([f"x{rng.randrange(999)}" for _ in range(rng.randrange(30))] + passage[a : a + rng.randrange(30, 41)] + [f"y{rng.randrange(999)}" for _ in range(rng.randrange(40))]))
    texts += ["tick " * 80, "a b " * 60, " ".join(passage), " ".join(passage + passage)]
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    got = {r["doc_id"]: r for r in substring.remove_repeats(frame(spark, texts).withColumn("row", F.lit("clash")), 35, with_text=True).collect()}
    for i, w in enumerate(words):
        cut = [False] * len(w)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                cut[j : j + 35] = [True] * 35
        kept = b" ".join(x for x, c in zip(w, cut, strict=True) if not c)
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) == (len(w), sum(cut), hashlib.sha256(kept).hexdigest(), kept.decode())


def test_repeated_windows_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a b"), (2, None)], "doc_id bigint, text string")
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df).collect()) == [("1", 40, 40), ("1", 40, 40), ("2", 0, 0), ("None", 2, 0)]
    assert substring.remove_repeats(df.where("false")).count() == 0


def brute_tiles(item, text, least):
    free_a, free_b, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and free_a[i + n] and free_b[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        total += n


def test_tiles_equal_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        item = [rng.randrange(12) for _ in range(rng.randrange(5, 40))]
        cut = rng.randrange(len(item))
        text = item[cut:] + [rng.randrange(30) for _ in range(rng.randrange(6))] + item[:cut] + [rng.randrange(12) for _ in range(20)]
        if rng.random() < 0.2:
            item, text = [1] * rng.randrange(5, 30), [rng.choice([1, 1, 1, 2]) for _ in range(60)]
        laid = decontaminate.tiles(np.array(item), np.array(text), 5)
        assert all(item[i : i + n] == text[j : j + n] and n >= 5 for i, j, n in laid)
        places = [x for i, _, n in laid for x in range(i, i + n)]
        assert len(places) == len(set(places))
        assert len(places) == brute_tiles(item, text, 5)


def test_tiles_of_repetitive_texts_stay_linear():
    item, text = np.ones(4000, np.uint64), np.ones(30_000, np.uint64)
    text[::700] = 2
    assert sum(n for _, _, n in decontaminate.tiles(item, text, 5)) == 4000


def test_contamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    moved = item[10:] + ["and", "then"] + item[:10]
    texts = [" ".join(["x"] * 50 + item), " ".join(moved).upper(), " ".join(item[:7]), "clean " * 20, None, "", "tiny one"]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "tiny one"), (9, None), (10, "")], "item_id bigint, text string")
    docs = frame(spark, texts).withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): (r["matched_words"], r["n_tiles"], r["coverage"]) for r in decontaminate.contaminations(docs, benchmark).collect()}
    assert got == {(0, 7): (20, 1, 1.0), (1, 7): (20, 2, 1.0), (6, 8): (2, 1, 1.0)}
    assert sorted(r["doc_id"] for r in decontaminate.without_contaminated(docs, benchmark).collect()) == [2, 3, 4, 5]
    assert decontaminate.contaminations(docs, benchmark.where("false")).count() == 0
    named = benchmark.select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("item_id"), "text").unionByName(spark.createDataFrame([(None, "tiny one")], "item_id string, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs.unionByName(docs.where("doc_id = 6")), named).collect()}
    assert got == {(0, "item 7"), (1, "item 7"), (6, "item 8"), (6, None)}


KINDS = ["email", "ip", "card", "phone"]
BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_base(text):
    def passes(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and luhn % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(zip(KINDS, BASE, strict=True)) for m in re.finditer(p, text) if passes(kind, m.group()))
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in found)


def test_base_spans(spark):
    rng = random.Random(6)
    alphabet = ["a", "B", "@", ".", "-", "+", " ", "(", "1", "0", "25", "255", "4", "é", "😀", "%", "x@y.z", "1.2.3.4", "+1 (555) 010-9999", "4111 1111 1111 1111", "79927398713"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(700)]
    texts += [None, "", "a@b.c.d%x@y.z", "1.2.3.4.5.6.7.8", "0" * 30_000, "a" * 30_000 + "@", "1." * 9000, "378282246310005 x@é.c", "4111-1111-1111-1111-1", "00000000000000"]
    got = {r["doc_id"]: r for r in pii.findings(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in KINDS] == [base.count(f"{k}:") for k in KINDS]


def test_context_finds_unseen_identifiers(spark):
    texts = [f"lorem account 110.120.{100 + i}.7 closed" for i in range(12)] + ["lorem account AB-7731-X closed", "other 12345 words", "year 2024 ended"]
    got = {r["doc_id"]: r["spans"] for r in pii.findings(frame(spark, texts)).collect()}
    assert got[12] == "context:14:23" and got[13] == "" and got[14] == ""
    clean = {r["doc_id"]: r for r in pii.redacted(frame(spark, [*texts, None]).withColumn("n_chars", F.length("text")).withColumn("spans", F.lit("clash"))).collect()}
    assert clean[12]["text"] == "lorem account [CONTEXT] closed" and clean[12]["n_chars"] == 30 and clean[0]["text"] == "lorem account [IP] closed"
    assert clean[13]["text"] == texts[13] and clean[15]["text"] is None and clean[12]["spans"] == "clash"
    assert pii.findings(frame(spark, texts).where("false")).count() == 0


def test_every_kind_is_a_seed_and_any_word_a_candidate(spark):
    texts = [f"write to user{i}@mail.org  {' ' * 80}please" for i in range(40)] + [f"call +1 (017) 555-77{i} tonight" for i in range(10, 50)]
    texts += ["😀 write  to ann(at)mail please", "call back-office tonight", "plain words only"]
    got = {r["doc_id"]: r["spans"] for r in pii.findings(frame(spark, texts)).collect()}
    assert got[80] == "context:12:23" and got[81] == "context:5:16" and got[82] == ""


def test_pii_plan_has_no_python(spark):
    plan = pii.findings(frame(spark, ["a@b.c"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
