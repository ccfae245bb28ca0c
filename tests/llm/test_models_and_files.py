"""Learned scores by held-out accuracy; archives by round trip and damage."""

import base64
import hashlib
import math
import os
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import media, quality, toxicity, warc


def labelled(spark, kind, n=600):
    rng = random.Random(8)
    words = ["river", "stone", "light", "garden", "window", "paper", "morning", "of", "the", "and", "with"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.3
        if bad and kind == "toxic":
            text[rng.randrange(len(text))] = rng.choice(["vilefool", "stinkwit", "dreckhead"])
        if bad and kind == "quality":
            text = [w.upper() + "!!" for w in text] if rng.random() < 0.5 else [rng.choice(words)] * len(text)
        rows.append((i, " ".join(text), int(bad) if kind == "toxic" else int(not bad)))
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {kind} int").repartition(4)


def accuracy(scores, truth, label):
    rows = scores.select("doc_id", "score").join(truth.select("doc_id", label), "doc_id").select(((F.col("score") >= 0.5).cast("int") == F.col(label)).cast("int").alias("hit"))
    return rows.agg(F.avg("hit")).first()[0]


def test_quality_rules(spark):
    rows = labelled(spark, "quality")
    train, test = rows.where("doc_id % 3 <> 1"), rows.where("doc_id % 3 = 1")
    model = quality.train(rows.select("doc_id", "text"), train.select("doc_id", "quality"), "quality")
    assert 0 < len(model.rules) < 80 and all(" if " in line for line in model.describe())
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 50_000), (None, "a")], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    assert accuracy(quality.scored(test, model), test, "quality") > 0.95
    scores = [r["score"] for r in quality.scored(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    plan = quality.scored(rows, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    none = quality.train(rows, train.where("false").select("doc_id", "quality"), "quality")
    assert {r["score"] for r in quality.scored(odd, none).collect()} == {0.5}


def test_quality_parts_equal_plain_python(spark):
    """Rules against the rows they hold for, weights against the conditions of the lasso's optimum, the column against a sum."""
    import numpy as np

    rows = labelled(spark, "quality", 400)
    names = quality.NAMES
    table = rows.select("doc_id", "quality", *(c.alias(n) for n, c in quality.statistics(F.col("text")).items())).collect()
    x = np.array([[r[n] for n in names] for r in table])
    y = np.array([r["quality"] for r in table], float)
    words = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in table[:50]:
        own = words[r["doc_id"]].split()
        assert (r["words"], r["distinct"]) == (len(own), len(set(own)) / len(own)) and r["upper"] == sum(c.isupper() for c in words[r["doc_id"]]) / len(words[r["doc_id"]])
    paths = quality._paths(x, y)
    holds = lambda c, v: all(v[f] > t if greater else v[f] <= t for f, greater, t in c)
    z = np.array([[float(holds(c, v)) for c in paths] for v in x])
    assert all(min(z[:, j].sum(), 400 - z[:, j].sum()) >= 0 for j in range(len(paths))) and len(set(paths)) == len(paths)
    weights, intercept = quality._lasso(z, y, quality.PENALTY, 4000)
    p = 1 / (1 + np.exp(-(z @ weights + intercept)))
    slope = z.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-4 and (np.abs(slope) < quality.PENALTY + 1e-4).all()
    assert np.allclose(slope[np.abs(weights) > 1e-6], -np.sign(weights[np.abs(weights) > 1e-6]) * quality.PENALTY, atol=1e-4)
    model = quality.fit(x, y)
    got = {r["doc_id"]: r["score"] for r in quality.scored(rows, model).collect()}
    for r, v in zip(table, x, strict=True):
        total = model.intercept + sum(w for c, w in model.rules if holds(c, v))
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-total))) < 1e-9
    assert quality.scored(rows.where("false"), quality.train(rows.where("false"), rows.where("false"), "quality")).count() == 0


def test_toxicity_models(spark):
    rows = labelled(spark, "toxic", 1200)
    train, test = rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0")
    docs = rows.select("doc_id", "text")
    fitted = toxicity.train(docs, train.select("doc_id", "toxic"))
    assert accuracy(toxicity.scored(test, fitted), test, "toxic") > 0.93
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "you vilefool " * 20_000), (None, "é")], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(odd, fitted).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[-3] > 0.5 and scores[-1] == scores[-2]
    empty = toxicity.train(docs, train.where("false"))
    assert {r["score"] for r in toxicity.scored(odd, empty).collect()} == {0.5}


def test_toxicity_counts_equal_brute_force(spark):
    from collections import Counter

    rows = spark.createDataFrame([(1, "Ab, ab", 1), (2, "ab ab", 0), (3, None, 0)], "doc_id bigint, text string, toxic int")
    expected = Counter()
    for text, toxic in ((" ab  ab ", 1), (" ab ab ", 0), ("  ", 0)):
        for i in range(len(text) - 5):
            expected[int.from_bytes(text[i : i + 6].encode(), "big"), toxic] += 1
    got = Counter()
    for r in toxicity.counts(rows).collect():
        got[r["run"], 1] += r["toxic"]
        got[r["run"], 0] += r["ordinary"]
    assert +got == expected


def brute_ratios(rows, text):
    """log P(toxic) - log P(ordinary) of each byte, from dicts over all rows (text, toxic)."""
    from collections import defaultdict

    fold = lambda t: bytes(b + 32 if 65 <= b < 91 else b if b > 127 or chr(b).isalnum() else 32 for b in f" {t} ".encode())
    tables = {(c, n): defaultdict(int) for c in (0, 1, "both") for n in range(1, 7)}
    for t, c in rows:
        b = fold(t)
        for i in range(len(b) - 5):
            tables[c, 6][b[i : i + 6]] += 1
            tables["both", 6][b[i : i + 6]] = 1
    for c in (0, 1, "both"):
        for n in range(5, 0, -1):
            for key in tables[c, n + 1]:
                tables[c, n][key[1:]] += 1

    def p(c, n, run):
        if n == 0:
            return 1 / 256
        table = tables["both" if n <= toxicity.SHARED else c, n]
        seen = [v for k, v in table.items() if k[:-1] == run[:-1]]
        below = p(c, n - 1, run[1:])
        return (max(table.get(run, 0) - 0.75, 0) + 0.75 * len(seen) * below) / sum(seen) if seen else below

    b = fold(text)
    return [math.log(p(1, 6, b[i : i + 6]) / p(0, 6, b[i : i + 6])) for i in range(len(b) - 5)]


def model_input(spark, where):
    texts = [("you vile fool", 1), ("go home, fool", 1), ("a vile thing", 1), ("the river and the stone", 0), ("a garden, a window", 0), ("good home", 0), ("Stone by stone", 0), ("the fool of the river", 0)]
    rows = spark.createDataFrame([(i, *texts[i % 8]) for i in range(24)], "doc_id bigint, text string, toxic int").where(where)
    return rows, [(r["text"], r["toxic"]) for r in rows.collect()]


def close(model, rows, texts):
    import numpy as np

    return all(np.allclose(model.ratios(next(toxicity.texts(pa.array([t])))), brute_ratios(rows, t), atol=1e-4) for t in texts)


UNSEEN = ["you vile fool", "the VILE river", "xyz qqq", "é fo"]


def test_toxicity_model_keeps_every_run(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 16, raising=False)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 50, raising=False)
    rows, local = model_input(spark, "pmod(xxhash64(doc_id), 1 << 20) >= 1 << 18")
    model, _ = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert close(model, local, UNSEEN)


def test_toxicity_counts_all_labelled_rows(spark, monkeypatch):
    rows, local = model_input(spark, "true")
    assert 0 < rows.where("pmod(xxhash64(doc_id), 1 << 20) < 1 << 18").count() < rows.count()
    for calibration in (toxicity.CALIBRATION, 2):
        monkeypatch.setattr(toxicity, "CALIBRATION", calibration)
        model, _ = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
        assert close(model, local, UNSEEN)


def test_known_runs_are_probabilities():
    import numpy as np

    rng = random.Random(2)
    text = np.frombuffer(bytes(rng.choice(b"abc ") for _ in range(4000)), np.uint8)
    run, count = np.unique(toxicity.runs(text), return_counts=True)
    shared = np.full(len(np.unique(run & 255)), 1 / 256)
    p, contexts, _ = toxicity._level(np.unique(run & 255), np.bincount(np.unique(run & 255, return_inverse=True)[1], count), shared)
    assert 0.97 < p.sum() <= 1.0 and len(contexts) == 1


PAGES = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (5, None, "same"), (3, "u", None), (4, "u", ""), (6, "u", "é" * 5000), (6, "u", "é" * 5000), (None, "u", "lone")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))


def archive(spark, tmp_path, least=0):
    folder = (tmp_path / "w").as_uri()
    return [(f"{folder}/{n}", s) for n, s in warc.write(warc.with_revisits(pages(spark), least).coalesce(1).sortWithinPartitions(F.col("page_id").asc_nulls_last()), folder)]


def test_warc_round_trip(spark, tmp_path):
    files = archive(spark, tmp_path)
    for size in (1 << 24, 700):
        got = sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.page_ids(warc.read(spark, files, range_bytes=size)).collect()), key=str)
        largest = {}
        for i, _, h in PAGES:
            if i is not None:
                largest[h or ""] = max(largest.get(h or "", i), i)
        expected = []
        for i, _, h in PAGES:
            b = (h or "").encode()
            refers = largest.get(h or "")
            refers = None if refers == i else refers
            expected.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", refers))
        assert got == sorted(expected, key=str)


def test_warc_least_bytes_and_empty(spark, tmp_path):
    records = warc.page_ids(warc.read(spark, archive(spark, tmp_path, least=5)))
    assert records.where("record_type = 'revisit'").count() == 0
    assert warc.write(warc.with_revisits(pages(spark).where("false")), (tmp_path / "n").as_uri()) == []
    assert warc.read(spark, []).count() == 0


def test_warc_salvage(spark, tmp_path):
    ((path, size),) = archive(spark, tmp_path)
    local = path.removeprefix("file://")
    rows = warc.read(spark, [(path, size)]).orderBy("offset").collect()
    data = bytearray(open(local, "rb").read())
    hit = rows[2]["offset"] + rows[2]["length"] // 2
    data[hit : hit + 4] = b"\0\0\0\0"
    damaged = os.path.join(os.path.dirname(local), "damaged.warc.gz")
    open(damaged, "wb").write(data)
    again = warc.read(spark, [(f"file://{damaged}", len(data))]).orderBy("offset").collect()
    assert [(r["offset"], r["length"], r["gap"] is not None) for r in again] == [(r["offset"], r["length"], i == 2) for i, r in enumerate(rows)]
    with pytest.raises(Exception, match="gap in"):
        warc.page_ids(warc.read(spark, [(f"file://{damaged}", len(data))])).collect()
    assert warc.page_ids(warc.read(spark, [(f"file://{damaged}", len(data))]), whole=False).count() == len(rows) - 1
    plain = b"junk\n" + warc.record(1, "u", b"one") + b"WARC/1.1\r\nbroken\r\n\r\n" + warc.record(2, "u", b"two")
    name = str(tmp_path / "p.warc")
    open(name, "wb").write(plain)
    got = warc.read(spark, [(name, len(plain))]).orderBy("offset").collect()
    assert [(r["record_id"], r["gap"] is None) for r in got] == [(None, False), ("urn:page:1", True), (None, False), ("urn:page:2", True)]
    assert sum(r["length"] for r in got) == len(plain)


def test_warc_long_headers(spark, tmp_path):
    plain = warc.record(1, "u" * 300_000, b"one") + warc.record(2, "u", b"two")
    name = str(tmp_path / "h.warc")
    open(name, "wb").write(plain)
    assert [(r["page_id"], r["payload_bytes"]) for r in warc.page_ids(warc.read(spark, [(name, len(plain))])).orderBy("page_id").collect()] == [(1, 3), (2, 3)]


TEXTS = [(1, "hello"), (2, "hello"), (3, None), (4, ""), (5, "é" * 3000), (6, "x" * 64), (None, "no id"), (7, "tail\0")]


def test_media_round_trip(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumn("media", F.lit("clash"))
    folder = (tmp_path / "m").as_uri()
    assert media.store(docs.repartition(2), folder) == len(TEXTS)
    monkeypatch.setattr(media, "STEP", 1024)
    for size in (1 << 24, 1500):
        got = {r["doc_id"]: r for r in media.features(media.read(spark, folder, size)).collect()}
        assert len(got) == len(TEXTS)
        for i, t in TEXTS:
            data = (t or "").encode()
            padded = data + bytes(-len(data) % 64) if data else bytes(64)
            r = got[i]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (got[1]["media_sha256"], got[1]["feature"]) == (got[2]["media_sha256"], got[2]["feature"])


def test_media_damage_and_empty(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS[:3], "doc_id bigint, text string")
    media.store(docs.coalesce(1), (tmp_path / "m").as_uri())
    (name,) = [n for n in os.listdir(tmp_path / "m") if n.endswith(".tar")]
    data = bytearray((tmp_path / "m" / name).read_bytes())
    data[0:4] = b"\xff\xff\xff\xff"
    (tmp_path / "m" / name).write_bytes(data)
    for listed in (True, False):
        found = media.read(spark, (tmp_path / "m").as_uri()).orderBy("offset").collect()
        assert [(r["name"], r["error"]) for r in found] == [(None, "damaged header"), ("2.png", None), ("3.png", None)]
        if listed:
            os.remove(tmp_path / "m" / f"{name}.starts")
    with pytest.raises(Exception, match="damaged header"):
        media.features(media.read(spark, (tmp_path / "m").as_uri())).collect()
    media.store(docs.where("false"), (tmp_path / "e").as_uri())
    assert media.read(spark, (tmp_path / "e").as_uri()).count() == 0
