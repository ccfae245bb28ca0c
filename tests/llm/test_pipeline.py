"""The pipeline's stages, each on the rows that the stage before it kept."""

import random

import __spark_entry__
import corpus_pipeline

from blockloom.llm import quality


def tables(spark, folder):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "ten", "vo") for b in ("ka", "ri", "sun", "tel", "da")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = " ".join(f"q{i}" for i in range(30))
    # Both classes have texts of all lengths, so that only capitals and symbols tell junk.
    size = lambda: rng.randrange(45, 110)
    docs = [(i, text(size())) for i in range(40)] + [(40 + i, " ".join(w.upper() + "!!" for w in text(size()).split())) for i in range(20)]
    docs += [(60, docs[3][1] + " end"), (61, docs[4][1]), (62, text(40) + " " + item), (63, text(50) + " mail a@b.co now"), (64, None)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 40 <= i < 60), 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_ROWS", 4)
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not set(range(40, 60)) & set(kept["quality"]) and set(range(40)) <= set(kept["quality"])
    assert set(kept["quality"]) - set(kept["near_duplicates"]) == {60, 61}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {62}
    assert kept["personal_data"][63]["text"].endswith("mail [EMAIL] now") and kept["personal_data"][63]["n_chars"] == len(kept["personal_data"][63]["text"])
    assert set(kept["encoding"]) == set(kept["personal_data"])
    whole = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r["token_ids"] for i, r in kept["encoding"].items()}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
