"""The corpus pipeline: each stage works on all documents that the stage before it kept.

1. quality: a rule ensemble learned from ``labels`` rejects documents;
2. near duplicates: of documents linked by 5-word shingles with a similarity of 0.8 or more, the one with the smallest id stays;
3. decontamination: documents that hold at least half of a benchmark item, in any order of its parts, go;
4. personal data: spans are replaced by their kind;
5. encoding: byte-level BPE ids of what is left.

Rows that share an id count as one document. Documents with a null id are compared with nothing and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import bpe, decontaminate, jaccard, pii, quality, storage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more. One label in three is left out, by the id, to measure accuracy."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    model = quality.train(docs, learned, "quality")
    return quality.scored(docs, model).where("score >= 0.5").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    groups = jaccard.similarity_components(docs, k=5, num=80, den=100)
    kept = groups.where("component_id = doc_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item covers."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced."""
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of all documents."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each_group), ("decontamination", keep_clean), ("personal_data", redact), ("encoding", encode)]

#: Learned rules and byte-level BPE can't be written in SQL; tests compare the stages' operators with brute force, and what the stages
#: keep with what was planted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = storage.new_folder(spark, f"pipeline-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
