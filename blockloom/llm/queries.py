"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from blockloom.llm import bpe

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "token_ids")
    return bpe.digests(encoded, ranks, public_tokenizers.PATTERN)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from blockloom.llm import storage, token_store

    folder = storage.new_folder(spark, "tokens")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = token_store.encode(token_store.in_order(docs), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    shards = token_store.write(encoded, folder)
    return token_store.checksums(token_store.read(spark, folder, shards))


QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op3_token_store": op3_token_store}
ORACLE_SQL: dict[str, str] = {}


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import jaccard

    return jaccard.similarity_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


QUERIES["op5_jaccard_join"] = op5_jaccard_join


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import substring

    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=35)


QUERIES["op10_substring_dedup"] = op10_substring_dedup


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import storage, warc

    folder = storage.new_folder(spark, "warc")
    shards = warc.write(warc.with_revisits(_table(spark, sf_dir, "pages"), least_bytes=0), folder)
    return warc.page_ids(warc.read(spark, [(f"{folder}/{name}", size) for name, size in shards], with_payload=False))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import media, storage

    folder = storage.new_folder(spark, "media")
    media.store(_table(spark, sf_dir, "documents"), folder)
    return media.features(media.read(spark, folder))


QUERIES |= {"op6_warc": op6_warc, "op8_media_columns": op8_media_columns}


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import decontaminate

    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import pii

    return pii.findings(_table(spark, sf_dir, "documents"))


QUERIES |= {"op2_decontamination": op2_decontamination, "op4_pii": op4_pii}


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fitted = toxicity.train(docs, labels.where(_remainder(5) != 0))
    scores = toxicity.scored(docs, fitted)
    return scores.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES |= {"op9_toxicity": op9_toxicity}


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import quality

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(_remainder(3) != 1), "quality")
    scores = quality.scored(docs.select("doc_id", "text"), model)
    return scores.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES |= {"op7_quality_rules": op7_quality_rules}


# SQL for DuckDB of the operators that can be said in it, for whole results at small sizes: plain self-joins and recursion.
ORACLE_SQL["op5_jaccard_join"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.c >= 90 * (x.n + y.n - c.c)
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), components AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents JOIN components USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

ORACLE_SQL["op6_warc"] = r"""
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), codes AS (
    SELECT page_id, payload, [strpos('0123456789abcdef', hex[i]) - 1 FOR i IN range(1, 41)] AS h FROM payloads
), bits AS (
    SELECT page_id, payload, flatten([[(x // 8) % 2, (x // 4) % 2, (x // 2) % 2, x % 2] FOR x IN h]) AS b FROM codes
), digests AS (
    SELECT page_id, payload, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (16 * b[i] + 8 * b[i + 1] + 4 * b[i + 2] + 2 * b[i + 3] + b[i + 4] + 1)::BIGINT, 1) FOR i IN range(1, 161, 5)], '') AS digest FROM bits
), last AS (
    SELECT payload, max(page_id) AS response FROM payloads GROUP BY payload
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> response THEN response END AS refers_to
FROM digests JOIN last USING (payload)
"""

ORACLE_SQL["op10_substring_dedup"] = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM places
), repeated AS (
    SELECT s FROM windows GROUP BY s HAVING count(*) > 1
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN repeated USING (s)
), every AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM every ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""
