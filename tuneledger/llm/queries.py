"""Registered corpus queries with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tuneledger.llm import bpe_stream, conversation_repair, embedding_dedup, language_id, lm_score, minhash_dedup, packing, pii, quality, resampling, token_store, toxicity, warc
from tuneledger.session import fresh_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_store.store_and_read(
        spark, table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), fresh_dir)
    return rows.withColumnRenamed("key", "doc_id")


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.classes(spark, table(spark, folder, "embeddings"), fresh_dir)


def op3_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.classes(spark, table(spark, folder, "documents"), fresh_dir, percent=85)


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(spark, table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), fresh_dir)


def op5_bpe_stream(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_stream.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(spark, table(spark, folder, "pages"), fresh_dir).drop("url", "payload")


OP6_SQL = """
WITH pages_read AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM pages_read),
best AS (SELECT payload_bytes, payload_digest, max(page_id) AS largest FROM sized WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT s.page_id, s.payload_bytes::BIGINT AS payload_bytes, s.payload_digest,
    CASE WHEN b.largest <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN b.largest <> s.page_id THEN b.largest END AS refers_to
FROM sized s LEFT JOIN best b USING (payload_bytes, payload_digest)"""


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(spark, table(spark, folder, "documents"), fresh_dir)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The measures that no contract names are read by rules only."""
    return quality.judge(table(spark, folder, "documents")).drop(
        "n_exclamations", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(spark, table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_dir)


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.identify(docs, language_id.fit(spark, docs.where(~language_id.held_out()), fresh_dir))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"), fresh_dir)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, folder, "conversations")))


def queries() -> dict[str, Query]:
    return {"op1_token_store": op1_token_store, "op2_embedding_dedup": op2_embedding_dedup, "op3_minhash_dedup": op3_minhash_dedup, "op4_packing": op4_packing, "op5_bpe_stream": op5_bpe_stream,
            "op6_warc": op6_warc, "op7_pii": op7_pii, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality,
            "op10_lm_score": op10_lm_score, "op11_language_id": op11_language_id, "op12_importance_resampling": op12_importance_resampling,
            "op13_conversation_repair": op13_conversation_repair, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op9_quality": quality.sql(), "op12_importance_resampling": resampling.sql(),
            "op13_conversation_repair": conversation_repair.sql()}
