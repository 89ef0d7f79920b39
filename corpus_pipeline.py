"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what the one before kept and is written as Parquet before the next reads it. All but the last
return the columns of ``documents``: quality rules and toxicity drop documents, near-duplicates keep one of each
group, personal data changes texts. The last one gives the pieces of all documents with their places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tuneledger.llm import minhash_dedup, packing, pii, quality, toxicity
from tuneledger.session import fresh_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet every threshold."""
    return quality.keep(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a model fitted on those that are left."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.keep(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    return minhash_dedup.keep_one(spark, docs, fresh_dir)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and what gives it away replaced in their texts."""
    return pii.sanitise(spark, docs, fresh_dir)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequences and offsets."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), fresh_dir)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("packing", pack_sequences),
]

#: Sketches, neighbours and packing are not SQL; the tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a data folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        folder = fresh_dir(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
