"""A corpus pipeline over documents: each stage is one operator of quern.llm, written as Parquet and reread.

Every stage works on all rows that the stage before it kept, and all but the
last return the columns of documents, extra ones too, whatever their names.

Defined results: null texts, empty ones and texts without a letter go in the first stage. Repeated rows of a document stay or go together. A null
doc_id counts like any other id; near-duplicate groups keep the smallest id that isn't null, and all its rows (a group without one keeps the null).
Very long texts are worked on whole. Of equal texts the smallest doc_id stays; nothing else depends on ties. Empty tables give an empty result. A null n_chars stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, langid, neardup, secretscan
from quern.llm.store import read_table, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    return langid.with_language(docs, langid.learn_from_folds(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the smallest doc_id."""
    keep = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("keep_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["keep_id"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in text by a mark; n_chars follows."""
    return secretscan.redacted(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document left."""
    return bpe.byte_bpe(docs, outputs=("ids",))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("byte_bpe", byte_bpe)]
#: The language and near-duplicate stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
