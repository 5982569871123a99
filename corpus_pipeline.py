"""The corpus pipeline: language, repeated lines, near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.llm import bagminhash, langid, linededup, packing, pii
from twinlake.llm.common import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language classifier rejects."""
    return langid.accepted(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of lines."""
    return linededup.line_dedup(docs).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near copies."""
    kept = bagminhash.near_duplicates(docs).where("is_first").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(F.col("_id")), "left_semi")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in place of each span of personal data."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences."""
    return packing.packed_documents(docs)


STAGES = [("language", language), ("line dedup", repeated_lines), ("near copies", near_copies), ("personal data", personal_data), ("packing", packed)]
#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
