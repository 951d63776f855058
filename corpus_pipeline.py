"""A corpus pipeline in stages: quality rules, near-dedup, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last
return the columns of `documents`. `run` writes each stage's result as Parquet in the shared scratch folder and
rereads it for the next.

Defined results, for all stages: whole texts are read, however long; a repeated row is treated each time like the first one; other columns of
`docs`, whatever their names, pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontam, minhash, pii, quality, sptok
from assayer.llm.common import scratch, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts do not, and rows without an id are judged like others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows without an id, and null and empty texts, stay.

    Copies of one row (same id) stay together.
    """
    return minhash.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and without items all stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text. Null texts stay null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: none for null and empty texts."""
    return sptok.encode(docs).select("doc_id", "ids", "n_tokens", "ids_crc32")


STAGES = [("quality_rules", good), ("near_dedup", distinct), ("decontamination", unseen), ("pii", private), ("sentencepiece", tokens)]

#: Hashed statistics, MinHash and alignment have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
