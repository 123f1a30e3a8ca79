"""Corpus pipeline: quality classifier, exact dedup, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a
frame; run() writes each result as Parquet and hands it on read back. All but the last return the
columns of documents, as they came, except for text (and n_chars) where secrets were masked.

Defined results. The classifier drops what it scores below 0.5; a null or empty text is scored
like any other. Without labels it keeps everything. Of equal texts the row with the largest doc_id
stays, of each group of near copies (five-word shingles, similarity 0.8 or more) the one with the
least. Rows with a null doc_id are kept by the near-dedup stage. An empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, near_dedup, packing, quality, secret_scan
from tidemark.llm.common import free, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.train(docs.select("doc_id", "text"), labels, quality.trainable_ids())
    score = free("__score", docs.columns)
    return quality.score(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs, exact_dedup.DigestIndex(spark, expected_rows=docs.count()))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near-dedup", near_stage),
    ("secret scan", secret_stage),
    ("packing", packing_stage),
]

#: The classifier, the secrets' masks and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
