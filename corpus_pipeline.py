"""A corpus pipeline: quality filter, near-duplicate removal, benchmark decontamination, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm import decontaminate, jaccard, quality, secrets, tokens
from factmill.llm.store import fresh, materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents, with a score under 0.5, go. Labels of the held-out third are not learned from. Null and empty texts are scored by
    the bias alone; repeated rows share their fate; all columns stay as they are."""
    score = fresh(docs, "score")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return quality.score_quality(docs, model, out=score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets at least 0.8 alike stays: that of the smallest id. Documents without words all stay."""
    return jaccard.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, exact or edited, go. Null and empty texts, and items of fewer than three words, match nothing."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked. Null and empty texts stay as they are."""
    return secrets.redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens; null and empty texts are the end id alone."""
    return tokens.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_redaction),
    ("packing", packing),
]

#: No stage but the last two could be written in SQL; tests compare run() with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
