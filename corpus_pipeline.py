"""Corpus pipeline: from `documents` to the token digests of what is worth training on.

Each stage takes what the one before it kept, written as Parquet and read again; all but the last return the columns of
`documents`. Stages call the operators of `geoseries.llm` as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geoseries.llm import byte_bpe, decontamination, exact_dedup, near_dedup, quality
from geoseries.llm.common import learnable, small_batches, staged, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), learnable("doc_id", 3, 1))
    return quality.keep_good(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return near_dedup.drop_near_copies(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.flag_documents(docs, table(spark, sf_dir, "benchmark"), keep=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of encoding and decoding each document."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _bounded(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality", _bounded(good_quality)),
    ("exact dedup", _bounded(without_copies)),
    ("near dedup", _bounded(without_near_copies)),
    ("decontamination", _bounded(without_benchmark)),
    ("byte BPE", _bounded(tokens)),
]

#: The quality model and the near-duplicate components have no SQL; tests/llm/test_pipeline.py runs each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
