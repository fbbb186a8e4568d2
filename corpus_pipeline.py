"""Corpus pipeline: quality rules, near-dedup, decontamination, secrets, BPE.

Each stage is a function of (spark, docs, sf_dir) and works on all rows its
predecessor kept.  ``run`` writes every stage's rows as Parquet in the shared
folder and reads them again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huddle.llm import bpe, phrase_index, quality, queries, secrets, simhash
from huddle.llm.common import read_table, written

#: The stages count n-grams, hash text and encode BPE: SQL has no twin.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules reject go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.one_of_each(docs, queries.SHINGLE, queries.RADIUS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark phrase go."""
    return phrase_index.clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked."""
    return secrets.redact(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    return bpe.round_trip_digests(docs, bpe.vocabulary_path(bpe.WORD_VOCAB))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_round_trip", bpe_round_trip),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
