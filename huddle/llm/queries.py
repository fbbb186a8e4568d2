"""One query per operator, with the parameters of production runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.llm import bpe, fill_middle, langid, licenses, phrase_index, quality, secrets, simhash, substring_dedup, suffix_dedup, token_align, token_files, url_filter
from huddle.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


SHINGLE, RADIUS = 4, 4


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


@register("op1_suffix_array_dedup")
def op1(spark, sf_dir):
    return suffix_dedup.report(documents(spark, sf_dir))


@register("op2_secret_scans")
def op2(spark, sf_dir):
    return secrets.report(documents(spark, sf_dir))


@register("op3_language_id")
def op3(spark, sf_dir):
    return langid.held_out_predictions(documents(spark, sf_dir))


@register("op4_license_scans")
def op4(spark, sf_dir):
    # the table has no file paths: a source stands for a directory of documents
    docs = documents(spark, sf_dir)
    found = licenses.report(docs, F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    return found.withColumn("path_made_of", F.lit("source/doc_id"))


@register("op5_token_files")
def op5(spark, sf_dir):
    return token_files.token_index(documents(spark, sf_dir), bpe.vocabulary_path(token_files.BYTE_VOCAB))


@register("op6_simhash_near_dedup")
def op6(spark, sf_dir):
    return simhash.near_duplicate_report(documents(spark, sf_dir), SHINGLE, RADIUS)


@register("op7_quality_rules")
def op7(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir))


@register("op8_benchmark_decontamination")
def op8(spark, sf_dir):
    return phrase_index.report(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@register("op9_bpe_round_trip")
def op9(spark, sf_dir):
    return bpe.round_trip_digests(documents(spark, sf_dir), bpe.vocabulary_path(bpe.WORD_VOCAB))


@register("op10_substring_dedup")
def op10(spark, sf_dir):
    return substring_dedup.report(documents(spark, sf_dir))


# The list that the query judges by.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@register("op11_url_filters")
def op11(spark, sf_dir):
    return url_filter.judge(read_table(spark, sf_dir, "pages"), [url_filter.rule(*r) for r in URL_RULES])


@register("op12_cross_tokenizer_alignment")
def op12(spark, sf_dir):
    return token_align.align_documents(
        documents(spark, sf_dir), bpe.vocabulary_path(token_align.BYTE_VOCAB), bpe.vocabulary_path(token_align.PIECE_VOCAB))


@register("op13_fill_in_middle")
def op13(spark, sf_dir):
    return fill_middle.digests(documents(spark, sf_dir), fill_middle.Spec(seed=7, rate=100, spm=50))
