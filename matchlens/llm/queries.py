"""The queries of the operators for training data, and their SQL where SQL can say them.

Each callable takes (spark, sf_dir) and applies one operator with its production
parameters to the whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm import fingerprint, jaccard, langid, mixing, packing, repetition, scoring, substring, toolcalls, urlfilter
from matchlens.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.format_conversations(table(spark, sf_dir, "conversations"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(*urlfilter.page_lists(table(spark, sf_dir, "pages").select("page_id", "url")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents").select("doc_id", "text"), jaccard.WORDS, jaccard.NUMERATOR, jaccard.DENOMINATOR)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.assess(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.dedup(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_lm_scoring, op2_language_id, op3_best_fit_packing, op4_chat_formatting, op5_url_filters,
        op6_ngram_jaccard, op7_document_fingerprints, op8_quality_rules, op9_substring_dedup, op10_mixing,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Tests hold the others against brute force; which documents the mix takes, and how many sequences
    a packing has, against their targets and bounds."""
    return {"op4_chat_formatting": toolcalls.SQL, "op5_url_filters": urlfilter.SQL}
