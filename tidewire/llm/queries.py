"""The driver's queries over this subpackage's operators, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, gam, jaccard, language, lines, negatives, pieces, repeats, rules, search, secrets, toxicity
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"), scratch=Scratch(spark, "op1"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op3")).drop("n_links")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(
        [(-1, 0, "user", chat.HARD), (-1, 1, "assistant", chat.HARD)], "conv_id bigint, turn bigint, role string, text string"
    )
    return chat.digests(chat.format_conversations(rows.unionByName(hard)))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op5"))
    return leaks.drop("hamming")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup_substrings(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gam.score_documents(docs, gam.fit(docs, table(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_report(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op12"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.quantised(table(spark, sf_dir, "embeddings"), label)
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, Scratch(spark, "op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_secret_scans,
        op2_toxicity,
        op3_ngram_jaccard_join,
        op4_chat_formatting,
        op5_benchmark_decontamination,
        op6_sentencepiece,
        op7_suffix_array_dedup,
        op8_quality_rules,
        op9_quality_classifier,
        op10_line_dedup,
        op11_language_id,
        op12_ranked_search,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in registered}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scans": secrets.ORACLE,
        "op3_ngram_jaccard_join": jaccard.ORACLE,
        "op4_chat_formatting": chat.ORACLE,
        "op5_benchmark_decontamination": decontam.ORACLE,
        "op8_quality_rules": rules.ORACLE,
        "op10_line_dedup": lines.ORACLE,
        "op12_ranked_search": search.ORACLE,
        "op13_hard_negatives": negatives.ORACLE,
    }
