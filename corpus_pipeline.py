"""Corpus pipeline over `documents`: each stage's result is written as Parquet and read by the next.

Rows with a null doc_id take part in no comparison with others and stay (if their text
does); repeated rows are one document, so they all stay or all go. Ties go to the smaller
doc_id. An empty table gives no rows. Columns beyond those of documents pass through all
stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontam, jaccard, lines, pieces, rules
from tidewire.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the quality rules go; documents that the rules reject go, those with a null or empty text among them."""
    df = rules.keep_documents(docs)
    n_chars = F.when(F.col(rules.FAILED) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint").alias("n_chars")
    return df.select([n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one word edit of an earlier line go; a document without a word left goes too."""
    df = lines.dedup_lines(docs, Scratch(spark, "line_dedup"))
    changed = F.col(lines.REMOVED) > 0
    text = F.when(changed, F.array_join(lines.KEPT, "\n")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length(F.array_join(lines.KEPT, "\n"))).otherwise(F.col("n_chars")).cast("bigint")
    own = {"text": text.alias("text"), "n_chars": n_chars.alias("n_chars")}
    left = df.where(~changed | F.exists(lines.KEPT, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return left.select([own.get(c, F.col(f"`{c}`")) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    return jaccard.keep_one(docs, Scratch(spark, "near_duplicates"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.drop_leaks(docs, benchmark, Scratch(spark, "decontamination"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every remaining document."""
    return pieces.encode_documents(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL can't express subword encoding; tests/llm holds run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's rows are written before the next one reads them."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
