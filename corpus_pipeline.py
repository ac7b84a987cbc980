"""A corpus from documents to tokens: each stage works on all that the one before has kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, all but the last with the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarframe.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dedup
from sonarframe.llm.shared import fresh, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages that the corpus itself names."""
    trees = language_id.train(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return language_id.identify(rows, trees, "row").where(language_id.accepted()).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats, but for two edits at most; copies of which nothing is left go."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.

    The row of the least doc_id stays, one without a doc_id only where there is no other.  Where a doc_id is repeated or
    null, the rows get numbers of their own, so each is judged by its own text: of rows alike one stays, and a row that
    shares its doc_id with a copy is no copy for that.
    """
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if often.isEmpty():
        copies = near_dedup.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(copies, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    row, own = fresh("row", docs.columns), fresh("own", docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias("_group"))
    first = F.min(F.struct(F.col(own).isNull(), own, row)).alias("_first")
    kept = groups.join(rows.select(row, F.col("doc_id").alias(own)), row).groupBy("_group").agg(first).select(F.col(f"_first.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(F.struct("*").alias("row"), "text")
    return decontaminate.contamination(rows, items, "row").where("not contaminated").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding gives the text back."""
    return byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("byte_bpe", tokens),
]

#: The near-duplicate, language and token stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
