"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing, pieces.

``run`` applies ``STAGES`` to ``documents``; each stage's result is written as Parquet below the
shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavelane.llm import forest, mixing, pieces, quality, secret_scan
from wavelane.llm.common import own_path, table
from wavelane.llm.queries import vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return forest.keep_one(docs)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by their kind."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.repeat(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, checked to decode to its text."""
    return pieces.sample(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality", good), ("near-duplicates", distinct), ("secrets", safe), ("mix", mixed), ("pieces", encoded)]

#: The near-duplicate, mixing and piece stages are iterative or drawn; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = own_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
