"""Registered queries of this subpackage: every operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelane.llm import backoff, debruijn, forest, merkle, mixing, multiset, notices, pages, pieces, pivots, quality, secret_scan, simple8b
from wavelane.llm.common import own_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "simple8b")
    simple8b.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return simple8b.read(spark, path)


@query
def op5_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.compare(table(spark, sf_dir, "documents"))


@query
def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scan(table(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).drop("text")


ORACLES["op7_quality_rules"] = quality.sql()


@query
def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


@query
def op9_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(table(spark, sf_dir, "documents"), backoff.seventh_held_out())


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.components(table(spark, sf_dir, "documents"))


@query
def op11_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.dedup(table(spark, sf_dir, "documents"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pivots.count_words(table(spark, sf_dir, "documents")).filter(F.col("n") >= pivots.TWICE)
    return pivots.variants(words)


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; documents whose id's crc32 divides by seven are tampered with."""
    docs = table(spark, sf_dir, "documents")
    return merkle.audit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


ORACLES["op13_merkle_manifest"] = merkle.sql()
