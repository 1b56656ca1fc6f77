"""User extension points: scorers, degradations, mergeable aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from wavelane.functions.ordinals import BLOCK


def score_frames(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: str = "frame", size: int = 1024) -> DataFrame:
    """Run a user scorer on aligned pairs in bounded groups of ``size`` frames per key.

    ``fn`` sees up to ``size`` consecutive frames and returns rows of ``schema``.
    """
    return df.withColumn("_g", F.floor(F.col(batch) / size)).groupBy(*keys, "_g").applyInPandas(lambda pdf: fn(pdf.drop(columns="_g")), schema)


def degrade(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user degradation to Arrow batches; narrow, no shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``count, mean, variance`` from mergeable partials (built-in, combined map-side)."""
    return df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def run_partials(df: DataFrame, keys: list[str], ordinal: str, flag: str, rows: int = BLOCK) -> DataFrame:
    """Mergeable run state per block: ``length, prefix, suffix, best`` of consecutive true rows."""
    b = df.withColumn("block", F.floor(F.col(ordinal) / rows))
    w = Window.partitionBy(*keys, "block").orderBy(ordinal)
    gap = F.max(F.when(~F.col(flag), F.col(ordinal))).over(w)
    first = F.min(ordinal).over(Window.partitionBy(*keys, "block"))
    runs = b.withColumn("_run", F.when(F.col(flag), F.col(ordinal) - F.coalesce(gap, first - 1)).otherwise(0)).withColumn("_all", gap.isNull())
    return runs.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("length"), F.max(F.when(F.col("_all"), F.col("_run")).otherwise(0)).alias("prefix"),
        F.max_by("_run", ordinal).alias("suffix"), F.max("_run").alias("best"),
    )


def merge_runs(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Longest run from block partials: a run may span any number of full blocks."""
    w = Window.partitionBy(*keys).orderBy("block")
    # Full blocks extend the open suffix; other blocks restart it.
    c = partials.withColumn("_end", F.sum("length").over(w)).withColumn("_full", F.col("suffix") == F.col("length"))
    c = c.withColumn("_start", F.when(~F.col("_full"), F.col("_end") - F.col("suffix")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.last("_start", ignorenulls=True).over(before), F.lit(0))
    joined = F.col("_end") - F.col("length") - opened + F.col("prefix")
    return c.withColumn("_j", F.greatest(joined, F.col("best"))).groupBy(*keys).agg(F.max("_j").alias("longest"))


@udtf(returnType="frame int, samples array<double>")
class Frames:
    """``frames(samples, n, hop)``: complete overlapping frames of one array."""

    def eval(self, samples, n: int, hop: int):
        for k in range(0, len(samples) - n + 1, hop):
            yield k // hop, [float(v) for v in samples[k : k + n]]


@udtf(returnType="start bigint")
class Spans:
    """``spans(lo, hi)``: the integers of an inclusive span."""

    def eval(self, lo: int, hi: int):
        for v in range(lo, hi + 1):
            yield (v,)


def register_table_functions(spark: SparkSession) -> None:
    """Make ``frames`` and ``spans`` available in SQL."""
    spark.udtf.register("frames", Frames)
    spark.udtf.register("spans", Spans)
