"""Exact quantiles per group without gathering a group in one task.

Values fall into monotone buckets (octave parts, refined by the linear position between the
group's extremes). A histogram of the buckets, combined map-side, locates each wanted rank; only
the rows of buckets that hold one are shuffled, with equal values counted first, and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelane.functions.ordinals import null_safe_join


def value_bucket(value: Column, low: Column, high: Column) -> Column:
    """Monotone BIGINT bucket of a finite double within [low, high]."""
    octave = F.when(value == 0, F.lit(0)).otherwise(
        F.signum(value) * (F.floor(F.log2(F.abs(value)) * 8) + 10000)
    )
    linear = F.when(high > low, F.floor((value - low) / (high - low) * 4095)).otherwise(F.lit(0))
    return (octave * 4096 + linear).cast("bigint")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], method: str = "linear"
) -> DataFrame:
    """Rows ``(keys, p, value)``.

    ``linear`` interpolates at (n-1)p, ``nearest`` takes rank ceil(n p). Nulls are dropped;
    a group without values yields no row. Values must be finite.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    spread = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    bucket = value_bucket(F.col("_v"), F.col("_lo"), F.col("_hi"))
    placed = null_safe_join(rows, spread, keys).select(*keys, "_v", "_n", bucket.alias("_b"))
    heads = placed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m"), F.max("_n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    wanted = []
    for p in probs:
        if method == "linear":
            at = (F.col("_n") - 1) * F.lit(float(p))
            wanted += [
                F.struct(F.lit(float(p)).alias("p"), F.floor(at).alias("r"), F.lit(0).alias("side")),
                F.struct(F.lit(float(p)).alias("p"), F.ceil(at).alias("r"), F.lit(1).alias("side")),
            ]
        else:
            at = F.greatest(F.ceil(F.col("_n") * F.lit(float(p))), F.lit(1)) - 1
            wanted += [
                F.struct(F.lit(float(p)).alias("p"), at.cast("bigint").alias("r"), F.lit(s).alias("side"))
                for s in (0, 1)
            ]
    hits = heads.withColumn(
        "_want",
        F.filter(
            F.array(*wanted),
            lambda w: (w["r"] >= F.col("_before")) & (w["r"] < F.col("_before") + F.col("_m")),
        ),
    ).filter(F.size("_want") > 0)
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    near = null_safe_join(placed.drop("_n"), hits.select(*keys, "_b"), [*keys, "_b"]).groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = null_safe_join(near, hits.select(*keys, "_b", "_before", "_n", "_want"), [*keys, "_b"])
    ranked = ranked.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    found = ranked.withColumn("_w", F.explode("_want")).filter(
        (F.col("_w.r") < F.col("_upto")) & (F.col("_w.r") >= F.col("_upto") - F.col("_c"))
    )
    sides = found.groupBy(*keys, F.col("_w.p").alias("p")).agg(
        F.max("_n").alias("_n"),
        F.max(F.when(F.col("_w.side") == 0, F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_w.side") == 1, F.col("_v"))).alias("_z"),
    )
    at = (F.col("_n") - 1) * F.col("p")
    exact = F.col("_a") + (F.col("_z") - F.col("_a")) * (at - F.floor(at))
    return sides.select(*keys, "p", (exact if method == "linear" else F.col("_a")).alias("value"))


def quantile_columns(
    df: DataFrame, keys: list[str], value: str, names: dict[str, float], method: str = "linear"
) -> DataFrame:
    """One row per group with a named column per probability."""
    long = exact_quantiles(df, keys, value, sorted(set(names.values())), method)
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(n) for n, p in names.items()]
    )
