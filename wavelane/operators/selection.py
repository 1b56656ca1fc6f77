"""Orders, top rows, spaced samples, nested subsets and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelane.functions.hashing import hash_bucket, text_hash
from wavelane.functions.ordinals import null_safe_join, ordinal
from wavelane.functions.quantiles import value_bucket


def canonical_order(df: DataFrame, *keys: str) -> DataFrame:
    """Range-partitioned global order, so a report never depends on the workers."""
    return df.orderBy(*keys)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The least row of each key by ``order``; combines map-side, no window on the key."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_r"))
    return picked.select(*keys, "_r.*")


def first_per_track(df: DataFrame, corpus: str, track: str, row: str, limit: int, bucket: Column) -> DataFrame:
    """Least row id per track, then at most ``limit`` tracks per corpus in row-id order."""
    first = df.groupBy(corpus, track).agg(F.min(row).alias(row))
    return ordinal(first, [corpus], [row], bucket, "position").filter(F.col("position") <= limit)


def median_case(df: DataFrame, keys: Sequence[str], score: str, row: str) -> DataFrame:
    """The middle row by score (position n div 2, 0-based; ties by row) of each key."""
    spread = df.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    placed = null_safe_join(df, spread, list(keys))
    ranked = ordinal(placed, list(keys), [score, row], value_bucket(F.col(score), F.col("_lo"), F.col("_hi")), "_pos", total="_n")
    return ranked.filter(F.col("_pos") - 1 == F.floor(F.col("_n") / 2)).drop("_lo", "_hi", "_pos", "_n")


def argmin_choice(df: DataFrame, keys: Sequence[str], choice: str, error: str) -> DataFrame:
    """The choice with the least error per key (ties: smaller choice)."""
    return df.groupBy(*keys).agg(F.min(F.struct(error, choice)).alias("_m")).select(*keys, F.col(f"_m.{choice}").alias(choice), F.col(f"_m.{error}").alias(error))


def spaced_sample(df: DataFrame, keys: Sequence[str], order: str, k: int, bucket: Column) -> DataFrame:
    """Rows at positions i (n-1) div (k-1), i = 0..k-1, of the ordered group."""
    ranked = ordinal(df, list(keys), [order], bucket, "_pos", total="_n").withColumn("_ix", F.col("_pos") - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i.cast("bigint") * (F.col("_n") - 1) / (k - 1)))
    return ranked.filter(F.array_contains(wanted, F.col("_ix"))).drop("_pos", "_n", "_ix")


def nested_subsets(df: DataFrame, corpus: str, row: str, sizes: Sequence[int], mix: dict[str, tuple[int, int]], bucket: Column) -> DataFrame:
    """Prefix-nested subsets with a fixed corpus mix: ``size, corpus, row``.

    ``mix`` maps a corpus to (numerator, denominator) of each size.
    """
    ranked = ordinal(df.select(corpus, row), [corpus], [row], bucket, "position")
    want = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(c).alias("c"), F.lit(s * a // b).alias("k")) for s in sizes for c, (a, b) in mix.items()])
    keep = F.filter(want, lambda w: (w["c"] == F.col(corpus)) & (w["k"] >= F.col("position")))
    return ranked.select(F.explode(keep).alias("w"), corpus, row).select("w.size", corpus, row)


def expected_minus_actual(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Required members that were not observed (distinct)."""
    return expected.subtract(actual)


def superset_check(small: DataFrame, wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows, missing``: members of the small bank absent from the wide bank."""
    s, w = small.select(*columns).distinct(), wide.select(*columns).distinct().withColumn("_in", F.lit(True))
    return s.join(w, list(columns), "left").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_in").isNull(), 1)).alias("missing"))


def merge_catalogs(catalogs: Sequence[DataFrame]) -> DataFrame:
    """Concatenate catalogs of different widths; absent fields are NULL."""
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def common_metrics(df: DataFrame, keys: Sequence[str], row: str, metric: str) -> DataFrame:
    """Metric names present on every row of a key."""
    held = df.groupBy(*keys, row).agg(F.collect_set(metric).alias("_m"), F.max(F.col(metric).isNull()).alias("_none"))
    named = F.transform("_m", lambda m: F.struct(m.alias("m"), F.lit(False).alias("all")))
    none = F.lit(None).cast(df.schema[metric].dataType)
    # Beside its names a row gives one entry that counts it, and one for a null name.
    entries = F.concat(named, F.array(F.struct(none.alias("m"), F.lit(True).alias("all"))), F.when(F.col("_none"), F.array(F.struct(none.alias("m"), F.lit(False).alias("all")))).otherwise(F.array()))
    counts = held.filter(F.col(row).isNotNull()).select(*keys, F.explode(entries).alias("_e")).groupBy(*keys, "_e").agg(F.count(F.lit(1)).alias("rows"))
    whole = F.max(F.when(F.col("_e.all"), F.col("rows"))).over(Window.partitionBy(*keys))
    return counts.withColumn("_n", whole).filter(~F.col("_e.all") & (F.col("rows") == F.col("_n"))).select(*keys, F.col("_e.m").alias(metric), "rows")


def hash_pick(df: DataFrame, keys: Sequence[str], distinct: str, row: str, seed: str, k: int) -> DataFrame:
    """Per key in hash order: the first row of each distinct value, keeping ``k`` values.

    The first row per value combines map-side; a key then has one row per value.
    """
    h = text_hash(seed, F.col(row).cast("string"))
    first = df.groupBy(*keys, distinct).agg(F.min(F.struct(h.alias("h"), F.col(row).alias("r"))).alias("m"))
    ranked = ordinal(first, list(keys), ["m.h"], hash_bucket(F.col("m.h"), 1), "pick")
    return ranked.filter(F.col("pick") <= k).select(*keys, distinct, F.col("m.r").alias(row), "pick")
