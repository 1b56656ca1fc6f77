"""Deterministic hashing: uniforms, row identities and order-free set digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(*parts) -> Column:
    """SHA-256 of the parts joined by ':' (lower-case hex)."""
    return F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def hash_integer(digest: Column, digits: int) -> Column:
    """Leading hex digits of a digest as BIGINT (at most 13, so a double holds it exactly)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1) from 52 bits of the hash of ``seed:...``; exact as a double."""
    return hash_integer(text_hash(*parts), 13).cast("double") / F.lit(float(2**52))


def hash_bucket(digest: Column, digits: int = 3) -> Column:
    """Monotone bucket of a hash-ordered column: equal shares whatever the data."""
    return hash_integer(digest, digits)


def row_digest(*columns: str, length: int = 24) -> Column:
    """Row identity: the first hex digits of the hash of the material string."""
    return F.substring(text_hash(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 1, length)


def set_hash(df: DataFrame, keys: list[str], member: Column, digits: int = 3) -> DataFrame:
    """Order-free digest of each key's distinct members, as ``(keys, members, set_hash)``.

    Members are digested in hash-prefix buckets first and the bucket digests second, so no task
    ever holds one key's whole member list. ``digits`` grows with the largest set (16^digits
    buckets). Null members are ignored; an empty key yields no row.
    """
    leaf = (
        df.select(*keys, F.sha2(member.cast("string"), 256).alias("_h"))
        .filter(F.col("_h").isNotNull())
        .distinct()
        .withColumn("_b", F.substring("_h", 1, digits))
    )
    level = leaf.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("_h"))), 256).alias("_d"),
    )
    return level.groupBy(*keys).agg(
        F.sum("_n").alias("members"),
        F.sha2(
            F.concat_ws(
                ",",
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda s: s["_d"]
                ),
            ),
            256,
        ).alias("set_hash"),
    )
