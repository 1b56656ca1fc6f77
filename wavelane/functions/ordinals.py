"""Ranks, halos and running scans that split one hot key over many tasks.

Every function takes a *monotone bucket*: a Column that never decreases with the sort order
(an id divided by a block size, a hash prefix, a time block). Windows run inside
``(keys, bucket)``; only one small row per bucket is scanned per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def block(column: str | Column, rows: int = BLOCK) -> Column:
    """Bucket of a unique integer order column: at most ``rows`` rows each."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / F.lit(rows)).cast("bigint")


def ordinal(
    df: DataFrame,
    keys: list[str],
    order: list,
    bucket: Column,
    name: str = "ordinal",
    total: str | None = None,
) -> DataFrame:
    """1-based dense position of each row within its key, exact for any group size.

    Ties must be broken by ``order`` itself. ``total`` also adds the group's row count.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    tagged = df.withColumn("__b", bucket)
    inner = Window.partitionBy(*keys, "__b").orderBy(*order)
    ranked = tagged.withColumn("__r", F.row_number().over(inner))
    sizes = tagged.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    by_key = Window.partitionBy(*keys).orderBy("__b")
    offsets = sizes.select(
        *keys,
        "__b",
        (F.sum("__n").over(by_key) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
    )
    out = null_safe_join(ranked, offsets, [*keys, "__b"]).withColumn(name, F.col("__r") + F.col("__before"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__b", "__r", "__before", "__total")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys and keeps one copy of each key."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"_k_{k}"])
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how) if keys else attach_row(left, renamed)
    return joined.drop(*[f"_k_{k}" for k in keys])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a keyless aggregate: exactly one row, so it is safe to send everywhere."""
    return df.join(F.broadcast(one_row))


def with_halo(
    df: DataFrame, ordinal_column: str, before: int, rows: int = BLOCK, after: int = 0
) -> DataFrame:
    """Copy the last ``before`` rows of each block into the next one (and ``after`` rows back).

    Adds ``_block`` and ``_halo``. Windows partitioned by ``(keys, _block)`` then see the
    neighbours they need; drop ``_halo`` rows afterwards. Requires a dense ordinal and
    ``before, after <= rows``.
    """
    own = F.floor(F.col(ordinal_column) / rows).cast("bigint")
    offset = F.col(ordinal_column) - own * rows
    copies = [F.struct(own.alias("b"), F.lit(False).alias("h"))]
    none = F.lit(None).cast("struct<b:bigint,h:boolean>")
    if before:
        copies.append(
            F.when(offset >= rows - before, F.struct((own + 1).alias("b"), F.lit(True).alias("h"))).otherwise(none)
        )
    if after:
        copies.append(
            F.when((offset < after) & (own > 0), F.struct((own - 1).alias("b"), F.lit(True).alias("h"))).otherwise(none)
        )
    return (
        df.withColumn("__c", F.explode(F.array_compact(F.array(*copies))))
        .withColumn("_block", F.col("__c.b"))
        .withColumn("_halo", F.col("__c.h"))
        .drop("__c")
    )


def lagged(
    df: DataFrame, keys: list[str], ordinal_column: str, values: dict[str, str], rows: int = BLOCK
) -> DataFrame:
    """Previous row's values (``{source: new_name}``) along a dense ordinal, block by block."""
    w = Window.partitionBy(*keys, "_block").orderBy(ordinal_column)
    out = with_halo(df, ordinal_column, 1, rows)
    for source, name in values.items():
        out = out.withColumn(name, F.lag(source).over(w))
    return out.filter(~F.col("_halo")).drop("_block", "_halo")


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, bucket: Column
) -> DataFrame:
    """Inclusive running sum per key: in-block window plus the sum of the earlier blocks."""
    tagged = df.withColumn("__b", bucket).withColumn("__v", value)
    inner = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("__s", F.sum("__v").over(inner))
    totals = tagged.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    outer = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(outer), F.lit(0)).alias("__before"))
    return (
        null_safe_join(local, carried, [*keys, "__b"])
        .withColumn(name, F.col("__s") + F.col("__before"))
        .drop("__b", "__v", "__s", "__before")
    )


def running_extreme(
    df: DataFrame,
    keys: list[str],
    order: list,
    value: Column,
    name: str,
    bucket: Column,
    kind: str = "max",
    strict: bool = True,
) -> DataFrame:
    """Running max/min of the rows before this one (``strict``) or up to it, block by block."""
    fold = F.max if kind == "max" else F.min
    join2 = F.greatest if kind == "max" else F.least
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    tagged = df.withColumn("__b", bucket).withColumn("__v", value)
    inner = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if strict else 0
    )
    local = tagged.withColumn("__s", fold("__v").over(inner))
    totals = tagged.groupBy(*keys, "__b").agg(fold("__v").alias("__t"))
    outer = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__b", fold("__t").over(outer).alias("__before"))
    return (
        null_safe_join(local, carried, [*keys, "__b"])
        .withColumn(name, join2("__s", "__before"))
        .drop("__b", "__v", "__s", "__before")
    )
