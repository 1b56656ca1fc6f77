"""Affine recurrences s = a s + b along an ordinal, as a two-level distributed scan of array arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.functions.ordinals import BLOCK


def compose(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps x -> a x + b composed from each row's group start up to the row, by doubling the reach."""
    at, reach = np.arange(len(a)), 1
    while reach < len(a):
        far = np.flatnonzero(at - reach >= start)
        if not len(far):
            break
        lower, upper = a[far - reach], b[far - reach]
        b = b.copy()
        b[far] += a[far] * upper
        a = a.copy()
        a[far] *= lower
        reach *= 2
    return a, b


def _running(batches, ids: list[str], a: str, b: str, emit: str):
    """Composed maps over sorted batches, restarting whenever the id columns change; a group may cross batches."""
    last, carried = None, (1.0, 0.0)
    for pdf in batches:
        if not len(pdf):
            continue
        codes = np.stack([pd.factorize(pdf[c])[0] for c in ids])
        new = np.ones(len(pdf), dtype=bool)
        new[1:] = (codes[:, 1:] != codes[:, :-1]).any(axis=0)
        ends = [tuple(None if pd.isna(v) else v for v in pdf[ids].iloc[k]) for k in (0, -1)]
        goes_on = ends[0] == last
        start = np.maximum.accumulate(np.where(new, np.arange(len(pdf)), 0))
        xs, ys = pdf[a].to_numpy(dtype=np.float64).copy(), pdf[b].to_numpy(dtype=np.float64).copy()
        first = carried if goes_on else (1.0, 0.0)
        xs[0], ys[0] = xs[0] * first[0], xs[0] * first[1] + ys[0]
        xs, ys = compose(xs, ys, start)
        last, carried = ends[1], (xs[-1], ys[-1])
        if emit == "before":
            before_x, before_y = np.concatenate([[1.0], xs[:-1]]), np.concatenate([[0.0], ys[:-1]])
            before_x[new], before_y[new] = 1.0, 0.0
            before_x[0], before_y[0] = first
            xs, ys = before_x, before_y
        pdf[a], pdf[b] = xs, ys
        yield pdf


def affine_scan(df: DataFrame, keys: list[str], ordinal: str, a: str, b: str, initial: float, name: str, rows: int = BLOCK) -> DataFrame:
    """``keys, ordinal, name``: the state after each row.

    Blocks of the ordinal compose their own maps in parallel, streaming through sorted
    partitions; one summary row per block is scanned per key for the carried state; a join
    applies it. A key of any length uses many tasks. Ordinals need only be unique and ordered.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    slim = df.select(*keys, ordinal, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_m")).withColumn(
        "_b", F.floor(F.col(ordinal) / rows).cast("bigint")
    )

    block_ids = [*keys, "_b"]

    def local(batches):
        return _running(batches, block_ids, "_a", "_m", "after")

    def carry(batches):
        for pdf in _running(batches, keys, "_ta", "_tm", "before"):
            pdf["_in"] = pdf["_ta"] * initial + pdf["_tm"]
            yield pdf[[*keys, "_b", "_in"]]

    schema = f"{head}, {ordinal} {types[ordinal]}, _a double, _m double, _b bigint"
    mapped = slim.repartition(*block_ids).sortWithinPartitions(*block_ids, ordinal).mapInPandas(local, schema)
    last = mapped.groupBy(*keys, "_b").agg(F.max_by(F.struct("_a", "_m"), ordinal).alias("_l"))
    ends = last.select(*keys, "_b", F.col("_l._a").alias("_ta"), F.col("_l._m").alias("_tm"))
    carried = ends.repartition(*keys).sortWithinPartitions(*block_ids).mapInPandas(carry, f"{head}, _b bigint, _in double")
    return mapped.join(carried, [*keys, "_b"]).select(*keys, ordinal, (F.col("_a") * F.col("_in") + F.col("_m")).alias(name))
