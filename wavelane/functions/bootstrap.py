"""Deterministic percentile bootstrap over pre-aggregated clusters.

A replicate takes each cluster a Poisson(1) number of times. That number is a function of the seed,
the replicate and the cluster's identity (32-bit mixing, which any engine reproduces), so clusters
need no positions, meet nothing and stay where they are: each task adds up its clusters' weighted
sums for all replicates at once, as arrays, and only those arrays are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.hashing import hash_integer, text_hash
from wavelane.functions.ordinals import null_safe_join

# Fixed value: multiplier of the xorshift-multiply mix; below 2^31, so products fit BIGINT.
MULTIPLIER = 73244475
WORD = 4294967296
#: A uniform 32-bit state at or above the k-th threshold stands for more than k copies of a cluster.
POISSON = [t for t in (math.floor(WORD * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(16)) if t < WORD - 1]
#: Clusters weighted at once, and sums that a task holds before it hands them on.
STEP, HELD = 256, 1 << 22


def mix(state: Column) -> Column:
    """Two xorshift-multiply rounds and a final xorshift on a value in [0, 2^32)."""
    x = state
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(MULTIPLIER)) % F.lit(WORD)
    return F.shiftright(x, 16).bitwiseXOR(x)


def label_seed(seed: int, *label: Column) -> Column:
    """32-bit seed of ``seed:label``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *label)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` on unsigned 32-bit integers, whose products wrap."""
    for _ in range(2):
        x = (x >> np.uint32(16) ^ x) * np.uint32(MULTIPLIER)
    return x >> np.uint32(16) ^ x


def weights(seed: int, spots: np.ndarray, replicates: int) -> np.ndarray:
    """Copies of each cluster (row) in each replicate (column)."""
    first = _mixed(np.array([seed], dtype=np.uint32))
    second = _mixed(first + np.arange(replicates, dtype=np.uint32))
    state = _mixed(spots.astype(np.uint32)[:, None] + second)
    out = np.zeros(state.shape, dtype=np.float32)
    for threshold in POISSON:
        out += state >= np.uint32(threshold)
    return out


def _fold(keys: list[str], values: list[str], replicates: int):
    """Rows to one row per key and task: for each value column, its weighted sums by replicate."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=keys)
            for i, name in enumerate(values):
                out[name] = [sums[i] for sums in held.values()]
            held.clear()
            return out

        for frame in frames:
            for (seed, *_), group in frame.groupby(["_seed", *keys], dropna=False, sort=False):
                key = tuple(group[keys].iloc[0])
                if key not in held:
                    held[key] = np.zeros((len(values), replicates))
                spots, numbers = group["_spot"].to_numpy(), group[values].to_numpy(dtype=np.float64)
                for low in range(0, len(spots), STEP):
                    held[key] += numbers[low : low + STEP].T @ weights(seed, spots[low : low + STEP], replicates)
                if len(held) * len(values) * replicates > HELD:
                    yield rows()
        if held:
            yield rows()

    return run


def percentile_ci(
    clusters: DataFrame,
    keys: list[str],
    cluster: list[str],
    sums: list[str],
    count: str,
    seed: int,
    replicates: int = 2000,
    confidence: float = 0.95,
    label: list[str] | None = None,
) -> DataFrame:
    """Interval of sum(sums)/sum(count) over resampled clusters, per key.

    ``clusters`` has one row per (keys, cluster). One resample of the clusters serves all ``sums`` of
    a key. ``label`` names the key columns that enter the seed (default: all of them), so keys
    outside ``label`` share their draws. A replicate without any cluster counts for nothing. A
    single cluster gives (mean, mean). Returns ``keys, clusters, <sum>_mean, <sum>_lo, <sum>_hi``.
    """
    label = keys if label is None else label
    tail = (1.0 - confidence) / 2.0
    types = {f.name: f.dataType.simpleString() for f in clusters.schema.fields}
    spot = hash_integer(text_hash(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cluster]), 8)
    names = [f"_v{i}" for i in range(len(sums) + 1)]
    drawn = clusters.select(
        *keys, label_seed(seed, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in label]).alias("_seed"), spot.alias("_spot"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip([*sums, count], names)],
    )
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], *[f"{n} array<double>" for n in names]])
    parts = drawn.mapInPandas(_fold(keys, names, replicates), schema)
    each = parts.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("_rep", "_s")).groupBy(*keys, "_rep").agg(*[F.sum(F.col("_s")[n]).alias(n) for n in names])
    some = each.filter(F.col(names[-1]) > 0)
    bounds = some.groupBy(*keys).agg(
        *[F.percentile(F.col(n) / F.col(names[-1]), F.array(F.lit(tail), F.lit(1 - tail))).alias(f"_q_{s}") for s, n in zip(sums, names)]
    )
    point = clusters.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clusters"),
        *[(F.sum(s) / F.sum(count)).alias(f"{s}_mean") for s in sums],
    )
    out = null_safe_join(point, bounds, keys)
    single = F.col("clusters") == 1
    for s in sums:
        for i, side in enumerate(("lo", "hi")):
            out = out.withColumn(f"{s}_{side}", F.when(single, F.col(f"{s}_mean")).otherwise(F.col(f"_q_{s}")[i]))
    return out.drop(*[f"_q_{s}" for s in sums])
