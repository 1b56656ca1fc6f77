"""Splits, quotas, weighted draws and schedules from hashes instead of generator state.

All randomness is a function of ``seed:label:id``, so results do not depend on partitioning,
order or retries. Positions come from hash-bucketed ranks: no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelane.functions.hashing import hash_bucket, hash_integer, hash_uniform, text_hash
from wavelane.functions.ordinals import attach_row, block, null_safe_join, ordinal, running_sum
from wavelane.operators.intervals import locate_rank
from wavelane.session import cut_lineage


def assign_split(group: Column, seed: int, ratios: dict[str, float]) -> Column:
    """Split of a group from its hash uniform and cumulative ratios (normalised, in order)."""
    total = sum(ratios.values())
    if total <= 0:
        raise ValueError("split ratios must have positive mass")
    point = hash_uniform(seed, group)
    names, upto, out = list(ratios), 0.0, None
    edges = []
    for name in names:
        upto += ratios[name] / total
        edges.append((name, upto))
    out = F.lit(names[-1])
    for name, edge in reversed(edges):
        out = F.when(point < edge, F.lit(name)).otherwise(out)
    return out


def is_inner_validation(track: Column, label: str = "gain-inner-v1", modulus: int = 5) -> Column:
    """Eight hex digits of ``label:track`` are 0 mod ``modulus``."""
    return hash_integer(text_hash(label, track), 8) % modulus == 0


def stratified_cap(df: DataFrame, strata: Sequence[str], row: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows: the hash-least row of every stratum, the rest by hash.

    Fails when ``n`` cannot hold one row per stratum. Adds ``mandatory``. Only rows below the hash
    bucket in which the n-th row lies, and the strata's own rows, are ranked.
    """
    h = text_hash(seed, F.col(row).cast("string"))
    hashed = df.withColumn("_h", h)
    first = hashed.groupBy(*strata).agg(F.min("_h").alias("_m"))
    size = first.agg(F.count(F.lit(1)).alias("_strata"))
    counts = hashed.groupBy(hash_bucket(F.col("_h")).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))  # one row a bucket
    upto = counts.select("_b", F.sum("_n").over(Window.orderBy("_b")).alias("_upto"))
    edge = upto.filter(F.col("_upto") >= n).agg(F.min("_b")).first()[0]
    below = F.lit(True) if edge is None else hash_bucket(F.col("_h")) <= edge
    own = null_safe_join(hashed.filter(~below), first.withColumnRenamed("_m", "_h"), [*strata, "_h"]).withColumn("mandatory", F.lit(True))
    low = null_safe_join(hashed.filter(below), first, list(strata)).withColumn("mandatory", F.col("_h") == F.col("_m")).drop("_m")
    flagged = low.unionByName(own)
    bucket = F.when(F.col("mandatory"), F.lit(-1)).otherwise(hash_bucket(F.col("_h")))
    ranked = ordinal(flagged, [], ["_h"], bucket, "_pos")
    ranked = attach_row(ranked, size)
    ok = F.when(F.col("_strata") <= n, F.col("_pos") <= n).otherwise(F.raise_error(F.lit("cap cannot preserve every stratum")).cast("boolean"))
    return ranked.filter(ok).drop("_h", "_pos", "_strata")


def weighted_mix(df: DataFrame, source: str, weight: str, ratios: dict[str, float]) -> DataFrame:
    """Row probability: normalised source ratio x share of the source's weight.

    Ratio-0 sources are left out; a source with a positive ratio and no rows fails the job.
    """
    positive = {k: v for k, v in ratios.items() if v > 0}
    total = sum(positive.values())
    ratio = F.create_map(*[x for k, v in positive.items() for x in (F.lit(k), F.lit(v / total))])
    sums = df.filter(F.col(source).isin(*positive)).groupBy(source).agg(F.sum(weight).alias("_s"))
    present = sums.agg(F.count(F.lit(1)).alias("_present"))
    checked = attach_row(sums, present).filter(
        F.when((F.col("_present") == len(positive)) & (F.col("_s") > 0), F.lit(True)).otherwise(F.raise_error(F.lit("missing positive source")).cast("boolean"))
    )
    return df.join(checked.drop("_present"), source).withColumn("probability", ratio[F.col(source)] * F.col(weight) / F.col("_s")).drop("_s")


def source_targets(df: DataFrame, source: str, budget: int, ratios: dict[str, float]) -> DataFrame:
    """``source, available, target``: round(budget * ratio) bounded by availability, at least 1."""
    total = sum(ratios.values())
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("available"))
    want = F.lit(None).cast("bigint")
    for k, v in ratios.items():
        want = F.when(F.col(source) == k, F.lit(int(round(budget * v / total)))).otherwise(want)
    return counts.withColumn("target", F.greatest(F.least("available", want), F.lit(1))).filter(want.isNotNull())


def take_per_source(df: DataFrame, source: str, row: str, targets: DataFrame, seed: int) -> DataFrame:
    """The ``target`` hash-least rows of each source."""
    hashed = df.withColumn("_h", text_hash(seed, F.col(source), F.col(row).cast("string")))
    ranked = ordinal(hashed, [source], ["_h"], hash_bucket(F.col("_h")), "_pos")
    return ranked.join(targets.select(source, "target"), source).filter(F.col("_pos") <= F.col("target")).drop("_h", "_pos", "target")


def proportional_rebalance(df: DataFrame, source: str, row: str, budget: int, ratios: dict[str, float], seed: int) -> DataFrame:
    """Hard rebalance to the ratios, limited by what each source has."""
    return take_per_source(df, source, row, source_targets(df, source, budget, ratios), seed)


def validation_quota(df: DataFrame, source: str, row: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """Exactly the quota of each source; a short source fails the job."""
    counts = df.filter(F.col(source).isin(*quotas)).groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    quota = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])[F.col(source)]
    targets = counts.withColumn("target", quota).filter(
        F.when(F.col("_n") >= F.col("target"), F.lit(True)).otherwise(F.raise_error(F.lit("quota exceeds available rows")).cast("boolean"))
    )
    return take_per_source(df, source, row, targets, seed)


def cumulative_cells(df: DataFrame, keys: Sequence[str], order: str, weight: str, bucket: Column, cells: int) -> DataFrame:
    """Each row's slice [lo, hi) of its key's weight axis, cut into ``cells`` equal cells."""
    cum = running_sum(df, list(keys), order, F.col(weight), "_hi", bucket)
    total = df.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    # The last row ends at the total whatever order the two sums were made in: ``_end`` keeps its slice closed.
    last = cum.groupBy(*keys).agg(F.max("_hi").alias("_top"))
    placed = null_safe_join(null_safe_join(cum, total, list(keys)), last, list(keys)).withColumn("_lo", F.col("_hi") - F.col(weight))
    placed = placed.withColumn("_end", (F.col("_hi") == F.col("_top")) & (F.col(weight) > 0)).drop("_top")
    a = F.floor(F.col("_lo") / F.col("_total") * cells)
    z = F.least(F.floor(F.col("_hi") / F.col("_total") * cells), F.lit(cells - 1))
    return placed.withColumn("_cell", F.explode(F.sequence(F.least(a, F.lit(cells - 1)), z)))


def weighted_draws(df: DataFrame, corpus: str, row: str, weight: str, length: str, ratios: dict[str, float], draws: int, seed: int, crop: int, bucket: Column, cells: int = 4096) -> DataFrame:
    """``draw, corpus, row, start, gain_db``: n draws with replacement.

    A draw takes a corpus by ratio, a row by weight, a uniform start and a gain in [-6, 3). Draws
    meet rows in an equi-join on (corpus, cell of the weight axis), so no corpus is one task. A
    corpus with a positive ratio and no weight fails the job: its draws could not be made.
    """
    wanted = [k for k, v in ratios.items() if v > 0]
    there = {r[0] for r in df.filter(F.col(corpus).isin(*wanted)).groupBy(corpus).agg(F.sum(weight).alias("w")).filter("w > 0").collect()}
    if set(wanted) - there:
        raise ValueError(f"no rows to draw from: {sorted(set(wanted) - there)}")
    total = sum(ratios.values())
    n = df.sparkSession.range(draws).withColumnRenamed("id", "draw")
    u = hash_uniform(seed, "corpus", F.col("draw"))
    names = list(ratios)
    pick, upto = F.lit(names[-1]), []
    acc = 0.0
    for k in names:
        acc += ratios[k] / total
        upto.append((k, acc))
    for k, edge in reversed(upto):
        pick = F.when(u < edge, F.lit(k)).otherwise(pick)
    n = n.withColumn(corpus, pick).withColumn("_u", hash_uniform(seed, "row", F.col("draw"))).withColumn("_cell", F.floor(F.col("_u") * cells))
    placed = cumulative_cells(df.select(corpus, row, weight, length), [corpus], row, weight, bucket, cells)
    hit = n.join(placed, [corpus, "_cell"]).filter((F.col("_u") * F.col("_total") >= F.col("_lo")) & ((F.col("_u") * F.col("_total") < F.col("_hi")) | F.col("_end")))
    span = F.greatest(F.lit(1), F.col(length) - crop + 1)
    return hit.select(
        "draw", corpus, row,
        F.floor(hash_uniform(seed, "start", F.col("draw")) * span).alias("start"),
        (F.lit(-6.0) + hash_uniform(seed, "gain", F.col("draw")) * 9.0).alias("gain_db"),
    )


def cycled_tracks(tracks: DataFrame, corpus: str, track: str, per_step: int, steps: int, seed: int) -> DataFrame:
    """``k, track``: a permutation of the tracks per cycle, refilled when used up.

    Draw d holds positions d*per_step .. d*per_step + per_step - 1. Where a draw crosses a cycle
    boundary, tracks it already holds are passed over at the head of the new cycle and stay next
    in line. Fails with fewer than 3*per_step tracks (then boundaries could interact).
    """
    n = tracks.count()
    if n < 3 * per_step:
        raise ValueError("insufficient eligible recordings")
    cycles = -(-per_step * steps // n)
    h = text_hash(seed, F.lit(corpus), F.col("cycle"), F.col(track).cast("string"))
    spread = tracks.select(track).withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles)))).withColumn("_h", h)
    ranked = ordinal(spread, ["cycle"], ["_h"], hash_bucket(F.col("_h")), "_pos").withColumn("_pos", F.col("_pos") - 1)
    if per_step > 1 and n % per_step:
        # The open draw's earlier part are the last (cycle*n mod per_step) rows of the cycle before.
        tail = ranked.filter(F.col("_pos") >= n - F.pmod((F.col("cycle") + 1) * n, F.lit(per_step))).select(
            track, (F.col("cycle") + 1).alias("cycle"), F.lit(True).alias("_clash")
        )
        free = F.pmod(-F.pmod(F.col("cycle") * n, F.lit(per_step)), F.lit(per_step))
        head = ranked.filter(F.col("_pos") < 2 * per_step)
        flagged = head.join(tail, [track, "cycle"], "left").withColumn("_clash", F.coalesce("_clash", F.lit(False)))
        fill = ordinal(flagged.filter(~F.col("_clash")), ["cycle"], ["_pos"], F.lit(0), "_fill").select(track, "cycle", "_fill")
        order = flagged.join(fill, [track, "cycle"], "left").withColumn(
            "_late", F.when(F.col("_fill") <= free, 0).otherwise(1)
        )
        moved = ordinal(order.drop("_fill"), ["cycle"], ["_late", "_pos"], F.lit(0), "_new").select(track, "cycle", (F.col("_new") - 1).alias("_pos"))
        ranked = ranked.filter(F.col("_pos") >= 2 * per_step).select(track, "cycle", "_pos").unionByName(moved)
    k = F.col("cycle") * n + F.col("_pos")
    return ranked.select(k.alias("k"), track).filter(F.col("k") < per_step * steps)


def balanced_schedule(rows: DataFrame, spans: DataFrame, pattern: dict[str, int], steps: int, seed: int, corpus: str = "corpus", track: str = "track_id", row: str = "row_id", weight: str = "sampling_weight") -> DataFrame:
    """``step, slot, corpus, track, row, start``: fixed corpus mix, distinct recordings per step.

    Rows need at least one legal span (``row, lo, hi`` inclusive starts). Within a recording the
    row is drawn by weight and the start uniformly over the row's legal starts.
    """
    spans = cut_lineage(spans)
    room = spans.groupBy(row).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("_room"))
    eligible = cut_lineage(rows.select(corpus, track, row, weight).join(room, row))
    out, slot0 = None, 0
    for name, count in pattern.items():
        part = eligible.filter(F.col(corpus) == name)
        order = cycled_tracks(part.select(track).distinct(), name, track, count, steps, seed)
        order = cut_lineage(order).withColumn("_u", hash_uniform(seed, name, "row", F.col("k")))
        drawn = part.join(order.select(track).distinct(), track)  # only recordings that are drawn are numbered
        cum = running_sum(drawn.select(track, row, weight, "_room"), [track], row, F.col(weight), "_hi", block(row))
        total = drawn.groupBy(track).agg(F.sum(weight).alias("_total"))
        pool = cum.join(total, track).withColumn("_lo", F.col("_hi") - F.col(weight))
        target = F.col("_u") * F.col("_total")
        hit = order.join(pool, track).filter((target >= F.col("_lo")) & (target < F.col("_hi")))
        picked = hit.select(
            F.floor(F.col("k") / count).alias("step"), (F.col("k") % count + slot0).alias("slot"), F.lit(name).alias(corpus), track, row,
            F.floor(hash_uniform(seed, name, "start", F.col("k")) * F.col("_room")).alias("rank"),
        )
        out = picked if out is None else out.unionByName(picked)
        slot0 += count
    return locate_rank(spans, [row], cut_lineage(out)).drop("rank")


def deterministic_segments(df: DataFrame, identity: Sequence[str], length: str, rate: str, count: int, seconds: tuple[float, float], seed: int) -> DataFrame:
    """``count`` seeded (start, length) segments per degradation row; empty sources yield none."""
    seg = df.filter(F.col(length) > 0).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    ident = [F.col(c).cast("string") for c in identity]
    duration = F.lit(seconds[0]) + hash_uniform(seed, "length", *ident, F.col("segment")) * (seconds[1] - seconds[0])
    size = F.least(F.col(length), F.greatest(F.lit(1), F.floor(duration * F.col(rate) + 0.5))).cast("bigint")
    sized = seg.withColumn("segment_length", size)
    start = F.floor(hash_uniform(seed, "start", *ident, F.col("segment")) * (F.col(length) - F.col("segment_length") + 1))
    return sized.withColumn("segment_start", start)


def epoch_augment(df: DataFrame, row: str, length: str, segment: int, seed: int, epoch: int) -> DataFrame:
    """Crop start, padding and gain of a row in one epoch."""
    r = F.col(row)
    start = F.when(
        F.col(length) > segment, F.floor(hash_uniform(seed, epoch, r, "crop") * (F.col(length) - segment + 1))
    ).otherwise(F.lit(0))
    gain = F.lit(-6.0) + hash_uniform(seed, epoch, r, "gain") * 9.0
    return df.select(row, start.cast("bigint").alias("start"), F.greatest(F.lit(0), F.lit(segment) - F.col(length)).alias("padding"), gain.alias("gain_db"))


def train_probe_specs(df: DataFrame, counts: dict[str, int], seed: int, crop: int) -> DataFrame:
    """k random recordings per corpus, one random row each, centred start."""
    train = df.filter((F.col("split") == "train") & ~F.col("held_out") & F.col("corpus").isin(*counts))
    rows = train.groupBy("corpus", "track_id").agg(
        F.min_by(F.struct("row_id", "length_samples"), text_hash(seed, "row", F.col("row_id").cast("string"))).alias("r")
    )
    hashed = rows.withColumn("_h", text_hash(seed, "track", F.col("track_id")))
    ranked = ordinal(hashed, ["corpus"], ["_h"], hash_bucket(F.col("_h")), "_pos")
    k = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(n))])[F.col("corpus")]
    start = F.greatest(F.lit(0), F.floor((F.col("r.length_samples") - crop) / 2))
    return ranked.filter(F.col("_pos") <= k).select("corpus", "track_id", F.col("r.row_id").alias("row_id"), start.cast("bigint").alias("start"))


def blind_trials(df: DataFrame, trial: str, condition: str, seed: int) -> DataFrame:
    """Random condition order and opaque ids: ``trial, opaque, condition`` is the key table.

    Listeners get only ``trial, opaque``; keep the mapping apart.
    """
    hashed = df.select(trial, condition).distinct().withColumn("_h", text_hash(seed, F.col(trial).cast("string"), F.col(condition).cast("string")))
    ranked = ordinal(hashed, [trial], ["_h"], hash_bucket(F.col("_h")), "_pos")
    return ranked.select(trial, F.lpad(F.col("_pos").cast("string"), 2, "0").alias("opaque"), condition)
