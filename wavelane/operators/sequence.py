"""Window and sequence operators over dense ordinals (samples, frames, hops).

Windows run inside blocks of the ordinal. Fixed look-back uses a copied halo; unbounded
look-back uses one carried row per block. A track of any length spreads over many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelane.functions.numeric import clamp
from wavelane.functions.ordinals import BLOCK, block, lagged, null_safe_join, running_extreme, running_sum, with_halo
from wavelane.functions.scans import affine_scan


def longest_run(df: DataFrame, keys: list[str], ordinal: str, flag: Column) -> DataFrame:
    """``keys, longest``: the longest run of consecutive true rows (0 when none)."""
    tagged = df.select(*keys, ordinal, F.coalesce(flag, F.lit(False)).alias("_f"))
    gaps = running_extreme(tagged, keys, [ordinal], F.when(~F.col("_f"), F.col(ordinal)), "_gap", block(ordinal))
    first = tagged.groupBy(*keys).agg((F.min(ordinal) - 1).alias("_start"))
    placed = null_safe_join(gaps, first, keys)
    length = F.when(F.col("_f"), F.col(ordinal) - F.coalesce("_gap", "_start")).otherwise(0)
    return placed.groupBy(*keys).agg(F.max(length).alias("longest"))


def consecutive_misses(df: DataFrame, keys: list[str], seq: str, missed: Column, startup: int = 2) -> DataFrame:
    """Longest miss streak, not counting the start-up hops."""
    return longest_run(burn_in(df, seq, startup), keys, seq, missed)


def hangover(df: DataFrame, keys: list[str], ordinal: str, trigger: Column, silent: Column, n: int) -> DataFrame:
    """Adds ``active``: a trigger now or in the last ``n`` rows, with no silence since.

    A silent row is never active and forgets earlier triggers. NULL flags count as false.
    """
    t, s = F.coalesce(trigger, F.lit(False)), F.coalesce(silent, F.lit(False))
    back = Window.partitionBy(*keys, "_block").orderBy(ordinal).rowsBetween(-n, 0)
    out = with_halo(df.withColumn("_s", s).withColumn("_t", t & ~s), ordinal, n)
    out = out.withColumn("_lt", F.max(F.when(F.col("_t"), F.col(ordinal))).over(back)).withColumn(
        "_ls", F.max(F.when(F.col("_s"), F.col(ordinal))).over(back)
    )
    active = F.col("_lt").isNotNull() & (F.col("_lt") > F.coalesce("_ls", F.lit(-1))) & ~F.col("_s")
    return out.withColumn("active", active).filter(~F.col("_halo")).drop("_block", "_halo", "_s", "_t", "_lt", "_ls")


def ema(df: DataFrame, keys: list[str], ordinal: str, value: str, alpha: float, silent: Column | None = None, name: str = "smoothed") -> DataFrame:
    """Exponential smoothing: ``keys, ordinal, name``. A zero state is seeded by the next value.

    Silent rows reset the state and give 0. Seeding is decided relationally (no non-zero value
    since the last reset), so the recurrence is affine and scans in parallel.
    """
    s = F.lit(False) if silent is None else F.coalesce(silent, F.lit(False))
    tagged = df.select(*keys, ordinal, F.col(value).alias("_x"), s.alias("_s"))
    bucket = block(ordinal)
    seen = running_extreme(tagged, keys, [ordinal], F.when(~F.col("_s") & (F.col("_x") != 0), F.col(ordinal)), "_lx", bucket)
    if silent is not None:
        seen = running_extreme(seen, keys, [ordinal], F.when(F.col("_s"), F.col(ordinal)), "_ls", bucket)
    else:
        seen = seen.withColumn("_ls", F.lit(None).cast("bigint"))
    seed = F.col("_lx").isNull() | (F.coalesce("_ls", F.lit(-1)) > F.col("_lx"))
    a = F.when(F.col("_s") | seed, 0.0).otherwise(1 - alpha)
    b = F.when(F.col("_s"), 0.0).when(seed, F.col("_x")).otherwise(alpha * F.col("_x"))
    return affine_scan(seen.withColumn("_aa", a).withColumn("_bb", b), keys, ordinal, "_aa", "_bb", 0.0, name)


def virtual_backlog(df: DataFrame, keys: list[str], seq: str, service: str, period: tuple[int, int]) -> DataFrame:
    """Replay service times on a fixed clock: ``keys, seq, backlog`` in service units x period[1].

    ``period`` is the exact ratio (numerator, denominator). The recursion max(0, b + v - p) equals
    S - min(0, running min S) of the cumulative sums, so integer windows suffice. A hop misses
    exactly when its backlog is positive.
    """
    bucket = block(seq)
    step = F.col(service) * period[1] - period[0]
    sums = running_sum(df.select(*keys, seq, service), keys, seq, step, "_sum", bucket)
    low = running_extreme(sums, keys, [seq], F.col("_sum"), "_low", bucket, kind="min", strict=False)
    return low.select(*keys, seq, (F.col("_sum") - F.least(F.lit(0), F.col("_low"))).alias("backlog"))


def backlog_summary(backlog: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Maximum and final backlog and the number of virtual deadline misses."""
    return backlog.groupBy(*keys).agg(
        F.max("backlog").alias("max_backlog"), F.max_by("backlog", seq).alias("final_backlog"), F.count(F.when(F.col("backlog") > 0, 1)).alias("misses")
    )


def gain_smoothing(df: DataFrame, keys: list[str], ordinal: str, low: str, high: str, alpha: float, target_db: float = -6.0) -> DataFrame:
    """``keys, ordinal, gain``: smoothed level-matching gain.

    A silent low band zeroes gain and state; an empty high band gives gain 1 and keeps the state.
    """
    silent, empty = F.col(low) < 1e-10, F.col(high) < 1e-10
    target = clamp(F.col(low) * (10.0 ** (target_db / 20.0)) / F.col(high), 0.25, 2.0)
    a = F.when(silent, 0.0).when(empty, 1.0).otherwise(1 - alpha)
    b = F.when(silent | empty, 0.0).otherwise(alpha * target)
    tagged = df.withColumn("_aa", a).withColumn("_bb", b)
    states = affine_scan(tagged, keys, ordinal, "_aa", "_bb", 1.0, "_state")
    flags = df.select(*keys, ordinal, silent.alias("_sil"), empty.alias("_emp"))
    gain = F.when(F.col("_sil"), 0.0).when(F.col("_emp"), 1.0).otherwise(F.col("_state"))
    return states.join(flags, [*keys, ordinal]).select(*keys, ordinal, gain.alias("gain"))


def frame_signal(df: DataFrame, keys: list[str], ordinal: str, value: str, n: int, hop: int, causal: bool = False) -> DataFrame:
    """Overlapping frames ``keys, frame, samples``.

    Default: complete frames only. ``causal``: n - hop zeros of history, a zero-padded last hop and
    the tail frames that expose the delay. A group is one frame: at most n samples.
    """
    shift = n - hop if causal else 0
    at = F.col(ordinal) + shift
    first = F.greatest(F.lit(0), F.floor((at - n) / hop) + 1)
    cut = df.select(*keys, at.alias("_at"), F.col(value).alias("_x"), F.explode(F.sequence(first, F.floor(at / hop))).alias("frame"))
    frames = cut.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct((F.col("_at") - F.col("frame") * hop).alias("o"), F.col("_x").alias("x")))).alias("_s"))
    if not causal:
        return frames.filter(F.size("_s") == n).select(*keys, "frame", F.transform("_s", lambda s: s["x"]).alias("samples"))
    lead, count = F.col("_s")[0]["o"].cast("int"), F.size("_s")
    padded = F.concat(F.array_repeat(F.lit(0.0), lead), F.transform("_s", lambda s: s["x"]), F.array_repeat(F.lit(0.0), F.lit(n) - lead - count))
    return frames.select(*keys, "frame", padded.alias("samples"))


def positive_flux(df: DataFrame, keys: list[str], frame: str, magnitude: str) -> DataFrame:
    """Per-bin increases over the previous frame; the first frame has none and is left out."""
    prev = lagged(df.select(*keys, frame, magnitude), keys, frame, {magnitude: "_prev"})
    rise = F.zip_with(magnitude, "_prev", lambda a, b: F.greatest(F.lit(0.0), a - b))
    return prev.filter(F.col("_prev").isNotNull()).select(*keys, frame, rise.alias("flux"))


def evenly_spaced_crops(df: DataFrame, k: int, crop: int, support: int) -> DataFrame:
    """``row_id, position, start``: the anchor, then k-1 starts spread evenly over the free ones.

    Needs ``row_id, anchor, reserved, length_samples``. A start is free when its supervised part,
    which begins ``support`` samples in, stays clear of [reserved, reserved + crop), and it is not
    the anchor. The free starts are the gaps between two holes; the crops stand at the middles of
    k-1 equal shares of them. A row whose anchor is in the reserved hole or outside the recording,
    or that has fewer than k-1 free starts, fails the job.
    """
    last, anchor = F.col("length_samples") - crop, F.col("anchor")
    hole = F.struct((F.col("reserved") - crop + 1).cast("bigint").alias("a"), (F.col("reserved") + crop - support - 1).cast("bigint").alias("z"))
    own = F.struct(anchor.cast("bigint").alias("a"), anchor.cast("bigint").alias("z"))
    rows = df.withColumn("_last", last.cast("bigint")).withColumn("_holes", F.array_sort(F.array(hole, own)))
    stops = F.concat(F.transform("_holes", lambda h: h["a"] - 1), F.array("_last"))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_holes", lambda h: h["z"] + 1))
    gaps = F.zip_with(begins, stops, lambda lo, hi: F.struct(F.greatest(lo, F.lit(0)).alias("lo"), F.least(hi, F.col("_last")).alias("hi")))
    free = F.filter(gaps, lambda g: g["lo"] <= g["hi"])
    sized = rows.withColumn("_free", free).withColumn("_n", F.aggregate("_free", F.lit(0).cast("bigint"), lambda n, g: n + g["hi"] - g["lo"] + 1))
    fits = anchor.between(0, F.col("_last")) & ~anchor.between(F.col("reserved") - crop + 1, F.col("reserved") + crop - support - 1) & (F.col("_n") >= k - 1)
    checked = sized.filter(F.when(fits, True).otherwise(F.raise_error(F.lit("too few free crop starts beside the anchor")).cast("boolean")))
    placed = checked.select("row_id", "_free", anchor.cast("bigint").alias("_anchor"), "_n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("position"))
    rank = F.floor((2 * F.col("position") - 1) * F.col("_n") / max(1, 2 * (k - 1))).cast("bigint")
    # A row has at most three gaps: the rank is counted down over them in the row itself.
    nothing = F.struct(rank.alias("left"), F.lit(None).cast("bigint").alias("start"))

    def pass_gap(at: Column, g: Column) -> Column:
        size = g["hi"] - g["lo"] + 1
        here = F.when(at["start"].isNull() & (at["left"] < size), g["lo"] + at["left"]).otherwise(at["start"])
        return F.struct((at["left"] - size).alias("left"), here.alias("start"))

    start = F.when(F.col("position") == 0, F.col("_anchor")).otherwise(F.aggregate("_free", nothing, pass_gap)["start"])
    return placed.select("row_id", "position", start.alias("start"))


def best_so_far(df: DataFrame, keys: list[str], epoch: str, primary: str, tie: str) -> DataFrame:
    """Rows with ``is_best`` (strictly better than all before) and the running best epoch."""
    value = F.struct(F.col(primary).alias("p"), F.col(tie).alias("t"))
    prior = running_extreme(df, keys, [epoch], value, "_prior", block(epoch), kind="min")
    flagged = prior.withColumn("is_best", F.col("_prior").isNull() | (value < F.col("_prior"))).drop("_prior")
    return running_extreme(flagged, keys, [epoch], F.when(F.col("is_best"), F.col(epoch)), "best_epoch", block(epoch), strict=False)


def farthest_probe(start: Column, length: Column, crop: int, support: int) -> Column:
    """Of {0, length - crop}: the start farthest from the anchor without shared supervision.

    Ties go to 0. NULL when neither end is free.
    """
    top = length - crop
    def free(s: Column) -> Column:
        return (start + crop <= s) | (start + support >= s + crop)
    zero, end = free(F.lit(0)), free(top)
    return F.when(zero & end, F.when(F.abs(top - start) > F.abs(start), top).otherwise(F.lit(0))).when(zero, F.lit(0)).when(end, top)


def repair_overlaps(specs: DataFrame, spans: DataFrame) -> DataFrame:
    """``spec_id, row_id, before, start, moved``: illegal crops go to the nearest unused legal start.

    Ties go to the smaller start; invalid crops are placed in spec order after all valid ones.
    """
    legal = spans.groupBy("row_id").agg(F.collect_list(F.struct("lo", "hi")).alias("legal"))
    return repair_rows(specs.select("spec_id", "row_id", "start").join(legal, "row_id"))


def repair_rows(specs: DataFrame) -> DataFrame:
    """``repair_overlaps`` of specs that bring the ``legal`` spans of their row.

    A record is one manifest row with its crops and spans; its distinct starts are bounded by the
    row's samples. Only rows with several crops, one of them illegal, leave the JVM.
    """
    ok = F.exists("legal", lambda s: (s["lo"] <= F.col("start")) & (F.col("start") <= s["hi"]))
    rows = specs.withColumn("ok", ok).groupBy("row_id").agg(
        F.first("legal").alias("legal"), F.array_sort(F.collect_list(F.struct("spec_id", "start", "ok"))).alias("crops"),
    )
    valid = F.transform(F.filter("crops", lambda c: c["ok"]), lambda c: c["start"])
    rows = rows.filter(
        F.when(F.size(F.array_distinct(valid)) == F.size(valid), F.lit(True)).otherwise(F.raise_error(F.lit("two given crops share one start")).cast("boolean"))
    )

    def place(batches):
        for pdf in batches:
            out = []
            for row_id, legal, crops in zip(pdf["row_id"], pdf["legal"], pdf["crops"]):
                used = {c["start"] for c in crops if c["ok"]}
                for c in crops:
                    best = c["start"] if c["ok"] else nearest_free(c["start"], [(s["lo"], s["hi"]) for s in legal], used)
                    used.add(best)
                    out.append((c["spec_id"], row_id, c["start"], best, not c["ok"]))
            yield pd.DataFrame(out, columns=["spec_id", "row_id", "before", "start", "moved"])

    broken = F.exists("crops", lambda c: ~c["ok"])
    several = broken & (F.size("crops") > 1)
    schema = "spec_id bigint, row_id bigint, before bigint, start bigint, moved boolean"
    fixed = rows.filter(several).select("row_id", "legal", "crops").mapInPandas(place, schema)
    inside = lambda s: F.least(s["hi"], F.greatest(s["lo"], F.col("crops")[0]["start"]))
    near = F.array_min(F.transform("legal", lambda s: F.struct(F.abs(inside(s) - F.col("crops")[0]["start"]).alias("far"), inside(s).alias("at"))))["at"]
    kept = rows.filter(~several).select("row_id", "crops", F.when(broken, near).alias("at")).select("row_id", "at", F.explode("crops").alias("c")).select(
        "c.spec_id", "row_id", F.col("c.start").alias("before"), F.coalesce("at", "c.start").alias("start"), (~F.col("c.ok")).alias("moved")
    )
    return kept.unionByName(fixed)


def nearest_free(start: int, legal: list[tuple[int, int]], used: set[int]) -> int:
    """Nearest unused value inside the inclusive spans; ties go to the smaller one."""
    options = []
    for a, b in legal:
        down = up = min(b, max(a, start))
        while down >= a and down in used:
            down -= 1
        while up <= b and up in used:
            up += 1
        options += [p for p in (down, up) if a <= p <= b]
    if not options:
        raise ValueError("row has insufficient disjoint starts")
    return min(options, key=lambda p: (abs(p - start), p))


def burn_in(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """Drop the first n frames or hops."""
    return df.filter(F.col(ordinal) >= n)


def boundary_vs_interior(df: DataFrame, keys: list[str], ordinal: str, value: str, hop: int) -> DataFrame:
    """RMS of first differences at hop boundaries and inside hops, and their ratio (NULL on zero)."""
    d = lagged(df.select(*keys, ordinal, value), keys, ordinal, {value: "_p"}).withColumn("_d", F.col(value) - F.col("_p")).filter(F.col("_d").isNotNull())
    edge = F.col(ordinal) % hop == 0
    sq = F.col("_d") * F.col("_d")
    out = d.groupBy(*keys).agg(F.sqrt(F.avg(F.when(edge, sq))).alias("boundary_rms"), F.sqrt(F.avg(F.when(~edge, sq))).alias("interior_rms"))
    return out.withColumn("ratio", F.when(F.col("interior_rms") > 0, F.col("boundary_rms") / F.col("interior_rms")))


def bandwidth_quantile(df: DataFrame, keys: list[str], magnitude: str, bin_hz: float, share: float = 0.999, high_hz: float = 16000.0) -> DataFrame:
    """Lowest frequency holding ``share`` of the power, and the power share above ``high_hz``.

    NULL without power. Bins are summed over frames first; the cumulative window spans one
    spectrum.
    """
    power = df.select(*keys, F.posexplode(magnitude).alias("bin", "_m")).groupBy(*keys, "bin").agg(F.sum(F.col("_m") * F.col("_m")).alias("_p"))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = power.withColumn("_c", F.sum("_p").over(w)).withColumn("_t", F.sum("_p").over(Window.partitionBy(*keys)))
    return cum.groupBy(*keys).agg(
        (F.min(F.when((F.col("_c") >= share * F.col("_t")) & (F.col("_t") > 0), F.col("bin"))) * bin_hz).alias("bandwidth_hz"),
        F.when(F.sum("_p") > 0, F.sum(F.when(F.col("bin") * bin_hz >= high_hz, F.col("_p")).otherwise(0.0)) / F.sum("_p")).alias("high_share"),
    )


def history_window(df: DataFrame, keys: list[str], ordinal: str, value: str, k: int) -> DataFrame:
    """``keys, ordinal, history``: the last k values, oldest first; only complete histories."""
    back = Window.partitionBy(*keys, "_block").orderBy(ordinal).rowsBetween(-(k - 1), 0)
    out = with_halo(df.select(*keys, ordinal, value), ordinal, k - 1).withColumn("history", F.collect_list(value).over(back))
    return out.filter(~F.col("_halo") & (F.size("history") == k)).select(*keys, ordinal, "history")


def hold_every(df: DataFrame, keys: list[str], ordinal: str, value: str, n: int, name: str = "held") -> DataFrame:
    """The value of every n-th row, held in between."""
    back = Window.partitionBy(*keys, "_block").orderBy(ordinal).rowsBetween(-(n - 1), 0)
    fresh = F.when(F.col(ordinal) % n == 0, F.col(value))
    out = with_halo(df.withColumn("_v", fresh), ordinal, n - 1).withColumn(name, F.last("_v", ignorenulls=True).over(back))
    return out.filter(~F.col("_halo")).drop("_block", "_halo", "_v")


def release_mix(df: DataFrame, keys: list[str], ordinal: str, request: Column, hold: int, ramp: int) -> DataFrame:
    """``keys, ordinal, mix``: wet while requested and for ``hold`` rows after, with ramps.

    A target change restarts a raised-cosine ramp of ``ramp`` rows from the current value. The
    value at a change is affine in the value at the change before, so only change events are
    scanned; all rows then read their last event.
    """
    held = hangover(df, keys, ordinal, request, F.lit(False), hold)
    flips = lagged(held.select(*keys, ordinal, "active"), keys, ordinal, {"active": "_was"}).withColumn(
        "_event", F.col("active") != F.coalesce("_was", F.lit(False))
    )
    numbered = running_sum(flips, keys, ordinal, F.col("_event").cast("bigint"), "_seg", block(ordinal))
    events = numbered.filter("_event").select(*keys, "_seg", F.col(ordinal).alias("_at"), F.col("active").cast("double").alias("_to"))
    step = lagged(events, keys, "_seg", {"_at": "_at0", "_to": "_to0"})
    w = 0.5 - 0.5 * F.cos(F.pi() * F.least(F.lit(1.0), (F.col("_at") - F.col("_at0")) / F.lit(float(ramp))))
    maps = step.withColumn("_aa", F.when(F.col("_at0").isNull(), 1.0).otherwise(1 - w)).withColumn(
        "_bb", F.when(F.col("_at0").isNull(), 0.0).otherwise(w * F.col("_to0"))
    )
    starts = affine_scan(maps, keys, "_seg", "_aa", "_bb", 0.0, "_from")
    ready = numbered.join(events.join(starts, [*keys, "_seg"]), [*keys, "_seg"], "left")
    progress = F.least(F.lit(1.0), (F.col(ordinal) - F.col("_at") + 1) / F.lit(float(ramp)))
    mix = F.col("_from") + (F.col("_to") - F.col("_from")) * (0.5 - 0.5 * F.cos(F.pi() * progress))
    return ready.select(*keys, ordinal, F.coalesce(mix, F.lit(0.0)).alias("mix"))
