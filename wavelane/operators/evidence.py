"""Latency, training and signal-quality evidence re-derived from raw rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.ordinals import attach_row, null_safe_join
from wavelane.functions.quantiles import quantile_columns
from wavelane.operators import sequence
from wavelane.operators.aggregates import count_if, distribution
from wavelane.operators.rules import violations

# Acceptance policy of continuous playback.
CALLBACK_FRAMES = 128
ADDED_TARGET_MS, ADDED_LIMIT_MS = 8.0, 10.0
P99_TARGET_US, MAX_LIMIT_US = 100.0, 500.0
MISS_RATIO_LIMIT, BURST_LIMIT_MS = 0.001, 20.0
# Signal review thresholds.
OVER_SCALE, RAIL_SHARE, RAIL_RUN, DC_LIMIT, QUIET_RMS, SILENT_SHARE = 1.0001, 0.001, 3, 0.01, 1e-3, 0.5


def explode_reports(reports: DataFrame) -> DataFrame:
    """Nested reports to raw rows: ``report, hardware, case_ix, sample_rate_hz, seq, sample_ns``."""
    cases = reports.select("report", F.col("hardware.name").alias("hardware"), F.posexplode("cases").alias("case_ix", "c"))
    return cases.select("report", "hardware", "case_ix", "c.sample_rate_hz", F.posexplode("c.samples_ns").alias("seq", "sample_ns"))


def rederive_performance(samples: DataFrame, keys: Sequence[str], value: str, hop: int, rate: Column) -> DataFrame:
    """Durations, real-time factor, throughput, deadline misses and nearest-rank percentiles (us)."""
    base = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hops"), (F.sum(value) / F.lit(1e9)).alias("processing_seconds"), F.max(rate).alias("_rate"),
        F.max(value).alias("_max"), count_if(F.col(value) / F.lit(1000.0) > hop / rate * 1e6).alias("deadline_misses"),
    )
    q = quantile_columns(samples, list(keys), value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, method="nearest")
    audio = F.col("hops") * hop / F.col("_rate")
    out = null_safe_join(base, q, list(keys))
    return out.select(
        *keys, "hops", "processing_seconds", audio.alias("audio_seconds"), (F.col("processing_seconds") / audio).alias("real_time_factor"),
        (audio / F.col("processing_seconds")).alias("throughput"), "deadline_misses", *[(F.col(p) / 1000.0).alias(f"{p}_us") for p in ("p50", "p95", "p99")],
        (F.col("_max") / 1000.0).alias("max_us"),
    )


def reported_mismatches(derived: DataFrame, reported: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """``keys, field, reported, derived`` wherever a reported figure differs beyond tolerance."""
    def long(df, name):
        return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(list(keys), list(fields), "field", name)
    both = long(reported, "reported").join(long(derived, "derived"), [*keys, "field"], "full_outer")
    close = F.abs(F.col("reported") - F.col("derived")) <= tolerance * F.greatest(F.lit(1.0), F.abs("derived"))
    return both.filter(~F.coalesce(close, F.lit(False)))


def report_set_checks(cases: DataFrame, required_cases: Sequence[str], platforms: Sequence[str]) -> DataFrame:
    """Named checks over report cases ``report, hardware, platform, case, rss, peak_rss, gate_pass``."""
    per = cases.groupBy("report").agg(
        F.min("hardware").alias("hardware"), F.max("rss").alias("rss"), F.max("peak_rss").alias("peak"), F.bool_or(~F.col("gate_pass")).alias("failed"),
        F.countDistinct(F.when(F.col("case").isin(*required_cases), F.col("case"))).alias("known"), F.countDistinct("case").alias("distinct"), F.count(F.lit(1)).alias("n"),
    )
    wide = per.agg(
        count_if((F.col("known") != len(required_cases)) | (F.col("distinct") != len(required_cases)) | (F.col("n") != len(required_cases))).alias("wrong_case_set"),
        (F.count(F.lit(1)) - F.countDistinct("hardware")).alias("repeated_hardware"), count_if(F.col("peak") != F.col("rss")).alias("peak_not_case_maximum"),
        count_if(F.col("failed")).alias("failed_gates"),
    )
    seen = cases.agg((F.lit(len(platforms)) - F.countDistinct(F.when(F.col("platform").isin(*platforms), F.col("platform")))).alias("missing_platforms"))
    joined = attach_row(wide, seen)
    names = ["wrong_case_set", "repeated_hardware", "peak_not_case_maximum", "failed_gates", "missing_platforms"]
    return joined.unpivot([], names, "check", "failures")


def serial_latency(df: DataFrame, algorithmic_ms: Column, p99_us: Column, max_us: Column, first_us: Column) -> DataFrame:
    """Adds p99 and maximum serial latency and the target and redline flags."""
    top = algorithmic_ms + F.greatest(max_us, first_us) / 1000.0
    return (
        df.withColumn("serial_p99_ms", algorithmic_ms + p99_us / 1000.0).withColumn("serial_max_ms", top)
        .withColumn("target_met", top < ADDED_TARGET_MS).withColumn("redline_met", top < ADDED_LIMIT_MS)
    )


def timing_summary(df: DataFrame, keys: Sequence[str], seq: str, stages: Sequence[str], total: str, period_ms: float, lateness: str, warmup: int = 100) -> DataFrame:
    """Per stage distribution after the warm-up hops, with slow and late hop counts per key."""
    kept = sequence.burn_in(df, seq, warmup)
    long = kept.select(*keys, *[F.col(s).cast("double").alias(s) for s in stages]).unpivot(list(keys), list(stages), "stage", "ms")
    counts = kept.groupBy(*keys).agg(
        count_if(F.col(total) >= 5).alias("over_5ms"), count_if(F.col(total) >= period_ms).alias("over_period"),
        count_if(F.col(lateness) > 0).alias("late_hops"), F.greatest(F.max(lateness), F.lit(0.0)).alias("max_lateness"),
    )
    return null_safe_join(distribution(long, [*keys, "stage"], "ms"), counts, list(keys))


def cost_screen(df: DataFrame, period_ms: float = 128 / 48, reserve: float = 0.75) -> DataFrame:
    """Adds ``qualifies`` from p99, max, mean, final backlog and miss ratio."""
    ok = (
        (F.col("p99") < reserve * period_ms) & (F.col("max") < 5) & (F.col("mean") < reserve * period_ms)
        & (F.col("final_backlog") == 0) & (F.col("misses") / F.col("count") <= MISS_RATIO_LIMIT)
    )
    return df.withColumn("qualifies", F.coalesce(ok, F.lit(False)))


def training_log_summary(df: DataFrame, keys: Sequence[str], step: str, norm: str, clip: float = 5.0) -> DataFrame:
    """Steps, missing and repeated steps of 1..max, clipped updates, gradient quantiles."""
    per = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("updates"), (F.max(step) - F.countDistinct(step)).alias("missing_steps"),
        (F.count(F.lit(1)) - F.countDistinct(step)).alias("repeated_steps"), count_if(F.col(norm) > clip).alias("clipped_updates"), F.max(norm).alias("max"),
    )
    q = quantile_columns(df, list(keys), norm, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return null_safe_join(per, q, list(keys))


def quality_measures(df: DataFrame, track: str, channel: str, ordinal: str, value: str, rail: float = 1 - 1 / 32768, silence: float = 1e-5) -> DataFrame:
    """Per recording: peak, loudest channel RMS, largest DC, rail and silence shares, rail run, flags.

    Channel partials are sums; the rail run merges across blocks. A frame is silent when all its
    channels are.
    """
    x = F.col(value)
    ch = df.groupBy(track, channel).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(x * x)).alias("rms"), F.abs(F.avg(x)).alias("dc"),
        count_if(F.abs(x) >= rail).alias("rails"), F.count(F.when(~F.coalesce(F.abs(x) < float("inf"), F.lit(False)), 1)).alias("nonfinite"),
    )
    runs = sequence.longest_run(df.select(track, channel, ordinal, value), [track, channel], ordinal, F.abs(x) >= rail)
    per = ch.join(runs, [track, channel]).groupBy(track).agg(
        F.max("n").alias("frames"), F.max("peak").alias("peak"), F.max("rms").alias("rms"), F.max("dc").alias("dc"),
        (F.sum("rails") / F.sum("n")).alias("rail_share"), F.max("longest").alias("longest_rail"), F.sum("nonfinite").alias("nonfinite"),
    )
    quiet = df.groupBy(track, ordinal).agg(F.max(F.abs(x)).alias("_m")).groupBy(track).agg(F.avg((F.col("_m") < silence).cast("double")).alias("silent_share"))
    flags = violations(
        [
            ("over_full_scale", F.col("peak") > OVER_SCALE), ("sustained_full_scale_samples", (F.col("rail_share") > RAIL_SHARE) & (F.col("longest_rail") >= RAIL_RUN)),
            ("large_dc_offset", F.col("dc") > DC_LIMIT), ("very_quiet_recording", F.col("rms") < QUIET_RMS), ("mostly_silence", F.col("silent_share") > SILENT_SHARE),
        ]
    )
    return per.join(quiet, track).withColumn("flags", flags)


# --- A39: weighted ridge -------------------------------------------------------------------------


def normal_equations(df: DataFrame, features: Sequence[str], target: str, weight: Column) -> DataFrame:
    """Upper triangle of X'WX and X'Wy as rows ``i, j, value`` (j = -1 for the target): one pass."""
    k = len(features)
    cells = [(i, j, F.sum(weight * F.col(features[i]) * F.col(features[j]))) for i in range(k) for j in range(i, k)]
    cells += [(i, -1, F.sum(weight * F.col(features[i]) * F.col(target))) for i in range(k)]
    wide = df.agg(*[v.alias(f"c{i}_{j}") for i, j, v in cells])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"`c{i}_{j}`").alias("value")) for i, j, _ in cells])).alias("r")).select("r.*")


def ridge_fit(df: DataFrame, features: Sequence[str], target: str, weight: str, penalty: float, passes: int = 8, knee: float = 3.0) -> list[float]:
    """Huber-IRLS ridge coefficients. The driver only solves a k x k system per pass."""
    k = len(features)
    coef = np.zeros(k)
    w: Column = F.col(weight)
    for _ in range(passes):
        m, v = np.zeros((k, k)), np.zeros(k)
        for r in normal_equations(df, features, target, w).toLocalIterator():
            if r["j"] < 0:
                v[r["i"]] = r["value"]
            else:
                m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"]
        regular = np.eye(k) * penalty
        regular[0, 0] = 1e-8
        coef = np.linalg.solve(m + regular, v)
        fit = sum((F.lit(float(c)) * F.col(f) for c, f in zip(coef, features)), F.lit(0.0))
        residual = F.abs(F.col(target) - fit)
        w = F.col(weight) * F.least(F.lit(1.0), F.lit(knee) / F.greatest(residual, F.lit(1e-8)))
    if not np.isfinite(coef).all() or np.abs(coef).max() > 64:
        raise ValueError("fit exceeds the coefficient contract")
    return [float(c) for c in coef]


def weighted_mae(df: DataFrame, features: Sequence[str], target: str, weight: str, coefficients: Sequence[float], bound: float = 6.0) -> DataFrame:
    """Weighted mean absolute error of the clamped prediction."""
    fit = sum((F.lit(float(c)) * F.col(f) for c, f in zip(coefficients, features)), F.lit(0.0))
    clipped = F.least(F.greatest(fit, F.lit(-bound)), F.lit(bound))
    return df.agg((F.sum(F.col(weight) * F.abs(clipped - F.col(target))) / F.sum(weight)).alias("weighted_mae"))


# --- A40, A41 ------------------------------------------------------------------------------------


def realtime_assessment(df: DataFrame, rate: Column, p99_us: Column, max_us: Column, extra_frames: int = 0) -> DataFrame:
    """Adds latency, miss ratio, burst and four policy booleans; all NULL on invalid input.

    Needs ``accepted, misses, streak, invalid, rejected, failed``. Nothing measured counts as a
    miss ratio of 1 and never as available.
    """
    valid = rate.isin(44100, 48000) & (p99_us >= 0) & (max_us >= p99_us) & (max_us < float("inf"))
    measured = F.col("accepted") + F.col("misses")
    added = F.lit(2 * CALLBACK_FRAMES + extra_frames) / rate * 1000.0 + max_us / 1000.0
    miss = F.when(measured == 0, 1.0).otherwise(F.col("misses") / F.greatest(measured, F.lit(1)))
    burst = F.col("streak") * CALLBACK_FRAMES / rate * 1000.0
    available = (measured > 0) & ~F.col("failed") & (F.col("invalid") == 0) & (F.col("rejected") == 0) & (miss <= MISS_RATIO_LIMIT) & (burst <= BURST_LIMIT_MS)
    columns = {
        "added_latency_ms": added, "miss_ratio": miss, "miss_burst_ms": burst, "latency_target_met": added < ADDED_TARGET_MS, "latency_limit_met": added < ADDED_LIMIT_MS,
        "callback_budget_met": (p99_us < P99_TARGET_US) & (max_us < MAX_LIMIT_US), "availability_met": available,
    }
    return df.select("*", *[F.when(valid, v).alias(n) for n, v in columns.items()])


def frame_gate_summary(df: DataFrame, track: str, frame: str, bandwidth: str, needs: str, nyquist: Column, expected_degraded: Column) -> DataFrame:
    """Channel rows to frames to recordings: frames, frames needing work, mean of the per-frame minimum.

    ``false_bypass`` marks a recording known to be degraded in which no frame needed work.
    """
    frames = df.groupBy(track, frame).agg(F.min(bandwidth).alias("_b"), F.bool_or(needs).alias("_n"), F.max(nyquist).alias("_ny"), F.bool_or(expected_degraded).alias("_d"))
    out = frames.groupBy(track).agg(
        F.count(F.lit(1)).alias("frames"), count_if(F.col("_n")).alias("frames_needing"), F.avg("_b").alias("bandwidth_hz"), F.max("_ny").alias("_ny"), F.bool_or("_d").alias("_d")
    )
    return out.select(
        track, "frames", "frames_needing", "bandwidth_hz", (F.col("bandwidth_hz") / F.col("_ny")).alias("bandwidth_ratio"), (F.col("_d") & (F.col("frames_needing") == 0)).alias("false_bypass")
    )
