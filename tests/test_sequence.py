"""Every scan against a plain loop, with blocks of eight rows."""

import math
import random

from pyspark.sql import functions as F

from wavelane.operators import extend, sequence
from wavelane.operators import signal as sg
from wavelane.streaming import monitors


def series(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = [(k, i, rng.random(), rng.random() < 0.15, rng.random() < 0.1) for k in ("a", "b") for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i bigint, x double, t boolean, s boolean").repartition(5)


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_longest_run_and_partials(spark, small_blocks):
    rows, df = series(spark)
    want = {}
    for k, rs in by_key(rows).items():
        best = run = 0
        for r in rs:
            run = run + 1 if r[2] > 0.2 else 0
            best = max(best, run)
        want[k] = best
    flag = F.col("x") > 0.2
    assert {r["k"]: r["longest"] for r in sequence.longest_run(df, ["k"], "i", flag).collect()} == want
    parts = extend.run_partials(df.withColumn("f", flag), ["k"], "i", "f", rows=4)
    assert {r["k"]: r["longest"] for r in extend.merge_runs(parts, ["k"]).collect()} == want


def test_hangover_and_release_mix(spark, small_blocks):
    rows, df = series(spark)
    out = {(r["k"], r["i"]): r["active"] for r in sequence.hangover(df, ["k"], "i", F.col("t"), F.col("s"), 5).collect()}
    mix = {(r["k"], r["i"]): r["mix"] for r in sequence.release_mix(df, ["k"], "i", F.col("t"), 3, 6).collect()}
    for k, rs in by_key(rows).items():
        left = 0
        release, current, start, target, pos = 0, 0.0, 0.0, 0.0, 6
        for _, i, _, t, s in rs:
            if s:
                left, active = 0, False
            elif t:
                left, active = 5, True
            else:
                active = left > 0
                left = max(left - 1, 0)
            assert out[k, i] == active
            if t:
                release = 3
            hold = t or release > 0
            if not t and release > 0:
                release -= 1
            goal = 1.0 if hold else 0.0
            if goal != target:
                start, target, pos = current, goal, 0
            if pos >= 6:
                current = target
            else:
                pos += 1
                current = start + (target - start) * (0.5 - 0.5 * math.cos(math.pi * pos / 6))
            assert math.isclose(mix[k, i], current, abs_tol=1e-12)


def test_ema_gain_and_backlog(spark, small_blocks):
    rows, df = series(spark)
    df = df.withColumn("v", F.when(F.col("x") < 0.2, 0.0).otherwise(F.col("x"))).withColumn("n", (F.col("x") * 1000).cast("bigint"))
    df = df.withColumn("hi", F.when(F.col("t"), 0.0).otherwise(F.col("x") + 0.1))
    ema = {(r["k"], r["i"]): r["smoothed"] for r in sequence.ema(df, ["k"], "i", "v", 0.3, F.col("s")).collect()}
    gain = {(r["k"], r["i"]): r["gain"] for r in sequence.gain_smoothing(df, ["k"], "i", "v", "hi", 0.2).collect()}
    back = {(r["k"], r["i"]): r["backlog"] for r in sequence.virtual_backlog(df, ["k"], "i", "n", (1400, 3)).collect()}
    for k, rs in by_key(rows).items():
        level, state, queue = 0.0, 1.0, 0
        for _, i, x, t, s in rs:
            v = 0.0 if x < 0.2 else x
            level = 0.0 if s else (v if level == 0 else 0.3 * v + 0.7 * level)
            assert math.isclose(ema[k, i], level, abs_tol=1e-12)
            hi = 0.0 if t else x + 0.1
            if v < 1e-10:
                state = g = 0.0
            elif hi < 1e-10:
                g = 1.0
            else:
                state = 0.2 * min(max(v * 10 ** (-6 / 20) / hi, 0.25), 2.0) + 0.8 * state
                g = state
            assert math.isclose(gain[k, i], g, abs_tol=1e-12)
            queue = max(0, queue + int(x * 1000) * 3 - 1400)
            assert back[k, i] == queue


def test_sanitize_gap_reset_and_gate(spark, small_blocks):
    rng = random.Random(2)
    rows = [("a", i, float("nan") if rng.random() < 0.3 else rng.uniform(-2, 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i bigint, x double")
    got = {r["i"]: r["clean"] for r in monitors.sanitize(df, ["k"], "i", "x").collect()}
    last = 0.0
    for _, i, x in rows:
        last = last * 0.99 if math.isnan(x) else min(max(x, -1), 1)
        assert math.isclose(got[i], last, abs_tol=1e-12)
    kept = [(k, i) for k, i, x in rows if x == x]
    out = {r["i"]: (r["reset"], r["warming"]) for r in monitors.gap_reset(spark.createDataFrame(kept, "k string, i bigint"), ["k"], "i", 2).collect()}
    previous, since = None, 0
    for _, i in kept:
        reset = previous != i - 1
        since = 0 if reset else since + 1
        assert out[i] == (reset, since < 2)
        previous = i


def test_causal_frames_and_overlap_add_round_trip(spark, small_blocks):
    rng = random.Random(4)
    x = [rng.uniform(-1, 1) for _ in range(37)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k bigint, i bigint, x double")
    frames = sequence.frame_signal(df, ["k"], "i", "x", 8, 2, causal=True)
    assert frames.count() == 19 + 3
    wave = sg.overlap_add(sg.inverse(sg.stft(frames), "log_magnitude", "phase", 8, "y"), ["k"], "y", 8, 2)
    got = {r["position"] - 6: r["x"] for r in wave.collect()}
    assert all(abs(got[i] - v) < 1e-6 for i, v in enumerate(x))


def test_extension_follower_does_not_depend_on_blocks(spark):
    rng = random.Random(6)
    rows = [(1, i, 20 + (i // 150) % 2, None if rng.random() < 0.01 else rng.random()) for i in range(2500)]
    df = spark.createDataFrame(rows, "k bigint, frame bigint, cutoff int, target double")
    one = {r["frame"]: r["strength"] for r in sg.extension_strength(df, ["k"], 128, 48000, rows=1 << 20).collect()}
    many = {r["frame"]: r["strength"] for r in sg.extension_strength(df, ["k"], 128, 48000, rows=600).collect()}
    assert one.keys() == many.keys() and max(abs(one[i] - many[i]) for i in one) < 1e-15


def test_restoration_keeps_length_and_bypasses_when_not_needed(spark):
    x = [math.sin(0.9 * i) * 0.3 for i in range(90)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k bigint, i bigint, x double")
    out = sg.restore_batch(df, ["k"], "i", "x", 16, 4, 48000, 4000.0, min_ratio=0.0)
    rows = out.orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(90)) and all(r["mix"] == 0 and r["output"] == r["dry"] for r in rows)


def test_delay_and_alignment(spark):
    rng = random.Random(8)
    x = [rng.uniform(-1, 1) for _ in range(200)]
    df = spark.createDataFrame([(d, x, [0.0] * d + x[: 200 - d]) for d in (0, 3, 9)], "d int, a array<double>, b array<double>")
    out = sg.align_pairs(df, "a", "b", 48000, 12, 1).collect()
    assert all(r["offset"] == r["d"] and abs(r["residual"]) <= 1 and r["reason"] is None for r in out)
