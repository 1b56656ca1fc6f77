"""Latency, training-log and quality evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelane.functions.numeric import fix
from wavelane.operators import aggregates, evidence, sequence
from wavelane.plans.adapters import load
from wavelane.plans.evaluation import fixed
from wavelane.plans.registry import fx, query, with_ctes

R = ["run_id"]
PERF = f"""WITH p AS (SELECT run_id, count(*) AS hops, CAST(sum(service_ns) AS BIGINT) / 1e9 AS ps, count(*) * 128 / 48000.0::DOUBLE AS au, count(*) FILTER (service_ns / 1000.0::DOUBLE > 128 / 48000.0::DOUBLE * 1e6) AS dm, max(service_ns) / 1000.0::DOUBLE AS mx,
 quantile_disc(service_ns, 0.5) / 1000.0::DOUBLE AS p50, quantile_disc(service_ns, 0.95) / 1000.0::DOUBLE AS p95, quantile_disc(service_ns, 0.99) / 1000.0::DOUBLE AS p99 FROM hops GROUP BY 1)"""


def derived(spark, sf):
    return evidence.rederive_performance(load(spark, sf, "hops"), R, "service_ns", 128, F.lit(48000))


@query("s14_read_perf_reports", """
WITH s AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id AS report, 'host-' || vec_id % 7 AS hardware, CAST(j // 32 AS INT) AS case_ix, CASE WHEN j < 32 THEN 44100 ELSE 48000 END AS sample_rate_hz, CAST(j % 32 AS INT) AS seq, CAST(floor(abs(x) * 1e6) AS BIGINT) AS sample_ns FROM s""")
def s14(spark, sf):
    e = load(spark, sf, "embeddings")
    ns = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1e6))
    cases = F.array(*[F.struct(F.lit(r).alias("sample_rate_hz"), F.slice("_n", a, 32).alias("samples_ns")) for r, a in ((44100, 1), (48000, 33))])
    text = e.withColumn("_n", ns).select(F.to_json(F.struct(
        F.col("vec_id").alias("report"), F.struct(F.concat(F.lit("host-"), (F.col("vec_id") % 7).cast("string")).alias("name")).alias("hardware"), cases.alias("cases"))).alias("j"))
    schema = "report bigint, hardware struct<name:string>, cases array<struct<sample_rate_hz:int,samples_ns:array<bigint>>>"
    return evidence.explode_reports(text.select(F.from_json("j", schema).alias("r")).select("r.*"))


@query("a25_rederive_performance", with_ctes("hops", body=f"""{PERF}
SELECT run_id, hops, {fx('ps')} AS processing_seconds, {fx('au')} AS audio_seconds, {fx('ps / au')} AS real_time_factor, {fx('au / ps')} AS throughput, dm AS deadline_misses,
 {fx('p50')} AS p50_us, {fx('p95')} AS p95_us, {fx('p99')} AS p99_us, {fx('mx')} AS max_us FROM p"""))
def a25(spark, sf):
    return fixed(derived(spark, sf), ["processing_seconds", "audio_seconds", "real_time_factor", "throughput", "p50_us", "p95_us", "p99_us", "max_us"])


@query("a25_reported_mismatches", with_ctes("hops", body=f"""{PERF}
SELECT run_id, 'p99_us' AS field, {fx('p99 + 1')} AS reported, {fx('p99')} AS derived FROM p WHERE run_id % 10 = 3
UNION ALL SELECT run_id, 'deadline_misses', {fx('dm + 1')}, {fx('dm')} FROM p WHERE run_id % 25 = 4"""))
def a25_mismatch(spark, sf):
    d = derived(spark, sf)
    reported = d.withColumn("p99_us", F.col("p99_us") + F.when(F.col("run_id") % 10 == 3, 1.0).otherwise(0.0)).withColumn(
        "deadline_misses", F.col("deadline_misses") + F.when(F.col("run_id") % 25 == 4, 1).otherwise(0)
    )
    return fixed(evidence.reported_mismatches(d, reported, R, ["p99_us", "deadline_misses", "processing_seconds"]), ["reported", "derived"])


@query("a26_report_set_checks", """
WITH c AS (SELECT user_id AS report, 'host-' || user_id % 149 AS hardware, event_type AS cs, max(CAST(value * 1000 AS BIGINT)) AS rss FROM events GROUP BY 1, 2, 3),
p AS (SELECT *, CASE WHEN report % 11 = 0 THEN 0 ELSE max(rss) OVER (PARTITION BY report) END AS peak FROM c),
r AS (SELECT report, min(hardware) AS hw, max(rss) AS rss, max(peak) AS peak, bool_or(rss > 290000) AS failed, count(DISTINCT cs) AS d, count(*) AS n FROM p GROUP BY 1)
SELECT 'wrong_case_set' AS "check", count(*) FILTER (d <> 5 OR n <> 5) AS failures FROM r UNION ALL SELECT 'repeated_hardware', count(*) - count(DISTINCT hw) FROM r
UNION ALL SELECT 'peak_not_case_maximum', count(*) FILTER (peak <> rss) FROM r UNION ALL SELECT 'failed_gates', count(*) FILTER (failed) FROM r UNION ALL SELECT 'missing_platforms', 1""")
def a26(spark, sf):
    e = load(spark, sf, "events")
    cases = e.groupBy(F.col("user_id").alias("report"), F.col("event_type").alias("case")).agg(F.max(F.round(F.col("value") * 1000).cast("bigint")).alias("rss"))
    peak = cases.groupBy("report").agg(F.max("rss").alias("_p"))
    rows = cases.join(peak, "report").select(
        "report", "case", "rss", F.concat(F.lit("host-"), (F.col("report") % 149).cast("string")).alias("hardware"),
        F.when(F.col("report") % 11 == 0, 0).otherwise(F.col("_p")).alias("peak_rss"), (F.col("rss") <= 290000).alias("gate_pass"),
        F.when(F.col("report") % 2 == 0, "macos").otherwise("linux").alias("platform"),
    )
    return evidence.report_set_checks(rows, ["click", "view", "error", "signup", "purchase"], ["macos", "linux", "windows"])


@query("a27_serial_latency", with_ctes("hops", body=f"""{PERF}, l AS (SELECT run_id, 128 / 48.0::DOUBLE + p99 / 1000 AS a, 128 / 48.0::DOUBLE + greatest(mx, 6000.0 + run_id % 7 * 500) / 1000 AS b FROM p)
SELECT run_id, {fx('a')} AS serial_p99_ms, {fx('b')} AS serial_max_ms, b < 8 AS target_met, b < 10 AS redline_met FROM l"""))
def a27(spark, sf):
    out = evidence.serial_latency(derived(spark, sf), F.lit(128 / 48), F.col("p99_us"), F.col("max_us"), 6000.0 + F.col("run_id") % 7 * 500)
    return fixed(out.select("run_id", "serial_p99_ms", "serial_max_ms", "target_met", "redline_met"), ["serial_p99_ms", "serial_max_ms"])


def timed(spark, sf):
    h = load(spark, sf, "hops")
    ms = F.col("service_ns") / F.lit(1e6)
    return h.select("run_id", "seq", (ms * 0.25).alias("analysis"), (ms * 0.5).alias("model"), ms.alias("total"), (ms - 8.0).alias("lateness"))


@query("a28_timing_summary", with_ctes("hops", body=f"""
WITH t AS (SELECT run_id, service_ns / 1e6 AS ms FROM hops WHERE seq >= 10), l AS (SELECT run_id, unnest(['analysis','model','total']) AS stage, unnest([ms * 0.25, ms * 0.5, ms]) AS ms FROM t),
c AS (SELECT run_id, count(*) FILTER (ms >= 5) AS over_5ms, count(*) FILTER (ms >= {128 / 48!r}::DOUBLE) AS over_period, count(*) FILTER (ms - 8.0 > 0) AS late_hops, greatest(max(ms - 8.0), 0) AS max_lateness FROM t GROUP BY 1)
SELECT run_id, stage, count(*) AS count, {fx('avg(ms)')} AS mean, {fx('min(ms)')} AS min, {fx('max(ms)')} AS max, {fx('quantile_cont(ms, 0.5)')} AS p50, {fx('quantile_cont(ms, 0.9)')} AS p90, {fx('quantile_cont(ms, 0.95)')} AS p95,
 {fx('quantile_cont(ms, 0.99)')} AS p99, any_value(over_5ms) AS over_5ms, any_value(over_period) AS over_period, any_value(late_hops) AS late_hops, {fx('any_value(max_lateness)')} AS max_lateness FROM l JOIN c USING (run_id) GROUP BY 1, 2"""))
def a28(spark, sf):
    out = evidence.timing_summary(timed(spark, sf), R, "seq", ["analysis", "model", "total"], "total", 128 / 48, "lateness", warmup=10)
    return fixed(out, ["mean", "min", "max", "p50", "p90", "p95", "p99", "max_lateness"])


@query("a29_cost_screen", with_ctes("hops", body=f"""
WITH s AS (SELECT *, service_ns // 20 AS v, sum((service_ns // 20) * 3 - 8000000) OVER (PARTITION BY run_id ORDER BY seq) AS c FROM hops), m AS (SELECT *, min(c) OVER (PARTITION BY run_id ORDER BY seq) AS low FROM s),
b AS (SELECT run_id, count(*) AS count, avg(v / 1e6) AS mean, max(v / 1e6) AS max, quantile_cont(v / 1e6, 0.99) AS p99, max_by(c - least(0, low), seq) AS fb, count(*) FILTER (c - least(0, low) > 0) AS misses FROM m GROUP BY 1)
SELECT run_id, count, misses, p99 < 2.0 AND max < 5 AND mean < 2.0 AND fb = 0 AND misses / count <= 0.001 AS qualifies FROM b"""))
def a29(spark, sf):
    h = load(spark, sf, "hops").withColumn("v", F.floor(F.col("service_ns") / 20)).withColumn("ms", F.col("v") / F.lit(1e6))
    cost = sequence.backlog_summary(sequence.virtual_backlog(h, R, "seq", "v", (8000000, 3)), R, "seq")
    out = evidence.cost_screen(aggregates.distribution(h, R, "ms").join(cost, R))
    return out.select("run_id", "count", "misses", "qualifies")


@query("a37_training_log_summary", with_ctes("hops", body=f"""
WITH u AS (SELECT run_id, seq + 1 AS step, service_ns / 1e6 AS g FROM hops WHERE NOT (missed AND rejected))
SELECT run_id, count(*) AS updates, max(step) - count(DISTINCT step) AS missing_steps, count(*) - count(DISTINCT step) AS repeated_steps, count(*) FILTER (g > 5) AS clipped_updates, {fx('max(g)')} AS max,
 {fx('quantile_cont(g, 0.5)')} AS p50, {fx('quantile_cont(g, 0.95)')} AS p95, {fx('quantile_cont(g, 0.99)')} AS p99 FROM u GROUP BY 1"""))
def a37(spark, sf):
    u = load(spark, sf, "hops").filter(~(F.col("missed") & F.col("rejected"))).select("run_id", (F.col("seq") + 1).alias("step"), (F.col("service_ns") / F.lit(1e6)).alias("g"))
    return fixed(evidence.training_log_summary(u, R, "step", "g"), ["max", "p50", "p95", "p99"])


@query("a38_quality_measures", with_ctes("signal", body=f"""
WITH v AS (SELECT track_id, channel, sample_ix, x * 2 AS x FROM signal), r AS (SELECT *, abs(x) >= 0.3 AS rail, sample_ix - row_number() OVER (PARTITION BY track_id, channel, abs(x) >= 0.3 ORDER BY sample_ix) AS isl FROM v),
l AS (SELECT track_id, max(n) AS longest FROM (SELECT track_id, channel, isl, count(*) AS n FROM r WHERE rail GROUP BY 1, 2, 3) GROUP BY 1),
c AS (SELECT track_id, channel, count(*) AS n, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, abs(avg(x)) AS dc, count(*) FILTER (rail) AS rails FROM r GROUP BY 1, 2),
t AS (SELECT track_id, max(n) AS frames, max(peak) AS peak, max(rms) AS rms, max(dc) AS dc, sum(rails) / sum(n) AS rs FROM c GROUP BY 1),
q AS (SELECT track_id, avg((m < 0.02)::INT) AS ss FROM (SELECT track_id, sample_ix, max(abs(x)) AS m FROM v GROUP BY 1, 2) GROUP BY 1)
SELECT track_id, frames, {fx('peak')} AS peak, {fx('rms')} AS rms, {fx('dc')} AS dc, {fx('rs')} AS rail_share, coalesce(longest, 0) AS longest_rail, CAST(0 AS BIGINT) AS nonfinite, {fx('ss')} AS silent_share,
 array_to_string(list_filter([CASE WHEN peak > 1.0001 THEN 'over_full_scale' END, CASE WHEN rs > 0.001 AND coalesce(longest, 0) >= 3 THEN 'sustained_full_scale_samples' END, CASE WHEN dc > 0.01 THEN 'large_dc_offset' END,
 CASE WHEN rms < 1e-3 THEN 'very_quiet_recording' END, CASE WHEN ss > 0.5 THEN 'mostly_silence' END], lambda z: z IS NOT NULL), ',') AS flags FROM t JOIN q USING (track_id) LEFT JOIN l USING (track_id)"""))
def a38(spark, sf):
    s = load(spark, sf, "signal").select("track_id", "channel", "sample_ix", (F.col("x") * 2).alias("x"))
    out = evidence.quality_measures(s, "track_id", "channel", "sample_ix", "x", rail=0.3, silence=0.02)
    return fixed(out, ["peak", "rms", "dc", "rail_share", "silent_share"]).withColumn("flags", F.array_join("flags", ","))


FEATURES = ["one", "qty", "price", "disc"]


def regression(spark, sf):
    """Line items as regression rows with integer-valued features."""
    return load(spark, sf, "lineitem").select(
        F.lit(1.0).alias("one"), (F.round("l_quantity") / 50).alias("qty"), (F.round("l_extendedprice") / 100000).alias("price"), (F.round(F.col("l_discount") * 100) / 10).alias("disc"),
        (F.round(F.col("l_tax") * 100) + F.round("l_quantity") / 25).alias("y"), (1.0 + F.col("l_linenumber")).alias("w"), "l_orderkey",
    )


@query("a39_normal_equations", f"""
WITH d AS (SELECT 1.0::DOUBLE AS f0, round(l_quantity) / 50 AS f1, round(l_extendedprice) / 100000 AS f2, round(l_discount * 100) / 10 AS f3, round(l_tax * 100) + round(l_quantity) / 25 AS y, 1.0 + l_linenumber AS w FROM lineitem),
c AS ({' UNION ALL '.join([f'SELECT {i} AS i, {j} AS j, sum(w * f{i} * f{j}) AS v FROM d' for i in range(4) for j in range(i, 4)] + [f'SELECT {i}, -1, sum(w * f{i} * y) FROM d' for i in range(4)])})
SELECT i, j, {fx('v', 3)} AS value FROM c""")
def a39(spark, sf):
    return fixed(evidence.normal_equations(regression(spark, sf), FEATURES, "y", F.col("w")), ["value"], 3)


@query("a39_ridge_fit")
def a39_fit(spark, sf):
    """Penalty chosen on held-out orders, then refitted on all rows."""
    rows = regression(spark, sf)
    held = F.col("l_orderkey") % 5 == 0
    scores = []
    for penalty in (0.001, 1.0):
        coef = evidence.ridge_fit(rows.filter(~held), FEATURES, "y", "w", penalty, passes=4)
        scores.append((evidence.weighted_mae(rows.filter(held), FEATURES, "y", "w", coef).first()[0], penalty))
    best = min(scores)
    coef = evidence.ridge_fit(rows, FEATURES, "y", "w", best[1], passes=8)
    out = [(best[1], float(best[0]), i, c) for i, c in enumerate(coef)]
    return fixed(spark.createDataFrame(out, "penalty double, held_out_mae double, feature int, coefficient double"), ["held_out_mae", "coefficient"], 4)


STATS = """st AS (SELECT h.run_id, count(*) FILTER (NOT missed AND seq >= 2) AS accepted, count(*) FILTER (missed AND seq >= 2) AS misses, count(*) FILTER (rejected AND value_bad) AS rejected FROM (SELECT *, service_ns > 12000000 AS value_bad FROM hops) h GROUP BY 1)"""


@query("a40_realtime_assessment", with_ctes("hops", body=f"""
WITH g AS (SELECT run_id, seq - row_number() OVER (PARTITION BY run_id ORDER BY seq) AS isl FROM hops WHERE missed AND seq >= 2), k AS (SELECT run_id, max(n) AS streak FROM (SELECT run_id, isl, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
{STATS}, m AS (SELECT run_id, max(service_ns) / 1e5 AS mx, CASE WHEN run_id % 9 = 0 THEN 22050 WHEN run_id % 2 = 0 THEN 44100 ELSE 48000 END AS rate FROM hops GROUP BY 1),
a AS (SELECT st.run_id, rate IN (44100, 48000) AS ok, accepted, misses, rejected, coalesce(streak, 0) AS streak, 256 / rate * 1000.0::DOUBLE + mx / 1000 AS added, mx, rate,
 CASE WHEN accepted + misses = 0 THEN 1 ELSE misses / (accepted + misses) END AS miss FROM st JOIN m USING (run_id) LEFT JOIN k USING (run_id)), b AS (SELECT *, streak * 128 / rate * 1000.0::DOUBLE AS burst FROM a)
SELECT run_id, CASE WHEN ok THEN {fx('added')} END AS added_latency_ms, CASE WHEN ok THEN {fx('miss')} END AS miss_ratio, CASE WHEN ok THEN {fx('burst')} END AS miss_burst_ms, CASE WHEN ok THEN added < 8 END AS latency_target_met, CASE WHEN ok THEN added < 10 END AS latency_limit_met,
 CASE WHEN ok THEN mx * 0.5 < 100 AND mx < 500 END AS callback_budget_met, CASE WHEN ok THEN accepted + misses > 0 AND rejected = 0 AND miss <= 0.001 AND burst <= 20 END AS availability_met FROM b"""))
def a40(spark, sf):
    h = load(spark, sf, "hops")
    streak = sequence.consecutive_misses(h, R, "seq", F.col("missed")).withColumnRenamed("longest", "streak")
    stats = h.groupBy(*R).agg(
        F.count(F.when(~F.col("missed") & (F.col("seq") >= 2), 1)).alias("accepted"), F.count(F.when(F.col("missed") & (F.col("seq") >= 2), 1)).alias("misses"),
        F.count(F.when(F.col("rejected") & (F.col("service_ns") > 12000000), 1)).alias("rejected"), (F.max("service_ns") / F.lit(1e5)).alias("mx"),
    ).join(streak, R, "left").withColumn("streak", F.coalesce("streak", F.lit(0))).withColumn("invalid", F.lit(0)).withColumn("failed", F.lit(False))
    rate = F.when(F.col("run_id") % 9 == 0, 22050).when(F.col("run_id") % 2 == 0, 44100).otherwise(48000)
    out = evidence.realtime_assessment(stats, rate, F.col("mx") * 0.5, F.col("mx"))
    names = ["added_latency_ms", "miss_ratio", "miss_burst_ms", "latency_target_met", "latency_limit_met", "callback_budget_met", "availability_met"]
    return fixed(out.select("run_id", *names), names[:3])


@query("a41_frame_gate_summary", with_ctes("signal", body=f"""
WITH f AS (SELECT track_id, sample_ix, min(abs(x) * 24000) AS b, bool_or(abs(x) < 0.002) AS n FROM signal GROUP BY 1, 2)
SELECT track_id, count(*) AS frames, count(*) FILTER (n) AS frames_needing, {fx('avg(b)', 4)} AS bandwidth_hz, {fx('avg(b) / 24000')} AS bandwidth_ratio, track_id % 2 = 0 AND count(*) FILTER (n) = 0 AS false_bypass FROM f GROUP BY 1"""))
def a41(spark, sf):
    s = load(spark, sf, "signal").select("track_id", "channel", "sample_ix", (F.abs("x") * 24000).alias("b"), (F.abs("x") < 0.002).alias("n"))
    out = evidence.frame_gate_summary(s, "track_id", "sample_ix", "b", "n", F.lit(24000.0), F.col("track_id") % 2 == 0)
    return fixed(fixed(out, ["bandwidth_hz"], 4), ["bandwidth_ratio"])
