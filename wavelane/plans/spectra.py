"""Spectral-frame queries: reference frame t, prediction t+1, original input t+2 of a track."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelane.functions.numeric import fix
from wavelane.operators import sequence
from wavelane.operators import spectrum as sp
from wavelane.plans.adapters import SQL, load
from wavelane.plans.evaluation import fixed
from wavelane.plans.registry import fx, query, with_ctes

HZ = 24000 / 63
K = ["track_id"]
W_SQL = "CASE WHEN hz <= 9000 THEN 0.0::DOUBLE WHEN hz >= 11000 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE * (1 - cos(pi() * (hz - 9000) / 2000)) END"

SQL["fb"] = f"""
SELECT b.*, b.bin * {HZ!r}::DOUBLE AS hz, CASE WHEN b.bin * {HZ!r}::DOUBLE < 4000 THEN 0 WHEN b.bin * {HZ!r}::DOUBLE < 8000 THEN 4000 WHEN b.bin * {HZ!r}::DOUBLE < 12000 THEN 8000
 WHEN b.bin * {HZ!r}::DOUBLE < 16000 THEN 12000 ELSE 16000 END AS band, q.t AS t0, q.p AS p0, q.o AS o0, q.pp - q.tp AS d0
FROM bins b LEFT JOIN bins q ON q.track_id = b.track_id AND q.bin = b.bin AND q.frame = b.frame - 1
"""
SQL["fw"] = f"SELECT *, {W_SQL} AS w FROM fb "
SQL["gp"] = "SELECT track_id, avg(t * t) AS g FROM bins GROUP BY 1"
BW = "CASE WHEN band = 0 THEN 0.25 / 4.25::DOUBLE ELSE 1 / 4.25::DOUBLE END"


def soft(power, den):
    return f"(sqrt(({power}) / ({den}) + 1e-6::DOUBLE) - 1e-3::DOUBLE)"


def frames(spark, sf):
    return load(spark, sf, "triples")


def masked(spark, sf):
    """Frames with the crossover mask around 10 kHz."""
    return frames(spark, sf).withColumn("w", sp.crossover_weights(F.lit(10000.0), 64, HZ, 2000.0))


LSD_SQL = """SELECT track_id, avg(a) AS lsd, avg(lo) AS lsd_low, avg(hi) AS lsd_high FROM (SELECT track_id, frame, sqrt(avg(e)) AS a, sqrt(avg(e) FILTER (hz < 8000)) AS lo, sqrt(avg(e) FILTER (hz >= 8000)) AS hi
 FROM (SELECT *, pow(20 * log10(greatest({p}, 1e-10)) - 20 * log10(greatest(t, 1e-10)), 2) AS e FROM fb) GROUP BY 1, 2) GROUP BY 1"""


@query("f08_lsd", with_ctes("fb", body=f"SELECT track_id, {fx('lsd', 5)} AS lsd, {fx('lsd_low', 5)} AS lsd_low, {fx('lsd_high', 5)} AS lsd_high FROM ({LSD_SQL.format(p='p')})"))
def f08(spark, sf):
    return fixed(sp.lsd(frames(spark, sf), K, HZ, 8000.0), ["lsd", "lsd_low", "lsd_high"], 5)


@query("f09_spectral_convergence", with_ctes("bins", body=f"SELECT track_id, {fx('sqrt(sum((p - t) * (p - t))) / sqrt(sum(t * t))')} AS convergence FROM bins GROUP BY 1"))
def f09(spark, sf):
    return fixed(sp.spectral_convergence(frames(spark, sf), K), ["convergence"])


@query("f10_energy_bias", with_ctes("fb", body=f"""
WITH e AS (SELECT track_id, 10 * log10((avg(p * p) + 1e-20) / (avg(t * t) + 1e-20)) AS b FROM fb WHERE hz >= 8000 GROUP BY 1) SELECT track_id, {fx('b', 5)} AS energy_bias_db, {fx('abs(b)', 5)} AS energy_error_db FROM e"""))
def f10(spark, sf):
    return fixed(sp.energy_bias(frames(spark, sf), K, 21), ["energy_bias_db", "energy_error_db"], 5)


FLUX_SQL = "sqrt(sum(pow(greatest({p} - {p}0, 0) - greatest(t - t0, 0), 2))) / sqrt(sum(pow(greatest(t - t0, 0), 2)))"


@query("f11_flux_error", with_ctes("fb", body=f"SELECT track_id, {fx(FLUX_SQL.format(p='p'))} AS flux_error FROM fb WHERE hz >= 8000 AND t0 IS NOT NULL GROUP BY 1"))
def f11(spark, sf):
    return fixed(sp.flux_error(frames(spark, sf), K, 21), ["flux_error"])


def triplet_sql(p):
    return f"""SELECT track_id, lsd, lsd_high, sc, eb, fl FROM ({LSD_SQL.format(p=p)}) JOIN (SELECT track_id, sqrt(sum(({p} - t) * ({p} - t))) / sqrt(sum(t * t)) AS sc,
 abs(10 * log10((avg({p} * {p}) FILTER (hz >= 8000) + 1e-20) / (avg(t * t) FILTER (hz >= 8000) + 1e-20))) AS eb FROM fb GROUP BY 1) USING (track_id)
 JOIN (SELECT track_id, {FLUX_SQL.format(p=p)} AS fl FROM fb WHERE hz >= 8000 AND t0 IS NOT NULL GROUP BY 1) USING (track_id)"""


@query("f14_triplet_metrics", with_ctes("fb", body=f"""
WITH b AS ({triplet_sql('o')}), e AS ({triplet_sql('p')}),
u AS (SELECT track_id, unnest(['lsd','lsd_high','convergence','energy_error_db','flux_error']) AS metric, unnest([b.lsd, b.lsd_high, b.sc, b.eb, b.fl]) AS x, unnest([e.lsd, e.lsd_high, e.sc, e.eb, e.fl]) AS y FROM b JOIN e USING (track_id))
SELECT track_id, metric, {fx('x', 4)} AS baseline, {fx('y', 4)} AS enhanced, {fx('y - x', 4)} AS delta FROM u"""))
def f14(spark, sf):
    return fixed(sp.triplet_metrics(frames(spark, sf), K, HZ, 8000.0), ["baseline", "enhanced", "delta"], 4)


@query("f16_band_metrics", with_ctes("fb", body=f"""
WITH s AS (SELECT track_id, band, sqrt(sum((p - t) * (p - t))) / greatest(sqrt(sum(t * t)), 1e-10) AS sc,
 sqrt(sum(pow(greatest(p - p0, 0) - greatest(t - t0, 0), 2)) FILTER (t0 IS NOT NULL)) / greatest(sqrt(sum(pow(greatest(t - t0, 0), 2)) FILTER (t0 IS NOT NULL)), 1e-10) AS flux,
 10 * log10(greatest(avg(p * p), 1e-20) / greatest(avg(t * t), 1e-20)) AS b, 10 * log10(greatest(avg(t * t), 1e-20)) AS r FROM fb GROUP BY 1, 2)
SELECT track_id, band, {fx('sc')} AS sc, {fx('flux')} AS flux, {fx('b', 5)} AS energy_bias_db, {fx('abs(b)', 5)} AS energy_error_db, {fx('r', 5)} AS reference_power_db FROM s"""))
def f16(spark, sf):
    out = sp.band_metrics(frames(spark, sf), K, HZ, 64)
    return fixed(fixed(out, ["sc", "flux"]), ["energy_bias_db", "energy_error_db", "reference_power_db"], 5)


ERR_SQL = """SELECT track_id, band, count(DISTINCT bin) AS bins, avg(t * t) AS t2, avg(p * p) AS p2, avg((p - t) * (p - t)) AS e2, avg(pow((p - t) - (p0 - t0), 2)) AS d2 FROM fb GROUP BY 1, 2"""


@query("f17_loss_parts", with_ctes("fb", "gp", body=f"""
WITH s AS ({ERR_SQL}), f AS (SELECT *, greatest(sqrt(g) * 0.01, 1e-7) AS fl FROM s JOIN gp USING (track_id)), d AS (SELECT *, t2 + fl * fl AS den FROM f),
l AS (SELECT *, {BW} * {soft('e2', 'den')} AS a, 0.25 * {BW} * {soft('d2', 'den')} AS y FROM d)
SELECT track_id, band, bins, {fx('sqrt(t2)')} AS reference_rms, {fx('sqrt(p2)')} AS output_rms, {fx('sqrt(e2)')} AS error_rms, {fx('fl')} AS floor, t2 <= fl * fl AS floor_dominated,
 {fx('a')} AS amplitude_loss, {fx('y')} AS dynamics_loss, {fx('a + y')} AS total FROM l"""))
def f17(spark, sf):
    out = sp.loss_parts(frames(spark, sf), K, HZ, 64)
    return fixed(out, ["reference_rms", "output_rms", "error_rms", "floor", "amplitude_loss", "dynamics_loss", "total"])


@query("f18_complex_error_split", with_ctes("fb", body=f"""
WITH s AS (SELECT track_id, band, avg((p - t) * (p - t)) AS a, avg(p * t * (pow(cos(pp - tp) - 1, 2) + pow(sin(pp - tp), 2))) AS f,
 avg(pow(p * cos(pp) - t * cos(tp), 2) + pow(p * sin(pp) - t * sin(tp), 2)) AS c, avg(t * t) AS r FROM fb GROUP BY 1, 2)
SELECT track_id, band, {fx('a')} AS amplitude_power, {fx('f')} AS phase_power, {fx('c')} AS complex_power, {fx('r')} AS reference_power, {fx('c / r')} AS relative_power, {fx('abs(c - a - f)')} AS residual FROM s"""))
def f18(spark, sf):
    return fixed(sp.complex_error_split(frames(spark, sf), K, HZ, 64), ["amplitude_power", "phase_power", "complex_power", "reference_power", "relative_power", "residual"])


BAND2K = """WITH s AS (SELECT track_id, frame, CAST(floor(hz / 2000) AS INT) AS k, sum(p * p) AS pp, sum(t * t) AS tt FROM fb GROUP BY 1, 2, 3), c AS (SELECT track_id, frame, CASE WHEN k > 11 THEN 11 ELSE k END AS k, sum(pp) AS pp, sum(tt) AS tt FROM s GROUP BY 1, 2, 3),
f AS (SELECT track_id, frame, greatest(sum(tt) * 1e-4, 1e-12) AS f FROM c GROUP BY 1, 2)"""


@query("f19_excess_energy", with_ctes("fb", body=f"{BAND2K} SELECT track_id, {fx('avg(ln(1 + greatest(pp - tt, 0) / (tt + f)))')} AS excess FROM c JOIN f USING (track_id, frame) GROUP BY 1"))
def f19(spark, sf):
    return fixed(sp.excess_energy(frames(spark, sf), K, HZ, 64), ["excess"])


@query("f20_deficit_overshoot", with_ctes("fb", body=f"""
WITH f AS (SELECT track_id, avg(x) * 1e-4 + 1e-12 AS f FROM (SELECT track_id, frame, sum(t * t) AS x FROM fb GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT track_id, band, avg(x) AS x, avg(y) AS y FROM (SELECT track_id, frame, band, sum(CASE WHEN t > o THEN pow(greatest(p - t, 0), 2) ELSE 0 END) AS x, sum(t * t) AS y FROM fb WHERE band > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT track_id, {fx(f"sum({soft('x', 'y + f')}) / 4")} AS overshoot FROM b JOIN f USING (track_id) GROUP BY 1"""))
def f20(spark, sf):
    return fixed(sp.deficit_overshoot(frames(spark, sf), K, HZ, 64), ["overshoot"])


DIRECT_SQL = f"""x AS (SELECT track_id, frame, band, avg(t * t) AS t2, avg(p * p) AS p2, avg((p - t) * (p - t)) AS e2, avg(pow(p * cos(pp) - t * cos(tp), 2) + pow(p * sin(pp) - t * sin(tp), 2)) AS c2,
 avg(pow((p - t) - (p0 - t0), 2)) AS d2 FROM fb GROUP BY 1, 2, 3), y AS (SELECT *, g * 1e-4 + 1e-14 AS f FROM x JOIN gp USING (track_id)),
b AS (SELECT track_id, band, avg(t2) + any_value(f) AS den, avg(e2) AS e2, avg(c2) AS c2, avg(pow(sqrt(p2 + f) - sqrt(t2 + f), 2)) AS v2, avg(d2) AS d2 FROM y GROUP BY 1, 2),
z AS (SELECT track_id, sum({BW} * {soft('e2', 'den')}) AS a, sum({BW} * {soft('c2', 'den')}) AS c, sum({BW} * {soft('v2', 'den')}) AS v, sum({BW} * {soft('d2', 'den')}) AS d FROM b GROUP BY 1)"""


@query("f21_direct_spectrum_score", with_ctes("fb", "gp", body=f"""
WITH {DIRECT_SQL} SELECT track_id, {fx('a')} AS amplitude, {fx('c')} AS complex, {fx('v')} AS envelope, {fx('d')} AS dynamics, {fx('a + c + 0.1 * v + 0.25 * d')} AS score FROM z"""))
def f21(spark, sf):
    return fixed(sp.direct_spectrum_score(frames(spark, sf), K, HZ, 64), ["amplitude", "complex", "envelope", "dynamics", "score"])


@query("f21_paired_identity_risk", with_ctes("fb", "gp", body=f"""
WITH {DIRECT_SQL} SELECT {fx('0.5 * avg(a + c + 0.1 * v + 0.25 * d) FILTER (track_id % 2 <> 0) + 0.5 * avg(a + c + 0.1 * v + 0.25 * d) FILTER (track_id % 2 = 0)')} AS risk FROM z"""))
def f21_risk(spark, sf):
    scores = sp.direct_spectrum_score(frames(spark, sf), K, HZ, 64).withColumn("identity", F.col("track_id") % 2 == 0)
    return fixed(sp.paired_identity_risk(scores, "identity"), ["risk"])


@query("f22_feature_parity", with_ctes("fb", body=f"""
WITH e AS (SELECT *, abs(20 * log10(greatest(p, 1e-10)) - 20 * log10(greatest(t, 1e-10))) AS db, abs(atan2(sin(pp - tp), cos(pp - tp))) AS ph, pow(p * cos(pp) - t * cos(tp), 2) + pow(p * sin(pp) - t * sin(tp), 2) AS c2,
 CASE WHEN bin IN (0, 63) THEN 1 ELSE 2 END AS w FROM fb),
f AS (SELECT track_id, frame, max(db) AS mdb, sum(db) AS sdb, max(ph) AS mph, sum(ph) AS sph, sqrt(sum(w * c2) / sum(w)) / greatest(sqrt(sum(w * t * t) / sum(w)), 1e-6) AS r, sum(w * sqrt(c2)) / 126 AS b FROM e GROUP BY 1, 2)
SELECT track_id, {fx('max(mdb)', 5)} AS max_db, {fx('sum(sdb) / (64 * count(*))', 5)} AS mean_db, {fx('max(mph)')} AS max_phase, {fx('sum(sph) / (64 * count(*))')} AS mean_phase, {fx('max(r)')} AS max_relative_rms, {fx('max(b)')} AS inverse_bound FROM f GROUP BY 1"""))
def f22(spark, sf):
    out = sp.feature_parity(frames(spark, sf), K)
    return fixed(fixed(out, ["max_db", "mean_db"], 5), ["max_phase", "mean_phase", "max_relative_rms", "inverse_bound"])


@query("f06_detect_bandwidth", with_ctes("spectra", body=f"""
WITH RECURSIVE b AS (SELECT track_id, frame, unnest(range(64)) AS bin, 20 * log10(greatest(abs(unnest(samples)), 1e-10)) AS db FROM spectra),
d AS (SELECT track_id, frame, coalesce(max(bin) FILTER (bin >= 1 AND db > peak - 3), 0) * {HZ!r}::DOUBLE AS bw FROM (SELECT *, max(db) OVER (PARTITION BY track_id, frame) AS peak FROM b) GROUP BY 1, 2),
e(track_id, frame, s) AS (SELECT track_id, frame, bw FROM d WHERE frame = 0 UNION ALL
 SELECT d.track_id, d.frame, CASE WHEN e.s = 0 THEN d.bw ELSE 0.1::DOUBLE * d.bw + 0.9::DOUBLE * e.s END FROM e JOIN d ON d.track_id = e.track_id AND d.frame = e.frame + 1),
n AS (SELECT *, s / 24000.0::DOUBLE < 0.4 AS low FROM e)
SELECT track_id, frame, {fx('s', 4)} AS smoothed, coalesce(max(low) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), false) AS needs FROM n"""))
def f06(spark, sf):
    s = load(spark, sf, "spectra").withColumn("db", F.transform("samples", lambda x: 20 * F.log10(F.greatest(F.abs(x), F.lit(1e-10)))))
    detected = sp.detect_bandwidth(s, "db", HZ, -3.0)
    smooth = sequence.ema(detected, K, "frame", "detected_hz", 0.1)
    out = sequence.hangover(smooth, K, "frame", F.col("smoothed") / 24000.0 < 0.4, F.lit(False), 3)
    return fixed(out.select("track_id", "frame", "smoothed", F.col("active").alias("needs")), ["smoothed"], 4)


@query("f07_measure_cutoff", with_ctes("spectra", body=f"""
WITH b AS (SELECT track_id, unnest(range(64)) AS bin, abs(unnest(samples)) AS m FROM spectra), e AS (SELECT track_id, bin, max(m) AS e FROM b GROUP BY 1, 2), p AS (SELECT track_id, max(m) AS p FROM b GROUP BY 1)
SELECT track_id, {fx(f'coalesce(max(bin) FILTER (e > 0.85 * p), 0) * {HZ!r}::DOUBLE')} AS cutoff_hz FROM e JOIN p USING (track_id) GROUP BY 1"""))
def f07(spark, sf):
    s = load(spark, sf, "spectra").withColumn("m", F.transform("samples", F.abs))
    return fixed(sp.measure_cutoff(s, K, "m", HZ, 0.85), ["cutoff_hz"])


def weigh(array):
    """Position-weighted sum: a checkable summary of a whole array."""
    return F.aggregate(F.transform(array, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


@query("f26_crossover_blend", with_ctes("fw", body=f"""
SELECT track_id, frame, {fx('sum((CASE WHEN w = 0 THEN o WHEN w = 1 THEN p ELSE o * (1 - w) + p * w END) * (bin + 1))')} AS blended, {fx('sum(w)')} AS weight FROM fw GROUP BY 1, 2"""))
def f26(spark, sf):
    m = masked(spark, sf)
    return m.select("track_id", "frame", fix(weigh(sp.blend(F.col("o"), F.col("p"), F.col("w")))).alias("blended"), fix(sp.total(F.col("w"))).alias("weight"))


@query("f27_phase_blend", with_ctes("fw", body=f"""
WITH s AS (SELECT *, CASE WHEN w = 0 OR p <= o THEN 0 ELSE w * (1 - (o / p) * (o / p)) END AS sw FROM fw),
b AS (SELECT *, CASE WHEN sw = 0 THEN op WHEN sw = 1 THEN pp ELSE CASE WHEN pow(cos(op) * (1 - sw) + cos(pp) * sw, 2) + pow(sin(op) * (1 - sw) + sin(pp) * sw, 2) > 1.1920928955078125e-07
 THEN atan2(sin(op) * (1 - sw) + sin(pp) * sw, cos(op) * (1 - sw) + cos(pp) * sw) ELSE atan2(sin(op + sw * atan2(sin(pp - op), cos(pp - op))), cos(op + sw * atan2(sin(pp - op), cos(pp - op)))) END END AS ph FROM s)
SELECT track_id, frame, {fx('sum(cos(ph) * (bin + 1))', 5)} AS re, {fx('sum(sin(ph) * (bin + 1))', 5)} AS im, {fx('sum(sw)')} AS weight FROM b GROUP BY 1, 2"""))
def f27(spark, sf):
    m = masked(spark, sf).withColumn("sw", sp.surviving_weight(F.col("w"), F.col("o"), F.col("p")))
    m = m.withColumn("ph", sp.phase_blend(F.col("op"), F.col("pp"), F.col("sw")))
    return m.select("track_id", "frame", fix(weigh(F.transform("ph", F.cos)), 5).alias("re"), fix(weigh(F.transform("ph", F.sin)), 5).alias("im"), fix(sp.total(F.col("sw"))).alias("weight"))


def feature_sql(lo, hi):
    return f"least(greatest(20 * log10(greatest(sqrt(avg(m * m) FILTER (bin >= {lo} AND bin < {hi})), 1e-10) / edge), -60), 60) / 20"


@query("f29_gain_features", with_ctes("spectra", body=f"""
WITH b AS (SELECT track_id, frame, 20 + frame % 30 AS k, unnest(range(64)) AS bin, abs(unnest(samples)) AS m FROM spectra), e AS (SELECT track_id, frame, greatest(sqrt(avg(m * m) FILTER (bin >= k - 5 AND bin < k)), 1e-10) AS edge FROM b GROUP BY 1, 2),
f AS (SELECT track_id, frame, any_value(k) / 63.0::DOUBLE AS f1, {', '.join(feature_sql(f'{j} * k // 6', f'{j + 1} * k // 6') + f' AS r{j}' for j in range(6))}, {feature_sql('k', '64')} AS r9 FROM b JOIN e USING (track_id, frame) GROUP BY track_id, frame, edge)
SELECT track_id, frame, {fx('f1')} AS cutoff, {', '.join(fx(f'r{j}', 5) + f' AS band{j}' for j in range(6))}, {fx('r9', 5)} AS surviving, {fx('-6 + least(greatest(1 + 2 * f1 - 0.5 * r0 + 3 * r9, -6), 6)', 5)} AS target_db FROM f"""))
def f29(spark, sf):
    s = load(spark, sf, "spectra").select("track_id", "frame", F.transform("samples", F.abs).alias("m"), (20 + F.col("frame") % 30).alias("k"))
    f = sp.gain_features(s, "m", "k", 5, 44100)
    x = F.col("features")
    target = sp.target_ratio_db(x, [1.0, 2.0, 0.0, -0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 3.0])
    return f.select("track_id", "frame", fix(x[1]).alias("cutoff"), *[fix(x[3 + j], 5).alias(f"band{j}") for j in range(6)], fix(x[9], 5).alias("surviving"), fix(target, 5).alias("target_db"))


@query("f32_oracle_swap", with_ctes("fb", body=f"""
WITH v AS (SELECT *, CASE WHEN bin >= 11 THEN t ELSE p END AS mp, CASE WHEN bin >= 11 THEN tp ELSE pp END AS mph FROM fb),
g AS (SELECT track_id, frame, sqrt(sum(t * t) FILTER (bin >= 11) / sum(p * p) FILTER (bin >= 11)) AS g FROM fb GROUP BY 1, 2)
SELECT track_id, {fx('avg(pow(mp * cos(pp) - t * cos(tp), 2) + pow(mp * sin(pp) - t * sin(tp), 2))')} AS magnitude, {fx('avg(pow(p * cos(mph) - t * cos(tp), 2) + pow(p * sin(mph) - t * sin(tp), 2))')} AS phase,
 {fx('avg(pow(mp * cos(mph) - t * cos(tp), 2) + pow(mp * sin(mph) - t * sin(tp), 2))')} AS "both", {fx('avg(pow(CASE WHEN bin >= 11 THEN p * g ELSE p END - t, 2))')} AS envelope FROM v JOIN g USING (track_id, frame) GROUP BY 1"""))
def f32(spark, sf):
    base = frames(spark, sf)
    def power(df, name, value=None):
        value = sp.total(sp.complex_error(F.col("p"), F.col("pp"), F.col("t"), F.col("tp"))) if value is None else value
        return df.groupBy(*K).agg(fix(F.avg(value) / 64).alias(name))
    out = power(sp.envelope_oracle(base, 11), "envelope", sp.total(sp.square_error(F.col("p"), F.col("t"))))
    for what in ("magnitude", "phase", "both"):
        out = out.join(power(sp.oracle_swap(base, 11, what), what), K)
    return out


@query("f38_inpainting_terms", with_ctes("fw", body=f"""
WITH d AS (SELECT *, CASE WHEN t0 IS NOT NULL THEN w END AS w0 FROM fw),
f AS (SELECT track_id, frame, greatest(avg(t * t) * 1e-4, 1e-14) AS fl, sum(w * p * p) / greatest(sum(w), 1e-12) AS a, sum(w * t * t) / greatest(sum(w), 1e-12) AS b FROM d GROUP BY 1, 2),
e AS (SELECT track_id, avg(abs(10 * log10(a + fl) - 10 * log10(b + fl))) AS energy FROM f GROUP BY 1),
s AS (SELECT track_id, sqrt(sum(w * (p - t) * (p - t))) AS e, sqrt(sum(w * t * t)) AS b, sqrt(sum(t * t)) AS fu, sqrt(sum(w0 * pow((p - p0) - (t - t0), 2))) AS de, sqrt(sum(w0 * pow(t - t0, 2))) AS db, count(*) AS n, count(t0) AS dn FROM d GROUP BY 1)
SELECT track_id, {fx('e / greatest(b, fu * 0.01, 1e-7)')} AS spectral, {fx('energy', 5)} AS energy, {fx('de / greatest(db, fu * sqrt(dn::DOUBLE / n) * 0.01, 1e-7)')} AS temporal FROM s JOIN e USING (track_id)"""))
def f38(spark, sf):
    return fixed(fixed(sp.inpainting_terms(masked(spark, sf), K), ["spectral", "temporal"]), ["energy"], 5)


@query("f39_subband_energy", with_ctes("fw", "gp", body=f"""
WITH g AS (SELECT track_id, frame, bin // 8 AS k, sum(w * p * p) AS p2, sum(w * t * t) AS t2, sum(w) AS n FROM fw GROUP BY 1, 2, 3), f AS (SELECT *, greatest(g * 1e-4, 1e-14) AS f FROM g JOIN gp USING (track_id))
SELECT track_id, {fx('abs(10 * log10(sum(p2) / greatest(sum(n), 1e-12) + any_value(f)) - 10 * log10(sum(t2) / greatest(sum(n), 1e-12) + any_value(f)))', 5)} AS high,
 {fx('avg(abs(10 * log10(p2 / greatest(n, 1e-12) + f) - 10 * log10(t2 / greatest(n, 1e-12) + f))) FILTER (n > 0)', 5)} AS local FROM f GROUP BY 1"""))
def f39(spark, sf):
    return fixed(sp.subband_energy(masked(spark, sf), K), ["high", "local"], 5)


@query("f40_complex_fidelity", with_ctes("fw", body=f"""
WITH c AS (SELECT *, pow(p * cos(pp) - t * cos(tp), 2) + pow(p * sin(pp) - t * sin(tp), 2) AS h, pow(p * cos(pp) - o * cos(op), 2) + pow(p * sin(pp) - o * sin(op), 2) AS l FROM fw)
SELECT track_id, {fx('sqrt(sum(w * h)) / greatest(sqrt(sum(w * t * t)), sqrt(sum(t * t)) * 0.01, 1e-7)')} AS high_complex, {fx('sqrt(sum((1 - w) * l)) / greatest(sqrt(sum((1 - w) * o * o)), sqrt(sum(o * o)) * 0.01, 1e-7)')} AS low_complex FROM c GROUP BY 1"""))
def f40(spark, sf):
    return fixed(sp.complex_fidelity(masked(spark, sf), K), ["high_complex", "low_complex"])


@query("f41_phase_gradient", with_ctes("fw", body=f"""
WITH d AS (SELECT *, pp - tp AS d, lag(pp - tp) OVER b AS df, lag(w) OVER b AS wf FROM fw WINDOW b AS (PARTITION BY track_id, frame ORDER BY bin))
SELECT track_id, {fx('sum((1 - cos(d - df)) * least(w, wf)) FILTER (df IS NOT NULL) / greatest(sum(least(w, wf)) FILTER (df IS NOT NULL), 1e-12)')} AS frequency,
 {fx('sum((1 - cos(d - d0)) * w) FILTER (d0 IS NOT NULL) / greatest(sum(w) FILTER (d0 IS NOT NULL), 1e-12)')} AS time FROM d GROUP BY 1"""))
def f41(spark, sf):
    return fixed(sp.phase_gradient(masked(spark, sf), K), ["frequency", "time"])


@query("f42_two_sided_band_energy", with_ctes("fb", body=f"{BAND2K} SELECT track_id, {fx('avg(abs(ln(1 + pp / f) - ln(1 + tt / f)))')} AS energy FROM c JOIN f USING (track_id, frame) GROUP BY 1"))
def f42(spark, sf):
    return fixed(sp.two_sided_band_energy(frames(spark, sf), K, HZ, 64), ["energy"])


@query("f44_global_balanced_spectrum", with_ctes("fb", "gp", body=f"""
WITH s AS ({ERR_SQL}), d AS (SELECT *, t2 + g + 1e-14 AS den FROM s JOIN gp USING (track_id)) SELECT track_id, {fx(f"sum({BW} * ({soft('e2', 'den')} + 0.25 * {soft('d2', 'den')}))")} AS score FROM d GROUP BY 1"""))
def f44(spark, sf):
    return fixed(sp.global_balanced_spectrum(frames(spark, sf), K, HZ, 64), ["score"])


@query("f45_shape_energy_terms", with_ctes("fb", "gp", body=f"""
WITH q AS (SELECT *, greatest(sqrt(g) * 1e-3, 1e-7) AS f, greatest(sqrt(g) * 0.01, 1e-5) AS af FROM gp),
n AS (SELECT track_id, frame, band, any_value(f) AS f, avg(t * t) AS t2, sqrt(avg(p * p) + any_value(f) * any_value(f)) AS pn, sqrt(avg(t * t) + any_value(f) * any_value(f)) AS tn,
  sqrt(avg(p0 * p0) + any_value(f) * any_value(f)) AS pn0, sqrt(avg(t0 * t0) + any_value(f) * any_value(f)) AS tn0, avg(abs(ln(1 + p / af) - ln(1 + t / af))) AS a FROM fb JOIN q USING (track_id) GROUP BY 1, 2, 3),
s AS (SELECT track_id, frame, band, avg(abs(p / pn - t / tn)) AS s FROM fb JOIN n USING (track_id, frame, band) GROUP BY 1, 2, 3),
r AS (SELECT track_id, band, avg(abs(ln(pn / f) - ln(tn / f))) AS e, avg(s * t2 / (t2 + f * f)) AS s, avg(abs((ln(pn) - ln(tn)) - (ln(pn0) - ln(tn0)))) AS d, avg(a) AS a, avg((t2 < f * f)::INT) AS w FROM n JOIN s USING (track_id, frame, band) GROUP BY 1, 2)
SELECT track_id, band, {fx('e')} AS band_envelope, {fx('s')} AS band_shape, {fx('d')} AS envelope_temporal, {fx('a')} AS amplitude, {fx('w')} AS below_floor, {fx(f'{BW} * (e + 0.5 * s + 0.25 * d + 0.25 * a)')} AS total FROM r"""))
def f45(spark, sf):
    out = sp.shape_energy_terms(frames(spark, sf), K, HZ, 64)
    return fixed(out, ["band_envelope", "band_shape", "envelope_temporal", "amplitude", "below_floor", "total"])


@query("f46_applied_vs_discarded", with_ctes("fw", "gp", body=f"""
WITH x AS (SELECT *, (p - t) * (p - t) - (o - t) * (o - t) AS dl, pow(o + w * (p - o) - t, 2) - (o - t) * (o - t) AS bl FROM fw),
b AS (SELECT track_id, band, sum(t * t) AS t2, count(*) AS n, sum(dl * w) AS a, sum(dl * (1 - w)) AS x, sum(bl) AS b FROM x GROUP BY 1, 2), d AS (SELECT *, t2 + pow(greatest(sqrt(g) * 0.01, 1e-7), 2) * n AS den FROM b JOIN gp USING (track_id))
SELECT track_id, {fx(f'sum({BW} * a / den)')} AS applied, {fx(f'sum({BW} * x / den)')} AS discarded, {fx(f'sum({BW} * b / den)')} AS blended FROM d GROUP BY 1"""))
def f46(spark, sf):
    return fixed(sp.applied_vs_discarded(masked(spark, sf), K, HZ, 64), ["applied", "discarded", "blended"])


@query("f47_pair_geometry", with_ctes("spectra", body=f"""
WITH v AS (SELECT a.track_id, a.frame, unnest(a.samples) AS x, unnest(coalesce(b.samples, a.samples)) AS y FROM spectra a LEFT JOIN spectra b ON a.track_id = b.track_id AND b.frame = a.frame + 1),
f AS (SELECT track_id, frame, sum(x * y) / greatest(sqrt(sum(x * x)) * sqrt(sum(y * y)), 1e-8) AS c FROM v GROUP BY 1, 2)
SELECT v.track_id, {fx('(SELECT avg(c) FROM f WHERE f.track_id = v.track_id)')} AS cosine, {fx('avg((x - y) * (x - y))')} AS contrast, {fx('avg(y * y)')} AS identity_power FROM v GROUP BY 1"""))
def f47(spark, sf):
    s = load(spark, sf, "spectra")
    after = s.select("track_id", (F.col("frame") - 1).alias("frame"), F.col("samples").alias("next"))
    both = s.join(after, ["track_id", "frame"], "left").withColumn("next", F.coalesce("next", "samples"))
    return fixed(sp.pair_geometry(both, K, "samples", "next"), ["cosine", "contrast", "identity_power"])


@query("f48_sc_logmag_bands", with_ctes("fb", body=f"""
WITH f AS (SELECT track_id, avg(x) * 1e-4 + 1e-12 AS f FROM (SELECT track_id, frame, sum(t * t) AS x FROM fb GROUP BY 1, 2) GROUP BY 1), n AS (SELECT band, count(DISTINCT bin) AS n FROM fb GROUP BY 1),
m AS (SELECT track_id, band, sqrt(p * p + f / n) AS pm, sqrt(t * t + f / n) AS tm FROM fb JOIN f USING (track_id) JOIN n USING (band)),
s AS (SELECT track_id, band, sqrt(sum((pm - tm) * (pm - tm)) / sum(tm * tm)) AS c, avg(abs(ln(pm) - ln(tm))) AS l FROM m GROUP BY 1, 2)
SELECT track_id, band, {fx('c')} AS convergence, {fx('l')} AS log_magnitude, {fx(f'{BW} * (c + l)')} AS weighted FROM s"""))
def f48(spark, sf):
    return fixed(sp.sc_logmag_bands(frames(spark, sf), K, HZ, 64), ["convergence", "log_magnitude", "weighted"])


@query("f49_log_envelope_score", with_ctes("fb", "gp", body=f"""
WITH q AS (SELECT track_id, greatest(sqrt(g) * 0.01, 1e-5) AS f FROM gp), l AS (SELECT track_id, band, ln(1 + p / f) - ln(1 + t / f) AS a, ln(1 + p0 / f) - ln(1 + t0 / f) AS a0 FROM fb JOIN q USING (track_id)),
b AS (SELECT track_id, band, avg(abs(a)) AS a, avg(abs(a - a0)) AS d FROM l GROUP BY 1, 2), s AS (SELECT track_id, sum({BW} * a) AS a, sum({BW} * d) AS d FROM b GROUP BY 1)
SELECT track_id, {fx('a')} AS amplitude, {fx('d')} AS temporal, {fx('a + 0.25 * d')} AS score FROM s"""))
def f49(spark, sf):
    return fixed(sp.log_envelope_score(frames(spark, sf), K, HZ, 64), ["amplitude", "temporal", "score"])


@query("f51_observed_bands", with_ctes("fb", body=f"""
WITH r AS (SELECT track_id, frame, sqrt(avg(t * t)) AS r FROM fb GROUP BY 1, 2), l AS (SELECT track_id, frame, CAST(floor(hz / 3000) AS INT) * 3000 AS band, ln(1 + t / sqrt(r * r / 64 + 1e-10)) AS v FROM fb JOIN r USING (track_id, frame) WHERE hz < 24000)
SELECT track_id, frame, band, {fx('avg(v)')} AS value FROM l GROUP BY 1, 2, 3"""))
def f51(spark, sf):
    d = frames(spark, sf).withColumn("rms", F.sqrt(sp.total(sp.squares(F.col("t"))) / F.size("t")))
    return fixed(sp.observed_bands(d, K, "t", "rms", HZ, 64), ["value"])
