"""Waveform queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelane.functions.numeric import fix
from wavelane.functions.scans import affine_scan
from wavelane.operators import sequence
from wavelane.operators import signal as sg
from wavelane.operators import spectrum as sp
from wavelane.plans.adapters import SQL, load
from wavelane.plans.evaluation import fixed
from wavelane.plans.registry import fx, query, with_ctes
from wavelane.plans.spectra import weigh

SK = ["track_id", "channel"]
K = ["track_id"]
HANN = "(0.5 - 0.5 * cos(2 * pi() * j / 64))"

# Relational transform of the 64-sample frames: bins 0..32.
SQL["dft"] = f"""
SELECT track_id, frame, k, sum(x * {HANN} * cos(2 * pi() * k * j / 64)) AS re, -sum(x * {HANN} * sin(2 * pi() * k * j / 64)) AS im
FROM (SELECT track_id, frame, unnest(range(64)) AS j, unnest(samples) AS x FROM spectra ), range(33) g(k) GROUP BY 1, 2, 3
"""
SQL["pairsig"] = """
SELECT track_id, channel, sample_ix, x, round_even(x * 8, 0) / 8 AS y FROM signal
"""


def pair_signal(spark, sf):
    return load(spark, sf, "signal").select(*SK, "sample_ix", "x", sg.quantise(F.col("x"), 4).alias("y"))


@query("f01_stft", with_ctes("dft", body=f"""
SELECT track_id, frame, k AS bin, {fx('20 * log10(greatest(sqrt(re * re + im * im), 1e-10))', 4)} AS log_magnitude, {fx('re')} AS re, {fx('im')} AS im FROM dft"""))
def f01(spark, sf):
    z = sg.stft(load(spark, sf, "spectra"))
    b = z.select("track_id", "frame", F.posexplode(F.arrays_zip("log_magnitude", "phase")).alias("bin", "v"))
    mag = F.pow(F.lit(10.0), F.col("v.log_magnitude") / 20)
    out = b.select("track_id", "frame", "bin", F.col("v.log_magnitude").alias("log_magnitude"), (mag * F.cos("v.phase")).alias("re"), (mag * F.sin("v.phase")).alias("im"))
    return fixed(fixed(out, ["log_magnitude"], 4), ["re", "im"])


@query("f02_overlap_add", with_ctes("spectra", body=f"""
WITH s AS (SELECT track_id, frame, unnest(range(64)) AS j, unnest(samples) AS x FROM spectra),
o AS (SELECT track_id, frame * 16 + j AS position, sum(x * {HANN} * {HANN}) AS s, sum({HANN} * {HANN}) AS w FROM s GROUP BY 1, 2)
SELECT track_id, position, {fx('CASE WHEN w > 1e-12 THEN s / w ELSE 0 END')} AS x FROM o"""))
def f02(spark, sf):
    z = sg.stft(load(spark, sf, "spectra"))
    return fixed(sg.overlap_add(sg.inverse(z, "log_magnitude", "phase", 64, "y"), K, "y", 64, 16), ["x"])


BAND = "CASE WHEN k * 750 < 4000 THEN 0 WHEN k * 750 < 8000 THEN 4000 WHEN k * 750 < 12000 THEN 8000 WHEN k * 750 < 16000 THEN 12000 ELSE 16000 END"


@query("f03_band_power", with_ctes("dft", body=f"""
WITH p AS (SELECT track_id, frame, {BAND} AS band, (re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / (64 * 24.0::DOUBLE) AS p FROM dft),
f AS (SELECT track_id, frame, band, sum(p) AS p FROM p GROUP BY 1, 2, 3) SELECT track_id, band, {fx('avg(p)', 8)} AS power FROM f GROUP BY 1, 2"""))
def f03(spark, sf):
    return fixed(sg.band_power(load(spark, sf, "spectra"), K, "samples", 48000, 64), ["power"], 8)


@query("f04_pcm_stats", with_ctes("signal", body=f"""
WITH d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY track_id, channel ORDER BY sample_ix)) AS st FROM signal), s AS (SELECT track_id, channel, avg(x * x) AS p, max(abs(x)) AS peak, coalesce(max(st), 0) AS st FROM d GROUP BY 1, 2)
SELECT track_id, channel, {fx('sqrt(p)')} AS rms, {fx('10 * log10(p)', 5)} AS rms_dbfs, {fx('peak')} AS peak, {fx('st')} AS peak_step FROM s"""))
def f04(spark, sf):
    return fixed(fixed(sg.pcm_stats(load(spark, sf, "signal"), SK, "sample_ix", "x"), ["rms", "peak", "peak_step"]), ["rms_dbfs"], 5)


@query("f05_compare_pcm", with_ctes("pairsig", body=f"""
WITH d AS (SELECT *, y - x AS e, lag(y - x) OVER (PARTITION BY track_id, channel ORDER BY sample_ix) AS e0 FROM pairsig),
s AS (SELECT track_id, channel, sqrt(avg(e * e)) AS r, max(abs(e)) AS pk, max(abs(e - e0)) AS st, sqrt(avg(x * x)) AS rr, sqrt(avg(y * y)) AS ro FROM d GROUP BY 1, 2)
SELECT track_id, channel, {fx('r')} AS rms, {fx('20 * log10(r)', 5)} AS rms_dbfs, {fx('pk')} AS peak, {fx('st')} AS peak_step, {fx('rr')} AS reference_rms, {fx('ro')} AS output_rms, {fx('r / nullif(rr, 0)')} AS error_ratio FROM s"""))
def f05(spark, sf):
    out = sg.compare_pcm(pair_signal(spark, sf), SK, "sample_ix", "y", "x")
    return fixed(fixed(out, ["rms", "peak", "peak_step", "reference_rms", "output_rms", "error_ratio"]), ["rms_dbfs"], 5)


@query("f05_compare_bands", with_ctes("dft", body=f"""
WITH z AS (SELECT a.track_id, a.frame, {BAND.replace('k *', 'a.k *')} AS band, CASE WHEN a.k IN (0, 32) THEN 1 ELSE 2 END / (64 * 24.0::DOUBLE) AS w, a.re * a.re + a.im * a.im AS r, pow(coalesce(b.re, a.re), 2) + pow(coalesce(b.im, a.im), 2) AS o,
 pow(coalesce(b.re, a.re) - a.re, 2) + pow(coalesce(b.im, a.im) - a.im, 2) AS e FROM dft a LEFT JOIN dft b ON a.track_id = b.track_id AND a.k = b.k AND b.frame = a.frame + 1),
f AS (SELECT track_id, frame, band, sum(w * r) AS r, sum(w * o) AS o, sum(w * e) AS e FROM z GROUP BY 1, 2, 3)
SELECT track_id, band, {fx('sqrt(avg(r))')} AS reference, {fx('sqrt(avg(o))')} AS output, {fx('sqrt(avg(e))')} AS error FROM f GROUP BY 1, 2"""))
def f05_bands(spark, sf):
    s = load(spark, sf, "spectra").select("track_id", "frame", "samples")
    after = s.select("track_id", (F.col("frame") - 1).alias("frame"), F.col("samples").alias("next"))
    both = s.join(after, ["track_id", "frame"], "left").withColumn("next", F.coalesce("next", "samples"))
    return fixed(sg.compare_bands(both, K, "next", "samples", 48000, 64), ["reference", "output", "error"])


@query("f12_si_sdr", with_ctes("pairsig", body=f"""
WITH s AS (SELECT track_id, channel, sum(x * x) AS t, sum(y * y) AS p, sum(x * y) AS c FROM pairsig GROUP BY 1, 2), n AS (SELECT *, c * c / t AS sig, p - c * c / t AS noise FROM s)
SELECT track_id, channel, {fx('least(greatest(10 * log10(sig / noise), -120), 120)', 5)} AS si_sdr FROM n"""))
def f12(spark, sf):
    return fixed(sg.si_sdr(pair_signal(spark, sf), SK, "y", "x"), ["si_sdr"], 5)


@query("f13_stereo_image", with_ctes("signal", body=f"""
WITH p AS (SELECT a.track_id, a.x AS l, b.x AS r FROM signal a JOIN signal b ON a.track_id = b.track_id AND a.sample_ix = b.sample_ix AND a.channel = 0 AND b.channel = 1)
SELECT track_id, {fx('corr(l, r)', 5)} AS correlation, {fx('20 * log10((sqrt(avg((l - r) * (l - r) / 2)) + 1e-10) / (sqrt(avg((l + r) * (l + r) / 2)) + 1e-10))', 5)} AS width_db FROM p GROUP BY 1"""))
def f13(spark, sf):
    s = load(spark, sf, "signal")
    left = s.filter("channel = 0").select("track_id", "sample_ix", F.col("x").alias("l"))
    right = s.filter("channel = 1").select("track_id", "sample_ix", F.col("x").alias("r"))
    return fixed(sg.stereo_image(left.join(right, ["track_id", "sample_ix"]), K, "l", "r"), ["correlation", "width_db"], 5)


@query("f13_cross_phase", with_ctes("bins", body=f"""
SELECT track_id, {fx('sum(abs(atan2(sin((pp - op) - (tp - pp)), cos((pp - op) - (tp - pp)))) * t * p) / sum(t * p)')} AS phase_error FROM bins GROUP BY 1"""))
def f13_phase(spark, sf):
    out = sp.cross_phase_error(load(spark, sf, "triples"), K, ("t", "tp", "p", "pp"), ("p", "pp", "o", "op"))
    return fixed(out, ["phase_error"])


def clips(spark, sf, length=32):
    return sg.excerpts(pair_signal(spark, sf), SK, "sample_ix", ["x", "y"], length)


LONG = 4096


def frames_sql(n: int, waves: dict[str, str]) -> str:
    """CTEs ``c``, ``g`` and ``z<n>``: spectra of all frames of the padded excerpts by their defining sums."""
    hop, bins = n // 4, n // 2 + 1
    win = f"(0.5 - 0.5 * cos(2 * pi() * (i - f * {hop}) / {n}))"
    angle = f"2 * pi() * k * (i - f * {hop}) / {n}"
    sums = ", ".join(f"sum({v} * {win} * cos({angle})) AS {name}r, sum({v} * {win} * sin({angle})) AS {name}i" for name, v in waves.items())
    made = ", ".join(f"greatest(sqrt(coalesce({name}r, 0) * coalesce({name}r, 0) + coalesce({name}i, 0) * coalesce({name}i, 0)), 1e-10) AS {name}, coalesce({name}r, 0) AS {name}r, coalesce({name}i, 0) AS {name}i" for name in waves)
    return f"""r{n} AS (SELECT track_id, channel, excerpt, f, k, {sums} FROM c, range({(LONG - n) // hop + 1}) a(f), range({bins}) b(k) WHERE i >= f * {hop} AND i < f * {hop} + {n} GROUP BY 1, 2, 3, 4, 5),
z{n} AS (SELECT g.*, f, k, {made} FROM g CROSS JOIN range({(LONG - n) // hop + 1}) a(f) CROSS JOIN range({bins}) b(k) LEFT JOIN r{n} USING (track_id, channel, excerpt, f, k))"""


LONG_CLIPS = f"""c AS (SELECT track_id, channel, sample_ix // {LONG} AS excerpt, sample_ix % {LONG} AS i, x, y FROM pairsig), g AS (SELECT DISTINCT track_id, channel, excerpt FROM c)"""


def multires_sql(sizes: tuple[int, ...]) -> str:
    steps, ends = [LONG_CLIPS], []
    for n in sizes:
        bins = n // 2 + 1
        unit = f"sqrt(CASE WHEN k IN (0, {bins - 1}) THEN 1 ELSE 2 END / ({n} * {n * 0.375}::DOUBLE))"
        band = f"CASE WHEN k * 48000 / {n}.0 < 4000 THEN 0 WHEN k * 48000 / {n}.0 < 8000 THEN 4000 WHEN k * 48000 / {n}.0 < 12000 THEN 8000 WHEN k * 48000 / {n}.0 < 16000 THEN 12000 ELSE 16000 END"
        steps.append(frames_sql(n, {"p": "y", "t": "x"}))
        steps.append(f"""m{n} AS (SELECT track_id, channel, excerpt, f, k, {band} AS band, p * {unit} AS p, t * {unit} AS t FROM z{n}),
f{n} AS (SELECT track_id, channel, excerpt, avg(s) * 1e-4 + 1e-12 AS fl FROM (SELECT track_id, channel, excerpt, f, sum(t * t) AS s FROM m{n} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
d{n} AS (SELECT *, p - t - lag(p - t) OVER (PARTITION BY track_id, channel, excerpt, k ORDER BY f) AS d, count(*) OVER (PARTITION BY track_id, channel, excerpt, f, band) AS nb FROM m{n} JOIN f{n} USING (track_id, channel, excerpt)),
b{n} AS (SELECT track_id, channel, excerpt, f, band, sum((p - t) * (p - t)) AS ee, sum(t * t) AS tt, sum(p * p) AS pp, avg(pow(ln(1 + p / sqrt(fl / nb)) - ln(1 + t / sqrt(fl / nb)), 2)) AS ll, sum(d * d) AS dd, max(fl) AS fl FROM d{n} GROUP BY 1, 2, 3, 4, 5),
a{n} AS (SELECT track_id, channel, excerpt, band, avg(ee) AS ee, avg(tt) + max(fl) AS den, avg(ll) AS ll, avg(pow(sqrt(pp + fl) - sqrt(tt + fl), 2)) AS env, avg(dd) AS dd FROM b{n} GROUP BY 1, 2, 3, 4),
e{n} AS (SELECT track_id, channel, excerpt, CAST({n} AS INT) AS size, band, unnest(['amplitude', 'log_shape', 'envelope', 'dynamics']) AS component,
 unnest([sqrt(ee / den + 1e-6) - 1e-3, sqrt(ll + 1e-6) - 1e-3, sqrt(env / den + 1e-6) - 1e-3, sqrt(coalesce(dd, 0) / den + 1e-6) - 1e-3]) AS v, unnest([1.0::DOUBLE, 0.25, 0.1, 0.25]) AS w FROM a{n})""")
        ends.append(f"SELECT * FROM e{n}")
    weight = f"v * w / {len(sizes)}.0 * (CASE WHEN band = 0 THEN 0.25 ELSE 1 END / 4.25::DOUBLE)"
    return "WITH " + ",\n".join(steps) + f"\nSELECT track_id, channel, excerpt, size, CAST(band AS INT) AS band, component, {fx('v')} AS value, {fx(weight)} AS weighted FROM ({' UNION ALL '.join(ends)})"


@query("f15_multires_score", with_ctes("pairsig", body=multires_sql((256, 1024, 2048))))
def f15(spark, sf):
    out = sg.multires_score(clips(spark, sf, LONG), SK, "y", "x", 48000)
    return fixed(out, ["value", "weighted"])


@query("f22_inverse_error", with_ctes("dft", body=f"""
WITH d AS (SELECT a.track_id, a.frame, a.k, coalesce(b.re, a.re) - a.re AS re, coalesce(b.im, a.im) - a.im AS im FROM dft a LEFT JOIN dft b ON a.track_id = b.track_id AND a.k = b.k AND b.frame = a.frame + 1),
y AS (SELECT track_id, frame, j, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * j / 64) - im * sin(2 * pi() * k * j / 64))) / 64 AS x FROM d, range(64) g(j) GROUP BY 1, 2, 3)
SELECT track_id, {fx('max(abs(x))')} AS max_inverse_error FROM y GROUP BY 1"""))
def f22_inverse(spark, sf):
    s = load(spark, sf, "spectra").select("track_id", "frame", "samples")
    after = s.select("track_id", (F.col("frame") - 1).alias("frame"), F.col("samples").alias("next"))
    d = s.join(after, ["track_id", "frame"], "left").withColumn("e", F.zip_with(F.coalesce("next", "samples"), "samples", lambda a, b: a - b))
    # The spectra differ linearly, so the inverse of their difference is the windowed sample difference.
    back = sg.inverse(sg.stft(d, "e"), "log_magnitude", "phase", 64, "y")
    window = F.array(*[F.lit(float(v)) for v in sg.hann(64)])
    err = F.zip_with("y", window, lambda a, w: F.when(w > 0, F.abs(a / w)).otherwise(0.0))
    return fixed(back.groupBy(*K).agg(F.max(F.array_max(err)).alias("max_inverse_error")), ["max_inverse_error"])


def delayed(spark, sf):
    """Excerpts and copies delayed by track_id mod 4 samples (zero filled)."""
    c = clips(spark, sf).withColumn("k", (F.col("track_id") % 4).cast("int"))
    return c.withColumn("z", F.concat(F.array_repeat(F.lit(0.0), F.col("k")), F.slice("x", F.lit(1), F.size("x") - F.col("k"))))


@query("f23_delay_estimate", with_ctes("signal", body="""
WITH c AS (SELECT track_id, channel, sample_ix // 32 AS excerpt, sample_ix % 32 AS i, x FROM signal), n AS (SELECT DISTINCT track_id, channel, excerpt FROM c),
b AS (SELECT n.*, i, coalesce(x, 0) AS x FROM n CROSS JOIN range(32) h(i) LEFT JOIN c USING (track_id, channel, excerpt, i)),
z AS (SELECT a.track_id, a.channel, a.excerpt, a.i, a.x, coalesce(d.x, 0) AS z FROM b a LEFT JOIN b d ON a.track_id = d.track_id AND a.channel = d.channel AND a.excerpt = d.excerpt AND d.i = a.i - a.track_id % 4),
m AS (SELECT *, x - avg(x) OVER w AS xc, z - avg(z) OVER w AS zc FROM z WINDOW w AS (PARTITION BY track_id, channel, excerpt)),
r AS (SELECT p.track_id, p.channel, p.excerpt, l AS lag, sum(p.xc * q.zc) AS c FROM m p, range(-6, 7) g(l), m q WHERE q.track_id = p.track_id AND q.channel = p.channel AND q.excerpt = p.excerpt AND q.i = p.i + l GROUP BY 1, 2, 3, 4)
SELECT track_id, channel, excerpt, CAST(max_by(lag, c) AS INT) AS delay FROM r GROUP BY 1, 2, 3"""))
def f23(spark, sf):
    return sg.delay_estimate(delayed(spark, sf), "x", "z", 48000, 6, cutoff_hz=None).select(*SK, "excerpt", "delay")


@query("f24_align_pairs")
def f24(spark, sf):
    out = sg.align_pairs(delayed(spark, sf), "x", "z", 48000, 6, 1)
    return out.select(*SK, "excerpt", "offset", "residual", F.size("x").alias("aligned"), "reason")


@query("f25_channel_roles", with_ctes("spectra", body=f"""
WITH p AS (SELECT a.track_id, a.frame, unnest(range(64)) + 1 AS j, unnest(a.samples) AS l, unnest(b.samples) AS r FROM spectra a LEFT JOIN spectra b ON a.track_id = b.track_id AND b.frame = a.frame + 1),
s AS (SELECT track_id, frame, sum(l * j) AS l, CASE WHEN count(r) > 0 THEN sum(r * j) END AS r FROM p GROUP BY 1, 2),
e AS (SELECT track_id, frame, unnest(CASE WHEN r IS NULL THEN ['mono'] ELSE ['left','right','mid','side'] END) AS role, unnest(CASE WHEN r IS NULL THEN [l] ELSE [l, r, (l + r) / sqrt(2), (l - r) / sqrt(2)] END) AS v FROM s)
SELECT track_id, frame, role, {fx('v')} AS moment, CASE role WHEN 'mono' THEN 1.0::DOUBLE WHEN 'side' THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS weight FROM e"""))
def f25(spark, sf):
    s = load(spark, sf, "spectra").select("track_id", "frame", F.col("samples").alias("l"))
    after = s.select("track_id", (F.col("frame") - 1).alias("frame"), F.col("l").alias("r"))
    out = sg.channel_roles(s.join(after, ["track_id", "frame"], "left"), "l", "r", {"mono": 1.0, "left": 0.75, "right": 0.75, "mid": 0.75, "side": 0.5})
    return out.select("track_id", "frame", "role", fix(weigh(F.col("samples"))).alias("moment"), "weight")


@query("f28_limit", with_ctes("signal", body=f"""
WITH v AS (SELECT track_id, channel, sample_ix, x * 3 AS x FROM signal)
SELECT track_id, channel, sample_ix, {fx('CASE WHEN abs(x) <= 0.855 THEN x ELSE sign(x) * least(greatest(0.855 + 0.095 * (1 - exp(-(abs(x) - 0.855) / (0.095 * 4))), 0), 0.95) END')} AS legacy,
 {fx('CASE WHEN abs(x) <= 0.855 THEN x ELSE sign(x) * least(0.95 * (0.9 + 0.1 * tanh((abs(x) / 0.95 - 0.9) * 10)), 0.95) END')} AS smooth FROM v"""))
def f28(spark, sf):
    x = F.col("x") * 3
    return load(spark, sf, "signal").select(*SK, "sample_ix", fix(sg.limit(x, 0.95)).alias("legacy"), fix(sg.limit(x, 0.95, "smooth")).alias("smooth"))


@query("f30_spectral_extension")
def f30(spark, sf):
    z = sg.stft(load(spark, sf, "spectra").select("track_id", "frame", "samples")).withColumn("magnitude", F.transform("log_magnitude", lambda d: F.pow(F.lit(10.0), d / 20)))
    z = z.withColumn("smoothed", 9000.0 + F.col("frame") % 3 * 1500.0)
    out = sg.spectral_extension(z, K, 64, 16, 48000)
    return out.select("track_id", "frame", fix(F.col("strength")).alias("strength"), fix(sp.total(F.col("candidate"))).alias("candidate"), fix(sp.total(F.col("candidate_phase")), 4).alias("phase"))


@query("f31_restore_batch")
def f31(spark, sf):
    out = sg.restore_batch(load(spark, sf, "signal"), SK, "sample_ix", "x", 16, 4, 48000, 6000.0, threshold_db=-10.0, min_ratio=0.95, hangover=2, hold=4, ramp=4)
    return fixed(out, ["dry", "wet", "mix", "output"])


@query("f33_control_signals")
def f33(spark, sf):
    out = sg.control_signals(load(spark, sf, "triples"), K, 24000 / 63, 64, 7)
    return out.select("track_id", "frame", fix(weigh(F.col("energy_matched"))).alias("energy_matched"), fix(sp.total(F.col("phase_scrambled")), 4).alias("phase_scrambled"), fix(sp.total(F.col("time_shifted")), 4).alias("time_shifted"))


@query("f34_quantise", with_ctes("signal", body=f"""
WITH q AS (SELECT track_id, channel, x, round_even(x * 128, 0) / 128 AS q FROM signal) SELECT track_id, channel, {fx('sqrt(avg((q - x) * (q - x)))', 8)} AS error_rms, max(abs(q - x)) <= 1.0 / 256 + 1e-12 AS bounded, count(*) AS n FROM q GROUP BY 1, 2"""))
def f34(spark, sf):
    q = load(spark, sf, "signal").withColumn("q", sg.quantise(F.col("x"), 8))
    e = F.col("q") - F.col("x")
    return q.groupBy(*SK).agg(fix(F.sqrt(F.avg(e * e)), 8).alias("error_rms"), (F.max(F.abs(e)) <= 1 / 256 + 1e-12).alias("bounded"), F.count(F.lit(1)).alias("n"))


@query("f34_error_rulers", with_ctes("signal", body=f"""
WITH v AS (SELECT track_id, channel, sample_ix, round_even(x * 128, 0) / 128 - x AS a, round_even(x * 32, 0) / 32 - x AS b FROM signal),
d AS (SELECT *, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM v WINDOW w AS (PARTITION BY track_id, channel ORDER BY sample_ix)),
s AS (SELECT track_id, channel, unnest(['rms','peak','difference_rms','boundary_difference_rms']) AS statistic,
 unnest([sqrt(avg(a * a)), max(abs(a)), sqrt(avg(da * da)), sqrt(avg(da * da) FILTER (sample_ix % 8 = 0))]) AS x, unnest([sqrt(avg(b * b)), max(abs(b)), sqrt(avg(db * db)), sqrt(avg(db * db) FILTER (sample_ix % 8 = 0))]) AS y FROM d GROUP BY 1, 2)
SELECT track_id, channel, statistic, {fx('x')} AS before, {fx('y')} AS after, CASE WHEN contains(statistic, 'difference') THEN 2 ELSE 1 END / 64.0::DOUBLE AS allowance,
 coalesce(y - x <= CASE WHEN contains(statistic, 'difference') THEN 2 ELSE 1 END / 64.0::DOUBLE, true) AS passed FROM s"""))
def f34_rulers(spark, sf):
    s = load(spark, sf, "signal").withColumn("a", sg.quantise(F.col("x"), 8)).withColumn("b", sg.quantise(F.col("x"), 6))
    return fixed(sg.error_rulers(s, SK, "sample_ix", "b", "a", "x", 6, hop=8), ["before", "after"])


@query("f35_attenuate", with_ctes("signal", body=f"""
WITH v AS (SELECT track_id, channel, x * 4 AS x FROM signal), p AS (SELECT track_id, max(abs(x)) AS peak FROM v GROUP BY 1 HAVING max(abs(x)) > 1.0001),
y AS (SELECT v.track_id, p.peak, 0.95::DOUBLE / p.peak AS g, x * (0.95::DOUBLE / p.peak) AS y FROM v JOIN p USING (track_id))
SELECT track_id, {fx('max(peak)')} AS peak, {fx('max(g)')} AS gain, {fx('max(abs(y::FLOAT::DOUBLE - y))', 12)} AS max_error, count(*) AS samples, {fx('20 * log10(max(g))', 5)} AS gain_db,
 max(abs(y::FLOAT::DOUBLE - y)) <= 1.1920928955078125e-07 * 0.95 AS ok FROM y GROUP BY 1"""))
def f35(spark, sf):
    s = load(spark, sf, "signal").select("track_id", "channel", (F.col("x") * 4).alias("x"))
    return fixed(fixed(fixed(sg.attenuate(s, K, "x"), ["peak", "gain"]), ["max_error"], 12), ["gain_db"], 5)


@query("f36_band_transfer")
def f36(spark, sf):
    return fixed(sg.band_transfer(sg.stft(load(spark, sf, "spectra").select("track_id", "frame", "samples")), K, 64, 16, 48000), ["rms"])


@query("f37_chunk_equivalence", with_ctes("signal", body="SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing, true AS equivalent FROM signal"))
def f37(spark, sf):
    s = load(spark, sf, "signal").withColumn("a", F.lit(0.9)).withColumn("b", F.col("x") * 0.1)
    one = affine_scan(s, SK, "sample_ix", "a", "b", 0.0, "y", rows=7)
    two = affine_scan(s, SK, "sample_ix", "a", "b", 0.0, "y")
    out = sg.chunk_equivalence(one, two, [*SK, "sample_ix"], "y")
    return out.select("rows", "missing", (F.col("max_difference") <= 1e-9).alias("equivalent"))


@query("f40_spectral_consistency")
def f40_consistency(spark, sf):
    z = sg.stft(load(spark, sf, "spectra").select("track_id", "frame", "samples"))
    return fixed(sg.spectral_consistency(z, K, 64, 16), ["inconsistency"])


def reconstruction_sql(sizes: tuple[int, ...], cut: float, width: float) -> str:
    steps, ends = [LONG_CLIPS.replace(", x, y FROM", ", x, y, x * 0.5 AS h FROM")], []
    low, high = cut - width / 2, cut + width / 2
    for n in sizes:
        hz = f"(k * 48000 / {n}.0::DOUBLE)"
        w = f"CASE WHEN {hz} <= {low} THEN 0 WHEN {hz} >= {high} THEN 1 ELSE 0.5 * (1 - cos(pi() * ({hz} - {low}) / {high - low}::DOUBLE)) END"
        steps.append(frames_sql(n, {"p": "y", "t": "x", "d": "h"}))
        steps.append(f"""m{n} AS (SELECT *, {w} AS w, p - lag(p) OVER v AS p1, t - lag(t) OVER v AS t1 FROM z{n} WINDOW v AS (PARTITION BY track_id, channel, excerpt, k ORDER BY f)),
b{n} AS (SELECT track_id, channel, excerpt, f, sum((p - t) * (p - t) * w) AS e, sum(t * t * w) AS b, sum(p * p * w) AS bp, sum(t * t) AS q, count(*) AS n, sum((p1 - t1) * (p1 - t1) * w) AS de, sum(t1 * t1 * w) AS db, sum(CASE WHEN t1 IS NOT NULL THEN t * t END) AS dq,
 sum((pow(pr - dr, 2) + pow(pi - di, 2)) * (1 - w)) AS le, sum(d * d * (1 - w)) AS lb, sum(d * d) AS lq FROM m{n} GROUP BY 1, 2, 3, 4),
e{n} AS (SELECT track_id, channel, excerpt, sqrt(sum(e)) / greatest(sqrt(sum(b)), sqrt(sum(q)) * 0.01, 1e-7) AS s1, avg(abs(10 * log10(greatest(bp / n, greatest(q / n * 1e-4, 1e-14)) / greatest(b / n, greatest(q / n * 1e-4, 1e-14))))) AS s2,
 sqrt(sum(de)) / greatest(sqrt(sum(db)), sqrt(sum(dq)) * 0.01, 1e-7) AS s3, sqrt(sum(le)) / greatest(sqrt(sum(lb)), sqrt(sum(lq)) * 0.01, 1e-7) AS s4 FROM b{n} GROUP BY 1, 2, 3)""")
        ends.append(f"SELECT * FROM e{n}")
    return "WITH " + ",\n".join(steps) + f"\nSELECT track_id, channel, excerpt, {fx('avg(s1)')} AS high_spectral, {fx('avg(s2)')} AS high_energy, {fx('avg(s3)')} AS high_temporal, {fx('avg(s4)')} AS low_complex FROM ({' UNION ALL '.join(ends)}) GROUP BY 1, 2, 3"


@query("f43_multires_reconstruction", with_ctes("pairsig", body=reconstruction_sql((512, 1024, 2048), 9000.0, 4000.0)))
def f43(spark, sf):
    c = clips(spark, sf, LONG).withColumn("d", F.transform("x", lambda v: v * 0.5)).withColumn("cut", F.lit(9000.0))
    out = sg.multires_reconstruction(c, SK, "y", "x", "d", "cut", 48000, 4000.0)
    return fixed(out, ["high_spectral", "high_energy", "high_temporal", "low_complex"])


@query("f50_longform_score", with_ctes("pairsig", body=f"""
WITH c AS (SELECT track_id, channel, sample_ix // 32 AS excerpt, sample_ix % 32 AS i, x, y - x AS e FROM pairsig),
z AS (SELECT c.track_id, c.channel, c.excerpt, k, sum(x * cos(2 * pi() * k * i / 32)) / 32 AS xr, sum(x * sin(2 * pi() * k * i / 32)) / 32 AS xi, sum(e * cos(2 * pi() * k * i / 32)) / 32 AS er, sum(e * sin(2 * pi() * k * i / 32)) / 32 AS ei, count(*) AS n
 FROM c, range(17) g(k) GROUP BY 1, 2, 3, 4), b AS (SELECT *, k * 1500 AS hz, CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS w FROM z)
SELECT track_id, channel, excerpt, CASE WHEN hz < 4000 THEN 0 WHEN hz < 8000 THEN 4000 WHEN hz < 12000 THEN 8000 WHEN hz < 16000 THEN 12000 ELSE 16000 END AS band,
 {fx('sqrt(sum(w * (xr * xr + xi * xi)) * 32 / max(n))')} AS reference_rms, {fx('sqrt(sum(w * (er * er + ei * ei)) * 32 / max(n))')} AS error_rms FROM b GROUP BY 1, 2, 3, 4"""))
def f50(spark, sf):
    return fixed(sg.longform_score(clips(spark, sf), SK, [("y", "x")], 48000, 32), ["reference_rms", "error_rms"])


@query("f50_mid_side_error", with_ctes("pairsig", body=f"""
WITH p AS (SELECT a.track_id, a.y - a.x AS l, b.y - b.x AS r FROM pairsig a JOIN pairsig b ON a.track_id = b.track_id AND a.sample_ix = b.sample_ix AND a.channel = 0 AND b.channel = 1)
SELECT track_id, {fx('sqrt(avg((l + r) * (l + r) / 4))')} AS mid_error_rms, {fx('sqrt(avg((l - r) * (l - r) / 4))')} AS side_error_rms FROM p GROUP BY 1"""))
def f50_ms(spark, sf):
    s = pair_signal(spark, sf).withColumn("e", F.col("y") - F.col("x"))
    both = s.filter("channel = 0").select("track_id", "sample_ix", F.col("e").alias("l")).join(s.filter("channel = 1").select("track_id", "sample_ix", F.col("e").alias("r")), ["track_id", "sample_ix"])
    return fixed(sg.mid_side_error(both, K, "l", "r"), ["mid_error_rms", "side_error_rms"])
