"""Spectral metrics over tables of frames.

A row is one frame of one clip with aligned magnitude arrays: ``t`` reference, ``p`` prediction,
``o`` original input, and phases ``tp, pp, op``. Per-frame arithmetic stays in the JVM as array
expressions; clip results are sums of per-frame values, so partial sums combine map-side and a
long clip is never gathered. All norms and floors depend on the reference only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.numeric import clamp, wrap_pi
from wavelane.functions.ordinals import lagged

# Score bands in Hz, their weights, floors and smoothing.
BANDS = ((0, 4000), (4000, 8000), (8000, 12000), (12000, 16000), (16000, 24001))
EDGES_2K = tuple(range(0, 24000, 2000)) + (24001,)
SMOOTH = 1e-3
WEIGHTS = {"amplitude": 1.0, "log_shape": 0.25, "envelope": 0.1, "dynamics": 0.25}


def band_weight(low: Column) -> Column:
    """The lowest band counts a quarter; weights sum to one."""
    return F.when(low == 0, F.lit(0.25 / 4.25)).otherwise(F.lit(1 / 4.25))


def soft(power: Column, denominator: Column) -> Column:
    """Smooth norm: zero at zero error."""
    return F.sqrt(power / denominator + F.lit(SMOOTH * SMOOTH)) - F.lit(SMOOTH)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squares(a: Column) -> Column:
    return F.transform(a, lambda x: x * x)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def square_error(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y) * (x - y))


def real(mag: Column, ph: Column) -> Column:
    return F.zip_with(mag, ph, lambda m, a: m * F.cos(a))


def imag(mag: Column, ph: Column) -> Column:
    return F.zip_with(mag, ph, lambda m, a: m * F.sin(a))


def complex_error(m1: Column, a1: Column, m2: Column, a2: Column) -> Column:
    """|m1 e^(i a1) - m2 e^(i a2)|^2 per bin."""
    re, im = square_error(real(m1, a1), real(m2, a2)), square_error(imag(m1, a1), imag(m2, a2))
    return F.zip_with(re, im, lambda x, y: x + y)


def band_bins(bin_hz: float, bins: int, bands: Sequence[tuple[int, int]] = BANDS) -> list[tuple[int, int, int]]:
    """(low edge, first bin, bin count) of each band that has bins."""
    out = []
    for low, high in bands:
        inside = [k for k in range(bins) if low <= k * bin_hz < high]
        if inside:
            out.append((low, inside[0], len(inside)))
    return out


def band_sums(df: DataFrame, keep: Sequence[str], arrays: dict[str, Column], cuts: list[tuple[int, int, int]]) -> DataFrame:
    """One row per frame and band: ``keep, band, bins`` and the sum of each array over the band."""
    made = df.select(*keep, *[c.alias(f"_{n}") for n, c in arrays.items()])
    rows = [
        F.struct(F.lit(low).alias("band"), F.lit(count).alias("bins"), *[total(F.slice(f"_{n}", first + 1, count)).alias(n) for n in arrays])
        for low, first, count in cuts
    ]
    return made.select(*keep, F.explode(F.array(*rows)).alias("_r")).select(*keep, "_r.*")


def with_previous(df: DataFrame, keys: list[str], names: Sequence[str], burn: int = 0) -> DataFrame:
    """Supervised frames with the previous supervised frame's arrays as ``<name>0`` (NULL on the first)."""
    out = lagged(df, keys, "frame", {n: f"{n}0" for n in names}).filter(F.col("frame") >= burn)
    if burn:
        for n in names:
            out = out.withColumn(f"{n}0", F.when(F.col("frame") > burn, F.col(f"{n}0")))
    return out


def c(name: str) -> Column:
    return F.col(name)


# --- F08-F11, F14, F16: log-spectral distance, convergence, energy, flux -------------------------


def lsd(df: DataFrame, keys: list[str], bin_hz: float, cut_hz: float, predicted: str = "p", target: str = "t") -> DataFrame:
    """Mean over frames of the RMS dB difference: whole spectrum, below and from ``cut_hz`` on."""
    def db(v):
        return F.transform(v, lambda x: 20 * F.log10(F.greatest(x, F.lit(1e-10))))
    first = int(-(-cut_hz // bin_hz)) if cut_hz % bin_hz else int(cut_hz // bin_hz)
    e = df.select(*keys, square_error(db(c(predicted)), db(c(target))).alias("_e"))
    size = F.size("_e")
    return e.groupBy(*keys).agg(
        F.avg(F.sqrt(total(c("_e")) / size)).alias("lsd"),
        F.avg(F.sqrt(total(F.slice("_e", 1, first)) / first)).alias("lsd_low"),
        F.avg(F.sqrt(total(F.slice("_e", F.lit(first + 1), size - first)) / (size - first))).alias("lsd_high"),
    )


def convergence_rule(error: Column, scale: Column) -> Column:
    """Relative norm with the silence rule: 0 for silent equality, 1e6 for energy over silence."""
    return F.when(scale <= 1e-20, F.when(error <= 1e-20, 0.0).otherwise(1e6)).otherwise(error / scale)


def spectral_convergence(df: DataFrame, keys: list[str], predicted: str = "p", target: str = "t") -> DataFrame:
    """||p - t|| / ||t|| over the whole clip."""
    s = df.groupBy(*keys).agg(F.sqrt(F.sum(total(square_error(c(predicted), c(target))))).alias("_e"), F.sqrt(F.sum(total(squares(c(target))))).alias("_t"))
    return s.select(*keys, convergence_rule(c("_e"), c("_t")).alias("convergence"))


def energy_bias(df: DataFrame, keys: list[str], first_bin: int, predicted: str = "p", target: str = "t") -> DataFrame:
    """Signed and absolute high-band power ratio in dB with a 1e-20 floor on mean powers."""
    def mean_power(v):
        tail = F.slice(v, F.lit(first_bin + 1), F.size(v) - first_bin)
        return F.sum(total(squares(tail))) / F.sum(F.size(v) - first_bin)
    s = df.groupBy(*keys).agg(mean_power(c(predicted)).alias("_p"), mean_power(c(target)).alias("_t"))
    bias = 10 * F.log10((c("_p") + 1e-20) / (c("_t") + 1e-20))
    return s.select(*keys, bias.alias("energy_bias_db"), F.abs(bias).alias("energy_error_db"))


def rises(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))


def flux_error(df: DataFrame, keys: list[str], first_bin: int, predicted: str = "p", target: str = "t") -> DataFrame:
    """Relative error of positive flux above ``first_bin``."""
    d = with_previous(df.select(*keys, "frame", c(predicted).alias("p"), c(target).alias("t")), keys, ["p", "t"]).filter(c("t0").isNotNull())
    def high(v):
        return F.slice(v, F.lit(first_bin + 1), F.size(v) - first_bin)
    actual, wanted = high(rises(c("p"), c("p0"))), high(rises(c("t"), c("t0")))
    s = d.groupBy(*keys).agg(F.sqrt(F.sum(total(square_error(actual, wanted)))).alias("_e"), F.sqrt(F.sum(total(squares(wanted)))).alias("_t"))
    return s.select(*keys, convergence_rule(c("_e"), c("_t")).alias("flux_error"))


def triplet_metrics(df: DataFrame, keys: list[str], bin_hz: float, cut_hz: float) -> DataFrame:
    """``keys, metric, baseline, enhanced, delta``: input and prediction against the reference."""
    first = int(-(-cut_hz // bin_hz))
    def one(predicted: str) -> DataFrame:
        parts = [lsd(df, keys, bin_hz, cut_hz, predicted), spectral_convergence(df, keys, predicted), energy_bias(df, keys, first, predicted), flux_error(df, keys, first, predicted)]
        wide = reduce(lambda a, b: a.join(b, keys), parts)
        names = ["lsd", "lsd_high", "convergence", "energy_error_db", "flux_error"]
        return wide.select(*keys, *names).unpivot(keys, names, "metric", "value")
    both = one("o").withColumnRenamed("value", "baseline").join(one("p").withColumnRenamed("value", "enhanced"), [*keys, "metric"])
    return both.withColumn("delta", c("enhanced") - c("baseline"))


def band_metrics(df: DataFrame, keys: list[str], bin_hz: float, bins: int, burn: int = 0) -> DataFrame:
    """Per band: convergence, flux error, energy bias and error, reference power in dB."""
    d = with_previous(df, keys, ["p", "t"], burn)
    fp, ft = rises(c("p"), c("p0")), rises(c("t"), c("t0"))
    sums = band_sums(d, keys, {"e": square_error(c("p"), c("t")), "t2": squares(c("t")), "p2": squares(c("p")), "fe": square_error(fp, ft), "ft": squares(ft)}, band_bins(bin_hz, bins))
    s = sums.groupBy(*keys, "band").agg(*[F.sum(n).alias(n) for n in ("e", "t2", "p2", "fe", "ft")], F.sum("bins").alias("n"))
    def floor(x, low):
        return F.greatest(x, F.lit(low))
    bias = 10 * F.log10(floor(c("p2") / c("n"), 1e-20) / floor(c("t2") / c("n"), 1e-20))
    return s.select(
        *keys, "band", (F.sqrt("e") / floor(F.sqrt("t2"), 1e-10)).alias("sc"),
        (F.sqrt(F.coalesce("fe", F.lit(0.0))) / floor(F.sqrt(F.coalesce("ft", F.lit(0.0))), 1e-10)).alias("flux"),
        bias.alias("energy_bias_db"), F.abs(bias).alias("energy_error_db"), (10 * F.log10(floor(c("t2") / c("n"), 1e-20))).alias("reference_power_db"),
    )


def high_means(metrics: DataFrame, keys: list[str], names: Sequence[str]) -> DataFrame:
    """Unweighted mean of the bands above the lowest."""
    return metrics.filter(c("band") > 0).groupBy(*keys).agg(*[F.avg(n).alias(f"high_{n}") for n in names])


# --- F17, F21, F44, F45, F49: objective decompositions ------------------------------------------


def clip_power(df: DataFrame, keys: list[str], burn: int = 0, name: str = "t") -> DataFrame:
    """Mean reference power over the clip's supervised frames and bins, ``_g``."""
    return df.filter(c("frame") >= burn).groupBy(*keys).agg((F.sum(total(squares(c(name)))) / F.sum(F.size(name))).alias("_g"))


def error_bands(df: DataFrame, keys: list[str], bin_hz: float, bins: int, burn: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per clip and band: mean reference, output, error and error-dynamics power (per bin)."""
    d = with_previous(df, keys, ["p", "t"], burn)
    change = square_error(minus(c("p"), c("t")), minus(c("p0"), c("t0")))
    arrays = {"t2": squares(c("t")), "p2": squares(c("p")), "e2": square_error(c("p"), c("t")), "d2": change, **(extra or {})}
    sums = band_sums(d, keys, arrays, band_bins(bin_hz, bins))
    return sums.groupBy(*keys, "band").agg(
        F.max("bins").alias("bins"), *[(F.sum(n) / F.sum("bins")).alias(n) for n in arrays if n != "d2"],
        (F.sum("d2") / F.sum(F.when(c("d2").isNotNull(), c("bins")))).alias("d2"),
    )


def loss_parts(df: DataFrame, keys: list[str], bin_hz: float, bins: int, burn: int = 0, relative: float = 0.01, absolute: float = 1e-7) -> DataFrame:
    """Per band: RMS values, normaliser, floor dominance, amplitude and dynamics loss."""
    s = error_bands(df, keys, bin_hz, bins, burn).join(clip_power(df, keys, burn), keys)
    floor = F.greatest(F.sqrt("_g") * relative, F.lit(absolute))
    den = c("t2") + floor * floor
    w = band_weight(c("band"))
    amplitude, dynamics = w * soft(c("e2"), den), 0.25 * w * soft(c("d2"), den)
    return s.select(
        *keys, "band", "bins", F.sqrt("t2").alias("reference_rms"), F.sqrt("p2").alias("output_rms"), F.sqrt("e2").alias("error_rms"),
        floor.alias("floor"), (c("t2") <= floor * floor).alias("floor_dominated"), amplitude.alias("amplitude_loss"),
        dynamics.alias("dynamics_loss"), (amplitude + dynamics).alias("total"),
    )


def global_balanced_spectrum(df: DataFrame, keys: list[str], bin_hz: float, bins: int, burn: int = 0) -> DataFrame:
    """Band error plus a quarter of its dynamics over band + full reference power: one score per clip."""
    s = error_bands(df, keys, bin_hz, bins, burn).join(clip_power(df, keys, burn), keys)
    den = c("t2") + c("_g") + 1e-14
    return s.groupBy(*keys).agg(F.sum(band_weight(c("band")) * (soft(c("e2"), den) + 0.25 * soft(c("d2"), den))).alias("score"))


def direct_spectrum_score(df: DataFrame, keys: list[str], bin_hz: float, bins: int, burn: int = 0) -> DataFrame:
    """Per clip: amplitude, complex, envelope and dynamics components and their weighted total."""
    floors = clip_power(df, keys, burn).select(*keys, (c("_g") * 1e-4 + 1e-14).alias("_f"))
    d = with_previous(df, keys, ["p", "t"], burn)
    arrays = {"t2": squares(c("t")), "p2": squares(c("p")), "e2": square_error(c("p"), c("t")), "c2": complex_error(c("p"), c("pp"), c("t"), c("tp")),
              "d2": square_error(minus(c("p"), c("t")), minus(c("p0"), c("t0")))}
    frames = band_sums(d, keys, arrays, band_bins(bin_hz, bins)).join(floors, keys)
    n = c("bins")
    env = F.sqrt(c("p2") / n + c("_f")) - F.sqrt(c("t2") / n + c("_f"))
    bands = frames.groupBy(*keys, "band").agg(
        (F.avg(c("t2") / n) + F.max("_f")).alias("den"), F.avg(c("e2") / n).alias("e2"), F.avg(c("c2") / n).alias("c2"), F.avg(env * env).alias("v2"), F.avg(c("d2") / n).alias("d2"),
    )
    w = band_weight(c("band"))
    parts = {"amplitude": "e2", "complex": "c2", "envelope": "v2", "dynamics": "d2"}
    out = bands.groupBy(*keys).agg(*[F.sum(w * soft(c(v), c("den"))).alias(k) for k, v in parts.items()])
    return out.withColumn("score", c("amplitude") + c("complex") + 0.1 * c("envelope") + 0.25 * c("dynamics"))


def paired_identity_risk(scores: DataFrame, identity: str, score: str = "score") -> DataFrame:
    """Half the mean over paired clips plus half the mean over identity clips; NULL if one is missing."""
    return scores.agg((0.5 * F.avg(F.when(~c(identity), c(score))) + 0.5 * F.avg(F.when(c(identity), c(score)))).alias("risk"))


def shape_energy_terms(df: DataFrame, keys: list[str], bin_hz: float, bins: int, burn: int = 0, relative: float = 1e-3, absolute: float = 1e-7) -> DataFrame:
    """Per band: log-envelope error, confident shape error, envelope dynamics, log amplitude, weak share."""
    g = clip_power(df, keys, burn).select(*keys, F.greatest(F.sqrt("_g") * relative, F.lit(absolute)).alias("_f"), F.greatest(F.sqrt("_g") * 0.01, F.lit(1e-5)).alias("_a"))
    d = with_previous(df, keys, ["p", "t"], burn).join(g, keys)
    amp = F.zip_with("p", "t", lambda x, y: F.abs(F.log1p(x / c("_a")) - F.log1p(y / c("_a"))))
    cuts = band_bins(bin_hz, bins)
    rows = []
    for low, first, n in cuts:
        def part(name, first=first, n=n):
            return F.slice(name, first + 1, n)
        pn, tn = [F.sqrt(total(squares(part(v))) / n + c("_f") * c("_f")) for v in ("p", "t")]
        pn0, tn0 = [F.sqrt(total(squares(part(v))) / n + c("_f") * c("_f")) for v in ("p0", "t0")]
        tp = total(squares(part("t"))) / n
        shape = total(F.zip_with(part("p"), part("t"), lambda x, y: F.abs(x / pn - y / tn))) / n
        rows.append(F.struct(
            F.lit(low).alias("band"), F.abs(F.ln(pn / c("_f")) - F.ln(tn / c("_f"))).alias("e"), (shape * tp / (tp + c("_f") * c("_f"))).alias("s"),
            F.abs((F.ln(pn) - F.ln(tn)) - (F.ln(pn0) - F.ln(tn0))).alias("d"), (total(part("_amp")) / n).alias("a"), (tp < c("_f") * c("_f")).cast("double").alias("w"),
        ))
    frames = d.withColumn("_amp", amp).select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    out = frames.groupBy(*keys, "band").agg(F.avg("e").alias("band_envelope"), F.avg("s").alias("band_shape"), F.avg("d").alias("envelope_temporal"), F.avg("a").alias("amplitude"), F.avg("w").alias("below_floor"))
    return out.withColumn("total", band_weight(c("band")) * (c("band_envelope") + 0.5 * c("band_shape") + 0.25 * c("envelope_temporal") + 0.25 * c("amplitude")))


def log_envelope_score(df: DataFrame, keys: list[str], bin_hz: float, bins: int, burn: int = 0) -> DataFrame:
    """Log amplitude L1 plus a quarter of its temporal L1, band weighted: one row per clip."""
    g = clip_power(df, keys, burn).select(*keys, F.greatest(F.sqrt("_g") * 0.01, F.lit(1e-5)).alias("_f"))
    d = df.join(g, keys).withColumn("l", F.zip_with("p", "t", lambda x, y: F.log1p(x / c("_f")) - F.log1p(y / c("_f"))))
    d = with_previous(d.select(*keys, "frame", "l"), keys, ["l"], burn)
    sums = band_sums(d, keys, {"a": F.transform("l", F.abs), "d": F.zip_with("l", "l0", lambda x, y: F.abs(x - y))}, band_bins(bin_hz, bins))
    bands = sums.groupBy(*keys, "band").agg((F.sum("a") / F.sum("bins")).alias("a"), (F.sum("d") / F.sum(F.when(c("d").isNotNull(), c("bins")))).alias("d"))
    out = bands.groupBy(*keys).agg(F.sum(band_weight(c("band")) * c("a")).alias("amplitude"), F.sum(band_weight(c("band")) * c("d")).alias("temporal"))
    return out.withColumn("score", c("amplitude") + 0.25 * c("temporal"))


# --- F18-F20, F22, F32: complex error, one-sided terms, parity, swaps ----------------------------


def complex_error_split(df: DataFrame, keys: list[str], bin_hz: float, bins: int) -> DataFrame:
    """Mean amplitude, phase and complex error power per band; the first two add up to the third."""
    def phase(m1, a1, m2, a2):
        diff = minus(a1, a2)
        turn = F.transform(diff, lambda x: (F.cos(x) - 1) * (F.cos(x) - 1) + F.sin(x) * F.sin(x))
        return F.zip_with(F.zip_with(m1, m2, lambda x, y: x * y), turn, lambda x, y: x * y)
    arrays = {"a2": square_error(c("p"), c("t")), "f2": phase(c("p"), c("pp"), c("t"), c("tp")), "c2": complex_error(c("p"), c("pp"), c("t"), c("tp")), "t2": squares(c("t"))}
    s = band_sums(df, keys, arrays, band_bins(bin_hz, bins)).groupBy(*keys, "band").agg(*[(F.sum(n) / F.sum("bins")).alias(n) for n in arrays])
    return s.select(
        *keys, "band", c("a2").alias("amplitude_power"), c("f2").alias("phase_power"), c("c2").alias("complex_power"), c("t2").alias("reference_power"),
        F.when(c("t2") > 0, c("c2") / c("t2")).alias("relative_power"), F.abs(c("c2") - c("a2") - c("f2")).alias("residual"),
    )


def frame_floor(relative: float, absolute: float, scale: float = 1.0) -> Column:
    """Reference-only power floor of one frame."""
    return F.greatest(total(squares(c("t"))) * scale * relative, F.lit(absolute))


def excess_energy(df: DataFrame, keys: list[str], bin_hz: float, bins: int, relative: float = 1e-4, absolute: float = 1e-12) -> DataFrame:
    """Mean over 2 kHz bands and frames of log1p(relu(p - t) / (t + floor)) on powers."""
    d = df.withColumn("_f", frame_floor(relative, absolute))
    s = band_sums(d, [*keys, "_f"], {"p2": squares(c("p")), "t2": squares(c("t"))}, band_bins(bin_hz, bins, list(zip(EDGES_2K, EDGES_2K[1:]))))
    return s.groupBy(*keys).agg(F.avg(F.log1p(F.greatest(c("p2") - c("t2"), F.lit(0.0)) / (c("t2") + c("_f")))).alias("excess"))


def two_sided_band_energy(df: DataFrame, keys: list[str], bin_hz: float, bins: int, relative: float = 1e-4, absolute: float = 1e-12) -> DataFrame:
    """Mean over 2 kHz bands and frames of |log1p(p / floor) - log1p(t / floor)| on powers."""
    d = df.withColumn("_f", frame_floor(relative, absolute))
    s = band_sums(d, [*keys, "_f"], {"p2": squares(c("p")), "t2": squares(c("t"))}, band_bins(bin_hz, bins, list(zip(EDGES_2K, EDGES_2K[1:]))))
    return s.groupBy(*keys).agg(F.avg(F.abs(F.log1p(c("p2") / c("_f")) - F.log1p(c("t2") / c("_f")))).alias("energy"))


def deficit_overshoot(df: DataFrame, keys: list[str], bin_hz: float, bins: int) -> DataFrame:
    """Overshoot on bins the original lacks, over the bands above 4 kHz (mean of soft norms)."""
    over = F.zip_with(F.zip_with("p", "t", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.zip_with("t", "o", lambda x, y: F.when(x > y, 1.0).otherwise(0.0)), lambda e, m: e * e * m)
    floor = df.groupBy(*keys).agg((F.avg(total(squares(c("t")))) * 1e-4 + 1e-12).alias("_f"))
    s = band_sums(df, keys, {"x2": over, "t2": squares(c("t"))}, band_bins(bin_hz, bins, BANDS[1:]))
    bands = s.groupBy(*keys, "band").agg(F.avg("x2").alias("x2"), F.avg("t2").alias("t2")).join(floor, keys)
    return bands.groupBy(*keys).agg((F.sum(soft(c("x2"), c("t2") + c("_f"))) / 4).alias("overshoot"))


def feature_parity(df: DataFrame, keys: list[str], floor: float = 1e-6) -> DataFrame:
    """Maximum and mean dB and wrapped-phase errors, relative complex RMS and the inverse bound."""
    db = F.zip_with(F.transform("p", lambda x: 20 * F.log10(F.greatest(x, F.lit(1e-10)))), F.transform("t", lambda x: 20 * F.log10(F.greatest(x, F.lit(1e-10)))), lambda x, y: F.abs(x - y))
    ph = F.zip_with("pp", "tp", lambda x, y: F.abs(wrap_pi(x - y)))
    n = F.size("t")
    sided = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((i == 1) | (i == n), 1.0).otherwise(2.0))
    d = df.select(*keys, db.alias("_db"), ph.alias("_ph"), complex_error(c("p"), c("pp"), c("t"), c("tp")).alias("_c2"), squares(c("t")).alias("_t2"), sided.alias("_w"), n.alias("_n"))
    def weighted(v):
        return total(F.zip_with(v, "_w", lambda x, w: x * w))
    err, ref = F.sqrt(weighted(c("_c2")) / total(c("_w"))), F.sqrt(weighted(c("_t2")) / total(c("_w")))
    bound = weighted(F.transform("_c2", F.sqrt)) / (2 * (c("_n") - 1))
    return d.groupBy(*keys).agg(
        F.max(F.array_max("_db")).alias("max_db"), (F.sum(total(c("_db"))) / F.sum("_n")).alias("mean_db"),
        F.max(F.array_max("_ph")).alias("max_phase"), (F.sum(total(c("_ph"))) / F.sum("_n")).alias("mean_phase"),
        F.max(err / F.greatest(ref, F.lit(floor))).alias("max_relative_rms"), F.max(bound).alias("inverse_bound"),
    )


def oracle_swap(df: DataFrame, first_bin: int, what: str) -> DataFrame:
    """Replace magnitude, phase or both of the prediction by the reference from ``first_bin`` on."""
    def swap(mine: str, ref: str) -> Column:
        return F.concat(F.slice(mine, 1, first_bin), F.slice(ref, F.lit(first_bin + 1), F.size(ref) - first_bin))
    out = df
    if what in ("magnitude", "both"):
        out = out.withColumn("p", swap("p", "t"))
    if what in ("phase", "both"):
        out = out.withColumn("pp", swap("pp", "tp"))
    return out


def envelope_oracle(df: DataFrame, first_bin: int) -> DataFrame:
    """Scale the prediction's high band so that its frame energy equals the reference's."""
    def high(v):
        return F.slice(v, F.lit(first_bin + 1), F.size(v) - first_bin)
    tp, pw = total(squares(high("t"))), total(squares(high("p")))
    gain = F.when(pw > 0, F.sqrt(tp / pw)).otherwise(F.lit(0.0))
    return df.withColumn("_g", gain).withColumn("p", F.concat(F.slice("p", 1, first_bin), F.transform(high("p"), lambda x: x * c("_g")))).drop("_g")


# --- F06, F07, F26, F27, F29: detection, blending, gain features --------------------------------


def detect_bandwidth(df: DataFrame, magnitude_db: str, bin_hz: float, threshold_db: float = -60.0) -> DataFrame:
    """Adds ``detected_hz``: highest bin (from 1 on) above the frame peak + threshold, else 0."""
    peak = F.array_max(magnitude_db)
    marks = F.transform(magnitude_db, lambda v, i: F.when((i >= 1) & (v > peak + threshold_db), i).otherwise(0))
    return df.withColumn("detected_hz", F.coalesce(F.array_max(marks), F.lit(0)) * F.lit(bin_hz))


def measure_cutoff(df: DataFrame, keys: list[str], magnitude: str, bin_hz: float, threshold: float = 1e-3) -> DataFrame:
    """Frequency of the last bin of the clip's maximum envelope above threshold x peak."""
    env = df.select(*keys, F.posexplode(magnitude).alias("bin", "_m")).groupBy(*keys, "bin").agg(F.max("_m").alias("_e"))
    peak = df.groupBy(*keys).agg(F.max(F.array_max(magnitude)).alias("_p"))
    return env.join(peak, keys).groupBy(*keys).agg((F.coalesce(F.max(F.when(c("_e") > threshold * c("_p"), c("bin"))), F.lit(0)) * bin_hz).alias("cutoff_hz"))


def crossover_weights(cutoff: Column, bins: int, bin_hz: float, width: float) -> Column:
    """Array of raised-cosine blend weights around a cutoff; exactly 0 below and 1 above."""
    start = F.greatest(cutoff - width / 2, F.lit(0.0))
    end = F.greatest(cutoff + width / 2, start)
    def weight(k):
        f = k * F.lit(float(bin_hz))
        ramp = 0.5 * (1 - F.cos(F.pi() * (f - start) / F.greatest(end - start, F.lit(1.0))))
        return F.when(f <= start, 0.0).when(f >= end, 1.0).otherwise(ramp)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), weight)


def blend(original: Column, generated: Column, weights: Column) -> Column:
    """Weighted magnitudes; weight 0 and 1 copy exactly."""
    pairs = F.arrays_zip(original.alias("o"), generated.alias("g"), weights.alias("w"))
    return F.transform(pairs, lambda s: F.when(s["w"] == 0, s["o"]).when(s["w"] == 1, s["g"]).otherwise(s["o"] * (1 - s["w"]) + s["g"] * s["w"]))


def surviving_weight(crossover: Column, original: Column, generated: Column) -> Column:
    """Crossover weight reduced by the input power that survived in the bin."""
    pairs = F.arrays_zip(crossover.alias("w"), original.alias("o"), generated.alias("g"))
    return F.transform(pairs, lambda s: F.when((s["w"] == 0) | (s["g"] <= s["o"]), 0.0).otherwise(s["w"] * (1 - (s["o"] / s["g"]) * (s["o"] / s["g"]))))


def phase_blend(original: Column, predicted: Column, weights: Column) -> Column:
    """Unit-phasor interpolation; opposed phases fall back to circular interpolation."""
    pairs = F.arrays_zip(original.alias("o"), predicted.alias("p"), weights.alias("w"))
    def mixed(s):
        re = F.cos(s["o"]) * (1 - s["w"]) + F.cos(s["p"]) * s["w"]
        im = F.sin(s["o"]) * (1 - s["w"]) + F.sin(s["p"]) * s["w"]
        turn = s["o"] + s["w"] * wrap_pi(s["p"] - s["o"])
        return F.when(s["w"] == 0, s["o"]).when(s["w"] == 1, s["p"]).when(re * re + im * im > 2.0**-23, F.atan2(im, re)).otherwise(wrap_pi(turn))
    return F.transform(pairs, mixed)


def gain_features(df: DataFrame, magnitude: str, cutoff: str, reference: int, rate: int) -> DataFrame:
    """Adds ``features``: bias, cutoff, rate, six retained-band ratios and the surviving ratio.

    ``cutoff`` is a bin in 1 .. size - 1; the edge level is the RMS of the ``reference`` bins below it.
    """
    def rms(first: Column, count: Column) -> Column:
        part = F.slice(magnitude, (first + 1).cast("int"), count.cast("int"))
        return F.greatest(F.sqrt(total(squares(part)) / count), F.lit(1e-10))
    k = c(cutoff)
    back = F.least(F.lit(reference), k)
    edge = rms(k - back, back)
    def relative(level: Column) -> Column:
        return clamp(20 * F.log10(level / c("_edge")), -60.0, 60.0) / 20
    items = [F.lit(1.0), k / (F.size(magnitude) - 1), F.lit(rate / 48000.0)]
    for band in range(6):
        start = F.floor(k * band / 6)
        end = F.least(F.greatest(F.floor(k * (band + 1) / 6), start + 1), k)
        items.append(relative(rms(start, end - start)))
    items.append(relative(rms(k, F.size(magnitude) - k)))
    return df.withColumn("_edge", edge).withColumn("features", F.array(*items)).drop("_edge")


def target_ratio_db(features: Column, coefficients: Sequence[float]) -> Column:
    """-6 dB target corrected by at most 6 dB either way."""
    dot = total(F.zip_with(features, F.array(*[F.lit(float(v)) for v in coefficients]), lambda a, b: a * b))
    return F.lit(-6.0) + clamp(dot, -6.0, 6.0)


# --- F38-F42, F46-F51 ---------------------------------------------------------------------------


def weighted(array: Column, w: Column) -> Column:
    return F.zip_with(array, w, lambda x, y: x * y)


def relative_scale(band: Column, full: Column, relative: float, absolute: float) -> Column:
    return F.greatest(band, full * relative, F.lit(absolute))


def inpainting_terms(df: DataFrame, keys: list[str], relative: float = 0.01, absolute: float = 1e-7) -> DataFrame:
    """Mask-weighted high-band convergence, per-frame energy dB error, signed temporal error.

    Needs the mask array ``w``. Scales come from the reference: max(band, full * relative).
    """
    d = with_previous(df, keys, ["p", "t", "w"])
    wmin = F.zip_with("w", "w0", lambda x, y: F.least(x, y))
    n = total(c("w"))
    floor = F.greatest(total(squares(c("t"))) / F.size("t") * relative * relative, F.lit(absolute * absolute))
    level = [10 * F.log10(total(weighted(squares(c(v)), c("w"))) / F.greatest(n, F.lit(1e-12)) + floor) for v in ("p", "t")]
    s = d.groupBy(*keys).agg(
        F.sqrt(F.sum(total(weighted(square_error(c("p"), c("t")), c("w"))))).alias("_e"), F.sqrt(F.sum(total(weighted(squares(c("t")), c("w"))))).alias("_b"),
        F.sqrt(F.sum(total(squares(c("t"))))).alias("_full"), F.avg(F.when(n > 0, F.abs(level[0] - level[1])).otherwise(0.0)).alias("energy"),
        F.sqrt(F.sum(total(weighted(square_error(minus(c("p"), c("p0")), minus(c("t"), c("t0"))), wmin)))).alias("_de"),
        F.sqrt(F.sum(total(weighted(square_error(c("t"), c("t0")), wmin)))).alias("_db"),
        F.sum(F.size("t")).alias("_cells"), F.sum(F.when(c("t0").isNotNull(), F.size("t"))).alias("_dcells"),
    )
    temporal_full = c("_full") * F.sqrt(c("_dcells") / c("_cells"))
    return s.select(
        *keys, (c("_e") / relative_scale(c("_b"), c("_full"), relative, absolute)).alias("spectral"), "energy",
        (c("_de") / relative_scale(c("_db"), temporal_full, relative, absolute)).alias("temporal"),
    )


def subband_energy(df: DataFrame, keys: list[str], group: int = 8, relative: float = 0.01, absolute: float = 1e-7) -> DataFrame:
    """Whole high-band and ``group``-bin power errors in dB; groups without mask carry no weight."""
    floor = clip_power(df, keys).select(*keys, F.greatest(c("_g") * relative * relative, F.lit(absolute * absolute)).alias("_f"))
    cells = df.select(*keys, "frame", F.explode(F.arrays_zip(F.transform("p", lambda x, i: i).alias("k"), c("p").alias("p"), c("t").alias("t"), c("w").alias("w"))).alias("x"))
    g = cells.groupBy(*keys, "frame", F.floor(c("x.k") / group).alias("grp")).agg(
        F.sum(c("x.p") * c("x.p") * c("x.w")).alias("p2"), F.sum(c("x.t") * c("x.t") * c("x.w")).alias("t2"), F.sum("x.w").alias("n")
    ).join(floor, keys)
    def db(v, n):
        return 10 * F.log10(v / F.greatest(n, F.lit(1e-12)) + c("_f"))
    out = g.groupBy(*keys).agg(
        F.sum("p2").alias("_p"), F.sum("t2").alias("_t"), F.sum("n").alias("_n"), F.max("_f").alias("_f"),
        F.avg(F.when(c("n") > 0, F.abs(db(c("p2"), c("n")) - db(c("t2"), c("n"))))).alias("local"),
    )
    return out.select(*keys, F.when(c("_n") > 0, F.abs(db(c("_p"), c("_n")) - db(c("_t"), c("_n")))).otherwise(0.0).alias("high"), F.coalesce("local", F.lit(0.0)).alias("local"))


def complex_fidelity(df: DataFrame, keys: list[str], relative: float = 0.01, absolute: float = 1e-7) -> DataFrame:
    """Relative complex error of the restored band vs the reference and of the rest vs the input."""
    rest = F.transform("w", lambda x: 1 - x)
    s = df.groupBy(*keys).agg(
        F.sqrt(F.sum(total(weighted(complex_error(c("p"), c("pp"), c("t"), c("tp")), c("w"))))).alias("_he"), F.sqrt(F.sum(total(weighted(squares(c("t")), c("w"))))).alias("_hb"),
        F.sqrt(F.sum(total(squares(c("t"))))).alias("_hf"),
        F.sqrt(F.sum(total(weighted(complex_error(c("p"), c("pp"), c("o"), c("op")), rest)))).alias("_le"), F.sqrt(F.sum(total(weighted(squares(c("o")), rest)))).alias("_lb"),
        F.sqrt(F.sum(total(squares(c("o"))))).alias("_lf"),
    )
    return s.select(*keys, (c("_he") / relative_scale(c("_hb"), c("_hf"), relative, absolute)).alias("high_complex"), (c("_le") / relative_scale(c("_lb"), c("_lf"), relative, absolute)).alias("low_complex"))


def phase_gradient(df: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted 1 - cos of phase-error differences along frequency and along time (0 without weight)."""
    d = df.select(*keys, "frame", minus(c("pp"), c("tp")).alias("d"), "w")
    d = with_previous(d, keys, ["d", "w"])
    n = F.size("d")
    def body(v, lo):
        return F.slice(v, F.lit(1 + lo), F.size(v) - 1)
    f = F.zip_with(body("d", 1), body("d", 0), lambda x, y: 1 - F.cos(x - y))
    fw = F.zip_with(body("w", 1), body("w", 0), lambda x, y: F.least(x, y))
    t = F.zip_with("d", "d0", lambda x, y: 1 - F.cos(x - y))
    tw = F.zip_with("w", "w0", lambda x, y: F.least(x, y))
    s = d.groupBy(*keys).agg(F.sum(total(weighted(f, fw))).alias("_f"), F.sum(total(fw)).alias("_fw"), F.sum(total(weighted(t, tw))).alias("_t"), F.sum(total(tw)).alias("_tw"))
    return s.select(*keys, (c("_f") / F.greatest("_fw", F.lit(1e-12))).alias("frequency"), (c("_t") / F.greatest("_tw", F.lit(1e-12))).alias("time"))


def applied_vs_discarded(df: DataFrame, keys: list[str], bin_hz: float, bins: int, relative: float = 0.01, absolute: float = 1e-7) -> DataFrame:
    """Change in squared error from the applied, the discarded and the blended correction."""
    delta = F.zip_with(square_error(c("p"), c("t")), square_error(c("o"), c("t")), lambda a, b: a - b)
    mixed = F.zip_with(F.zip_with(minus(c("p"), c("o")), "w", lambda x, w: x * w), "o", lambda x, y: x + y)
    arrays = {"t2": squares(c("t")), "a": weighted(delta, c("w")), "x": weighted(delta, F.transform("w", lambda v: 1 - v)), "b": F.zip_with(square_error(mixed, c("t")), square_error(c("o"), c("t")), lambda a, b: a - b)}
    s = band_sums(df, keys, arrays, band_bins(bin_hz, bins)).groupBy(*keys, "band").agg(*[F.sum(n).alias(n) for n in arrays], F.sum("bins").alias("n"))
    s = s.join(clip_power(df, keys), keys)
    floor = F.greatest(F.sqrt("_g") * relative, F.lit(absolute))
    den = c("t2") + floor * floor * c("n")
    w = band_weight(c("band"))
    return s.groupBy(*keys).agg(F.sum(w * c("a") / den).alias("applied"), F.sum(w * c("x") / den).alias("discarded"), F.sum(w * c("b") / den).alias("blended"))


def pair_geometry(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Mean frame cosine and mean-square contrast of aligned feature vectors."""
    dot = total(F.zip_with(left, right, lambda x, y: x * y))
    norm = F.sqrt(total(squares(c(left)))) * F.sqrt(total(squares(c(right))))
    return df.groupBy(*keys).agg(
        F.avg(dot / F.greatest(norm, F.lit(1e-8))).alias("cosine"),
        (F.sum(total(square_error(c(left), c(right)))) / F.sum(F.size(left))).alias("contrast"),
        (F.sum(total(squares(c(right)))) / F.sum(F.size(right))).alias("identity_power"),
    )


def sc_logmag_bands(df: DataFrame, keys: list[str], bin_hz: float, bins: int) -> DataFrame:
    """Per band: convergence and mean log-L1 of floored magnitudes, each clip with its own floor."""
    floor = df.groupBy(*keys).agg((F.avg(total(squares(c("t")))) * 1e-4 + 1e-12).alias("_f"))
    d = df.join(floor, keys)
    cuts = band_bins(bin_hz, bins)
    rows = []
    for low, first, n in cuts:
        ground = c("_f") / n
        pm, tm = [F.transform(F.slice(v, first + 1, n), lambda x: F.sqrt(x * x + ground)) for v in ("p", "t")]
        rows.append(F.struct(F.lit(low).alias("band"), F.lit(n).alias("n"), total(square_error(pm, tm)).alias("e"), total(squares(tm)).alias("b"),
                             total(F.zip_with(pm, tm, lambda x, y: F.abs(F.ln(x) - F.ln(y)))).alias("l")))
    s = d.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*").groupBy(*keys, "band").agg(
        F.sqrt(F.sum("e") / F.sum("b")).alias("convergence"), (F.sum("l") / F.sum("n")).alias("log_magnitude")
    )
    return s.withColumn("weighted", band_weight(c("band")) * (c("convergence") + c("log_magnitude")))


def observed_bands(df: DataFrame, keys: list[str], magnitude: str, rms: str, bin_hz: float, bins: int) -> DataFrame:
    """Eight 3 kHz means of log1p(magnitude / unit), unit from the input RMS of the frame."""
    unit = F.sqrt(c(rms) * c(rms) / bins + 1e-10)
    d = df.withColumn("_u", unit)
    logs = F.transform(magnitude, lambda x: F.log1p(x / c("_u")))
    s = band_sums(d, [*keys, "frame"], {"v": logs}, band_bins(bin_hz, bins, [(k, k + 3000) for k in range(0, 24000, 3000)]))
    return s.select(*keys, "frame", "band", (c("v") / c("bins")).alias("value"))


def cross_phase_error(df: DataFrame, keys: list[str], a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> DataFrame:
    """Magnitude-weighted circular error of inter-channel phase: pair ``b`` against pair ``a``.

    A pair is (left magnitude, left phase, right magnitude, right phase); weights come from ``a``.
    """
    diff = F.zip_with(minus(c(b[1]), c(b[3])), minus(c(a[1]), c(a[3])), lambda x, y: F.abs(wrap_pi(x - y)))
    w = F.zip_with(a[0], a[2], lambda x, y: x * y)
    s = df.groupBy(*keys).agg(F.sum(total(weighted(diff, w))).alias("_e"), F.sum(total(w)).alias("_w"))
    return s.select(*keys, F.when(c("_w") <= 1e-20, 0.0).otherwise(c("_e") / c("_w")).alias("phase_error"))
