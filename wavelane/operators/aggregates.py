"""Evaluation aggregates: strata, recording means, paired changes, intervals, gates.

Two rules hold throughout: a recording counts once however many clips it has, and undefined
results are NULL. Sums combine map-side, so a dominating recording or stratum stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelane.functions import bootstrap
from wavelane.functions.numeric import finite, ratio
from wavelane.functions.ordinals import attach_row, null_safe_join
from wavelane.functions.quantiles import exact_quantiles, quantile_columns


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def recording_value(value: str) -> Column:
    """Mean of a recording's clips as a double. Decimals are added exactly, so equal clips of two arms tie in any order."""
    return F.sum(value).cast("double") / F.count(value)


# --- A01, A02, A18: manifest counts -------------------------------------------------------------


def manifest_summary(df: DataFrame) -> DataFrame:
    """Rows and distinct tracks overall and by split, codec, rate and role: ``dimension, name``."""
    dims = ["split", "codec_id", "sample_rate", "channel_role"]
    typed = df.select("track_id", *[F.col(d).cast("string").alias(d) for d in dims])
    slim = typed.groupBy("track_id", *dims).agg(F.count(F.lit(1)).alias("_n"))
    out = slim.groupingSets([[], *[[d] for d in dims]], *dims).agg(
        F.sum("_n").alias("rows"), F.countDistinct("track_id").alias("tracks"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    name, dimension = F.lit("all"), F.lit("overall")
    for d in dims:
        name = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(name)
        dimension = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dimension)
    return out.select(dimension.alias("dimension"), name.alias("name"), "rows", "tracks")


def deployment_coverage(df: DataFrame, expected: dict[str, Sequence[str]], splits=("validation", "test")) -> DataFrame:
    """Missing strata per split: ``split, dimension, name``. Expected sets are recipe literals."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(
        [(s, d, str(v)) for s in splits for d, values in expected.items() for v in values],
        "split string, dimension string, name string",
    )
    seen = (
        df.filter(F.col("split").isin(*splits))
        .select("split", *[F.col(d).cast("string").alias(d) for d in expected])
        .distinct()
        .unpivot(["split"], list(expected), "dimension", "name")
        .distinct()
    )
    return wanted.join(seen, ["split", "dimension", "name"], "left_anti")


def group_coverage(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct recordings per split and value of each dimension."""
    tracks = df.groupBy("split", "track_id").agg(*[F.min(d).cast("string").alias(d) for d in dims])
    return (
        tracks.unpivot(["split"], list(dims), "dimension", "name")
        .groupBy("split", "dimension", "name").agg(F.count(F.lit(1)).alias("tracks"))
    )


# --- A03-A08: strata, recording means, bootstrap ------------------------------------------------


def cluster_sums(df: DataFrame, keys: Sequence[str], cluster: str, metrics: Sequence[str]) -> DataFrame:
    """Per-cluster sums and row counts: the only input the bootstrap needs."""
    return df.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(m).alias(m) for m in metrics])


def stratified(df: DataFrame, cluster: str, metrics: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Cluster sums for the whole and for each value of each dimension (``dimension, stratum``)."""
    typed = df.select(cluster, *metrics, *[F.col(d).cast("string").alias(d) for d in dims])
    out = typed.groupingSets([[cluster], *[[cluster, d] for d in dims]], cluster, *dims).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(m).alias(m) for m in metrics], *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    stratum, dimension = F.lit("all"), F.lit("overall")
    for d in dims:
        stratum = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(stratum)
        dimension = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dimension)
    return out.select(dimension.alias("dimension"), stratum.alias("stratum"), cluster, "rows", *metrics)


def strata_summary(df: DataFrame, cluster: str, metrics: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """``dimension, stratum, metric, count, clusters, mean`` in long form."""
    parts = stratified(df, cluster, metrics, dims)
    wide = parts.groupBy("dimension", "stratum").agg(
        F.sum("rows").alias("count"), F.count(F.lit(1)).alias("clusters"), *[(F.sum(m) / F.sum("rows")).alias(m) for m in metrics]
    )
    return wide.unpivot(["dimension", "stratum", "count", "clusters"], list(metrics), "metric", "mean")


def strata_intervals(
    df: DataFrame, cluster: str, metrics: Sequence[str], dims: Sequence[str], seed: int, replicates: int
) -> DataFrame:
    """``strata_summary`` with clustered percentile intervals (one resample per stratum)."""
    parts = stratified(df, cluster, metrics, dims)
    return bootstrap.percentile_ci(
        parts, ["dimension", "stratum"], [cluster], list(metrics), "rows", seed, replicates
    )


def recording_mean(df: DataFrame, keys: Sequence[str], recording: str, metrics: Sequence[str]) -> DataFrame:
    """Clip mean and recording-equal mean: ``<m>_clip`` and ``<m>_recording`` with counts."""
    tracks = cluster_sums(df, keys, recording, metrics)
    return tracks.groupBy(*keys).agg(
        F.sum("rows").alias("cases"), F.count(F.lit(1)).alias("recordings"),
        *[(F.sum(m) / F.sum("rows")).alias(f"{m}_clip") for m in metrics],
        *[F.avg(F.col(m) / F.col("rows")).alias(f"{m}_recording") for m in metrics],
    )


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], seed: int, replicates: int = 2000) -> DataFrame:
    """Percentile interval of the mean over rows; one row gives (v, v)."""
    ones = df.select(*keys, *order, F.col(value).alias("value"), F.lit(1).alias("_one"))
    return bootstrap.percentile_ci(ones, list(keys), list(order), ["value"], "_one", seed, replicates)


def cluster_bootstrap_ci(df: DataFrame, keys: Sequence[str], cluster: str, metrics: Sequence[str], seed: int, replicates: int = 2000) -> DataFrame:
    """Interval of the row mean when whole clusters are resampled."""
    return bootstrap.percentile_ci(
        cluster_sums(df, keys, cluster, metrics), list(keys), [cluster], list(metrics), "rows", seed, replicates
    )


def paired_sources(pairs: DataFrame, keys: Sequence[str], source: str, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Per-source mean difference candidate - control of each metric, one row per source."""
    both = pairs.groupBy(*keys, source).agg(
        *[F.avg(a).alias(f"_a_{m}") for m, (a, _) in metrics.items()], *[F.avg(b).alias(f"_b_{m}") for m, (_, b) in metrics.items()]
    )
    return both.select(*keys, source, *[(F.col(f"_a_{m}") - F.col(f"_b_{m}")).alias(m) for m in metrics])


def paired_source_bootstrap(pairs: DataFrame, keys: Sequence[str], source: str, metrics: dict[str, tuple[str, str]], seed: int, replicates: int = 5000) -> DataFrame:
    """Source-mean delta with shared resamples for all metrics, and better/worse/ties counts."""
    sources = paired_sources(pairs, keys, source, metrics).withColumn("_one", F.lit(1))
    ci = bootstrap.percentile_ci(sources, list(keys), [source], list(metrics), "_one", seed, replicates)
    signs = sources.groupBy(*keys).agg(
        *[c for m in metrics for c in (
            count_if(F.col(m) < 0).alias(f"{m}_better"), count_if(F.col(m) > 0).alias(f"{m}_worse"), count_if(F.col(m) == 0).alias(f"{m}_ties"))]
    )
    return null_safe_join(ci, signs, list(keys))


def paired_comparison(pairs: DataFrame, corpus: str, track: str, candidate: str, control: str, seed: int, replicates: int = 2000) -> DataFrame:
    """Delta per row, mean per track, mean over tracks per corpus with interval."""
    tracks = pairs.groupBy(corpus, track).agg(F.avg(F.col(candidate) - F.col(control)).alias("delta")).withColumn("_one", F.lit(1))
    return bootstrap.percentile_ci(tracks, [corpus], [track], ["delta"], "_one", seed, replicates)


# --- A09-A11: changes and distributions ---------------------------------------------------------


def win_loss(pairs: DataFrame, keys: Sequence[str], base: str, current: str, eps: float = 2.0**-23) -> DataFrame:
    """Improved/unchanged/worsened counts (lower is better), means, median and extreme changes.

    ``beyond_numerical`` counts exceed 8*eps*max(|base|, 1e-12). The relative change is NULL on a
    zero base; ``zero_base`` counts the rows omitted from per-row percentages.
    """
    d = pairs.withColumn("_d", F.col(current) - F.col(base)).withColumn(
        "_tol", F.lit(8 * eps) * F.greatest(F.abs(F.col(base)), F.lit(1e-12))
    )
    main = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        count_if(F.col("_d") < 0).alias("improved"), count_if(F.col("_d") == 0).alias("unchanged"),
        count_if(F.col("_d") > 0).alias("worsened"),
        count_if(F.col("_d") < -F.col("_tol")).alias("improved_beyond"), count_if(F.col("_d") > F.col("_tol")).alias("worsened_beyond"),
        count_if(F.col(base) == 0).alias("zero_base"),
        F.avg(base).alias("base_mean"), F.avg(current).alias("current_mean"), F.avg("_d").alias("mean_change"),
        F.min("_d").alias("min_change"), F.max("_d").alias("max_change"),
        ratio(F.avg("_d"), F.avg(base)).alias("relative_change"),
    )
    return null_safe_join(main, quantile_columns(d, list(keys), "_d", {"median_change": 0.5}), list(keys))


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, min, p50, p90, p95, p99, max with linear interpolation. NULLs are dropped."""
    base = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantile_columns(df, list(keys), value, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return null_safe_join(base, q, list(keys), "left")


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Order statistic of rank ceil(n p): ``keys, p, value``."""
    return exact_quantiles(df, list(keys), value, list(probs), method="nearest")


# --- A12, A13: curation coverage ----------------------------------------------------------------


def coverage_audit(reviewed: DataFrame, position: str = "id") -> DataFrame:
    """Approval per entry: ``status`` approved/held and ``reasons``.

    Needs ``errors, work, genre, genre_basis``. Only approved rows claim a work; later rows of a
    claimed work are duplicates, which precedes the genre reasons. ``content_kind`` (NULL: music)
    and ``reviewed_genre`` (as the review gives it, NULL: not given) are looked at where they are columns.
    """
    known = lambda c: F.col(c) if c in reviewed.columns else F.lit(None).cast("string")
    other_kind = F.coalesce(known("content_kind"), F.lit("music")) != "music"
    bad_genre = F.coalesce(F.trim(known("reviewed_genre")) == "", F.lit(False))
    labelled = ~F.col("genre").isin("unlabeled", "unknown")
    no_basis = labelled & (F.coalesce(F.col("genre_basis"), F.lit("")) == "")
    work_ok = F.trim(F.coalesce(F.col("work"), F.lit(""))) != ""
    passes = (F.size("errors") == 0) & ~other_kind & work_ok & ~bad_genre & ~no_basis
    first = reviewed.filter(passes).groupBy("work").agg(F.min(position).alias("_first"))
    joined = reviewed.join(first, "work", "left")
    reasons = (
        F.when(F.size("errors") > 0, F.col("errors"))
        .when(other_kind, F.array(F.lit("not_a_music_recording")))
        .when(~work_ok, F.array(F.lit("missing_reviewed_work_group")))
        .when(F.col(position) > F.col("_first"), F.array(F.lit("duplicate_reviewed_work")))
        .when(bad_genre, F.array(F.lit("invalid_reviewed_genre")))
        .when(no_basis, F.array(F.lit("unreviewed_genre")))
        .otherwise(F.array().cast("array<string>"))
    )
    return joined.withColumn("reasons", reasons).withColumn(
        "status", F.when(F.size("reasons") == 0, "approved").otherwise("held")
    ).drop("_first")


def coverage_counts(approved: DataFrame, vocal_languages: dict[str, Sequence[str]]) -> DataFrame:
    """``metric, name, actual``: recordings, creators, and both per region and per genre."""
    labelled = ~F.col("genre").isin("unlabeled", "unknown")
    vocal = F.lit(False)
    for region, languages in vocal_languages.items():
        vocal = vocal | ((F.col("music_region") == region) & F.col("vocal_language").isin(*languages))
    vocal = F.coalesce(vocal & F.col("vocal_music"), F.lit(False)) & (F.size("region_errors") == 0)
    def part(metric: str, name: Column, actual: Column) -> DataFrame:
        return approved.groupBy(name.alias("name")).agg(actual.cast("bigint").alias("actual")).select(F.lit(metric).alias("metric"), "name", "actual")
    parts = [
        part("music", F.lit("distinct-recordings"), F.count(F.lit(1))),
        part("artists", F.lit("distinct-creators"), F.countDistinct("artist_id")),
        part("regions", F.col("music_region"), F.count(F.lit(1))),
        part("regional-artists", F.col("music_region"), F.countDistinct("artist_id")),
        part("regional-genres", F.col("music_region"), F.countDistinct(F.when(labelled, F.col("genre")))),
        part("genres", F.col("genre"), F.count(F.lit(1))),
        part("genre-artists", F.col("genre"), F.countDistinct("artist_id")),
        part("regional-vocal-music", F.col("music_region"), count_if(vocal)),
    ]
    return reduce(DataFrame.unionByName, parts)


def coverage_gaps(counts: DataFrame, targets: Sequence[tuple[str, str, int]], advisory: Sequence[str] = ()) -> DataFrame:
    """Targets not reached: ``metric, name, actual, required, blocking``."""
    wanted = counts.sparkSession.createDataFrame(list(targets), "metric string, name string, required bigint")
    out = F.broadcast(wanted).join(counts, ["metric", "name"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return out.filter(F.col("actual") < F.col("required")).withColumn("blocking", ~F.col("metric").isin(*advisory))


def dominance(approved: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Artists, genres and the unknown region whose share exceeds its limit."""
    total = approved.agg(F.count(F.lit(1)).alias("_all"))
    def part(metric: str, name: Column) -> DataFrame:
        return approved.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("_n")).select(F.lit(metric).alias("metric"), "name", "_n", F.lit(limits[metric]).alias("limit"))
    rows = part("artist-dominance", F.col("artist_id")).unionByName(part("genre-dominance", F.col("genre"))).unionByName(
        part("unknown-region", F.col("music_region")).filter(F.col("name") == "unknown")
    )
    shares = attach_row(rows, total).withColumn("share", F.col("_n") / F.col("_all"))
    return shares.filter(F.col("share") > F.col("limit")).select("metric", "name", "share", "limit")


# --- A14-A17: weights ---------------------------------------------------------------------------


def recording_weights(df: DataFrame, track: str, weight: str, name: str = "mass") -> DataFrame:
    """weight / total weight of its recording. Non-positive or non-finite weights fail the job."""
    w = F.col(weight)
    safe = df.filter(
        F.when(finite(w) & (w > 0), F.lit(True)).otherwise(F.raise_error(F.lit("sampling weights must be finite and positive")).cast("boolean"))
    )
    totals = safe.groupBy(track).agg(F.sum(weight).alias("_t"))
    return safe.join(totals, track).withColumn(name, w / F.col("_t")).drop("_t")


def genre_counts(df: DataFrame) -> DataFrame:
    """Unique training recordings per genre; a recording with two genres fails the job."""
    label = F.coalesce(F.nullif(F.trim(F.col("genre")), F.lit("")), F.lit("unlabeled"))
    tracks = df.filter(F.col("split") == "train").groupBy("track_id").agg(F.min(label).alias("genre"), F.max(label).alias("_other"))
    safe = tracks.filter(
        F.when(F.col("genre") == F.col("_other"), F.lit(True)).otherwise(F.raise_error(F.lit("inconsistent genre")).cast("boolean"))
    )
    return safe.groupBy("genre").agg(F.count(F.lit(1)).alias("recordings"))


def speech_mix_ratios(df: DataFrame, synthetic: float = 0.0) -> DataFrame:
    """Per-genre draw ratios; speech gets the smallest labelled genre's share."""
    counts = genre_counts(df)
    total = counts.agg(
        F.sum("recordings").alias("_all"), F.min(F.when(F.col("genre") != "unlabeled", F.col("recordings"))).alias("_small")
    )
    music = F.lit(1.0 - synthetic)
    speech = music * F.col("_small") / F.col("_all")
    return attach_row(counts, total).select(
        "genre", "recordings", (music / (1 + speech)).alias("music_ratio"), (speech / (1 + speech)).alias("speech_ratio"),
        (music / (1 + speech) * F.col("recordings") / F.col("_all")).alias("genre_ratio"),
        (F.col("recordings") == F.col("_small")).alias("smallest"),
    )


def corpus_weighted(df: DataFrame, corpus: str, weights: dict[str, float], metrics: Sequence[str]) -> DataFrame:
    """Fixed-weight combination of the corpora's clip means; NULL when a corpus has no rows."""
    return df.agg(
        *[
            reduce(lambda a, b: a + b, [F.lit(w) * F.avg(F.when(F.col(corpus) == c, F.col(m))) for c, w in weights.items()]).alias(m)
            for m in metrics
        ]
    )


def corpus_fraction_weights(df: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Row mass: corpus fraction / recordings of the corpus / rows of the recording."""
    per_track = df.groupBy("corpus", "track_id").agg(F.count(F.lit(1)).alias("_rows"))
    per_corpus = per_track.groupBy("corpus").agg(F.count(F.lit(1)).alias("_tracks"))
    fraction = F.lit(0.0)
    for corpus, value in fractions.items():
        fraction = F.when(F.col("corpus") == corpus, F.lit(value)).otherwise(fraction)
    mass = per_track.join(per_corpus, "corpus").select(
        "corpus", "track_id", (fraction / F.col("_tracks") / F.col("_rows")).alias("mass")
    )
    return df.join(mass, ["corpus", "track_id"])


# --- A19-A24: factorial, decomposition, guards, gates -------------------------------------------


def factorial_contrasts(cells: DataFrame, contrasts: dict[str, tuple[str, str]], arms: Sequence[str]) -> DataFrame:
    """Simple effects of a design. ``cells``: ``arm, group, track_id, value`` (clip rows).

    Recordings must be present in all arms of a group; an unmatched one fails the job.
    """
    wide = cells.groupBy("group", "track_id").pivot("arm", list(arms)).agg(recording_value("value"))
    complete = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in arms])
    wide = wide.filter(F.when(complete, F.lit(True)).otherwise(F.raise_error(F.lit("unmatched recording populations")).cast("boolean")))
    long = wide.select(
        "group", "track_id",
        F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), F.col(a).alias("new"), F.col(b).alias("old")) for n, (a, b) in contrasts.items()])).alias("c"),
    ).select("group", "c.contrast", "c.new", "c.old", (F.col("c.new") - F.col("c.old")).alias("d"))
    main = long.groupBy("contrast", "group").agg(
        (F.avg("new") - F.avg("old")).alias("difference"),
        ((ratio(F.avg("new"), F.avg("old")) - 1) * 100).alias("delta_pct"),
        count_if(F.col("d") < 0).alias("wins"), count_if(F.col("d") > 0).alias("losses"), count_if(F.col("d") == 0).alias("ties"),
    )
    return main.join(quantile_columns(long, ["contrast", "group"], "d", {"median_difference": 0.5}), ["contrast", "group"])


def factorial_interaction(cells: DataFrame, quad: tuple[str, str, str, str]) -> DataFrame:
    """(a - b) - (c - d) of recording means per group."""
    means = cells.groupBy("group", "track_id", "arm").agg(F.avg("value").alias("v")).groupBy("group").pivot("arm", list(quad)).agg(F.avg("v"))
    a, b, c, d = [F.col(q) for q in quad]
    return means.select("group", ((a - b) - (c - d)).alias("interaction"))


# Component weights of the multi-resolution score and its band edges.
COMPONENT_WEIGHTS = {"amplitude": 1.0, "log_shape": 0.25, "envelope": 0.1, "dynamics": 0.25}
BAND_LOWS = (0, 4000, 8000, 12000, 16000)


def contribution(band: Column, component: Column, value: Column) -> Column:
    """Signed weighted contribution of one band component to the total score."""
    weight = F.lit(0.0)
    for name, w in COMPONENT_WEIGHTS.items():
        weight = F.when(component == name, F.lit(w)).otherwise(weight)
    return F.when(band == 0, F.lit(0.25 / 4.25)).otherwise(F.lit(1 / 4.25)) * weight * value


def band_decomposition(parts: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Sum of contributions, residual to the reported total, and whether rounding explains it."""
    c = contribution(F.col("band"), F.col("component"), F.col("value"))
    sums = parts.groupBy(key).agg(F.sum(c).alias("reconstructed"), F.sum(F.abs(c)).alias("_size"))
    bound = F.lit(32 * 2.0**-23) * F.greatest(F.col("_size"), F.abs("total"))
    return totals.join(sums, key).select(
        key, "total", "reconstructed", (F.col("total") - F.col("reconstructed")).alias("residual"),
        (F.abs(F.col("total") - F.col("reconstructed")) <= bound).alias("consistent"),
    )


def attribution(scores: DataFrame, metric: str = "value") -> DataFrame:
    """Source-equal deltas per stage and role, better/worse source counts, native minus raw.

    ``scores``: ``stage, role, source, candidate, control`` paired cases.
    """
    per = scores.groupBy("stage", "role", "source").agg(F.avg("candidate").alias("a"), F.avg("control").alias("b"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy("stage", "role").agg(
        F.sum("n").alias("cases"), F.count(F.lit(1)).alias("sources"), F.avg("a").alias("candidate_mean"), F.avg("b").alias("control_mean"),
        (F.avg("a") - F.avg("b")).alias("delta"),
        count_if(F.col("a") < F.col("b")).alias("better_sources"), count_if(F.col("a") > F.col("b")).alias("worse_sources"),
    )
    raw = out.filter(F.col("stage") == "raw").select("role", F.col("delta").alias("_raw"))
    return out.join(raw, "role", "left").withColumn("native_minus_raw", F.when(F.col("stage") == "native", F.col("delta") - F.col("_raw"))).drop("_raw")


def source_lists(scores: DataFrame) -> DataFrame:
    """Better and worse sources as rows ``stage, role, source, verdict`` (never one long array)."""
    per = scores.groupBy("stage", "role", "source").agg((F.avg("candidate") - F.avg("control")).alias("delta"))
    return per.select("stage", "role", "source", F.when(F.col("delta") < 0, "better").when(F.col("delta") > 0, "worse").otherwise("tie").alias("verdict"))


def guards(pairs: DataFrame, keys: Sequence[str], track: str, candidate: str, control: str, tolerance: float, seed: int, replicates: int = 2000, improvement: bool = False) -> DataFrame:
    """supported / regression / inconclusive / unsupported per key from the recording interval."""
    tracks = pairs.groupBy(*keys, track).agg(F.avg(F.col(candidate) - F.col(control)).alias("delta")).withColumn("_one", F.lit(1))
    ci = bootstrap.percentile_ci(tracks, list(keys), [track], ["delta"], "_one", seed, replicates)
    bound = -tolerance if improvement else tolerance
    status = (
        F.when(F.col("clusters") < 2, "unsupported").when(F.col("delta_hi") <= bound, "supported")
        .when(F.col("delta_lo") > tolerance, "regression").otherwise("inconclusive")
    )
    return ci.withColumn("status", status)


def support_checks(wide: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per named check and ``all_pass``; an undecidable check fails."""
    named = wide.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    long = named.unpivot([], list(checks), "check", "passed")
    return long.unionByName(long.agg(F.lit("all_pass").alias("check"), F.bool_and("passed").alias("passed")))


def release_gates(overall: DataFrame, strata: DataFrame, rows: DataFrame, thresholds: dict[str, float], evidence: dict[str, bool]) -> DataFrame:
    """Named gates, one row each: ``gate, passed``.

    ``overall`` has one row (mean_delta, hi_delta, low_mean); ``strata`` has ``dimension, lo``;
    ``rows`` the per-row evidence. An empty set never passes.
    """
    r = rows.agg(
        F.max("chunk_error").alias("chunk"), F.sum("clipped").alias("clipped"), F.sum("nonfinite").alias("nonfinite"),
        F.avg(F.col("false_bypass").cast("double")).alias("bypass"),
        count_if(F.col("stereo")).alias("stereo_rows"), count_if(F.col("stereo") & F.col("stereo_complete")).alias("stereo_complete"),
        F.count("perceptual").alias("scored"), F.count(F.lit(1)).alias("rows"), F.avg("perceptual").alias("perceptual"),
    )
    s = strata.agg(count_if(F.coalesce(F.col("lo") > 0, F.lit(True))).alias("regressions"), F.countDistinct("dimension").alias("dims"))
    wide = attach_row(attach_row(overall, s), r)
    t = thresholds
    checks = {
        "mean_high_band_improvement": F.col("mean_delta") < t["mean_delta_max"],
        "high_band_improvement_ci": F.col("hi_delta") < t["ci_upper_max"],
        "required_strata_no_supported_regression": (F.col("regressions") == 0) & (F.col("dims") >= t["dimensions"]),
        "low_band_preservation": F.col("low_mean") <= t["low_mean_max"],
        "stream_chunk_equivalence": F.col("chunk") <= t["chunk_max"],
        "finite_unclipped_output": (F.col("clipped") <= t["clipped_max"]) & (F.col("nonfinite") <= t["nonfinite_max"]),
        "gate_false_bypass": F.col("bypass") <= t["false_bypass_max"],
        "parity_evidence": F.lit(evidence["parity"]),
        "perceptual_score": (F.col("scored") == F.col("rows")) & (F.col("perceptual") >= t["perceptual_min"]),
        "manifest_file_audit": F.lit(evidence["files_audited"]),
        "stereo_metrics_present": (F.col("stereo_rows") > 0) & (F.col("stereo_rows") == F.col("stereo_complete")),
    }
    return support_checks(wide, checks).withColumnRenamed("check", "gate")


# --- A30-A36, A42-A46 ---------------------------------------------------------------------------


def concentration(df: DataFrame, keys: Sequence[str], case: str, delta: str, k: int) -> DataFrame:
    """Largest k increases per key with their share of the net change and of the positive change."""
    totals = df.groupBy(*keys).agg(F.sum(delta).alias("_net"), F.sum(F.greatest(F.col(delta), F.lit(0.0))).alias("_pos"))
    top = top_k(df, keys, case, delta, k)
    return null_safe_join(top, totals, list(keys)).select(
        *keys, "rank", case, delta, ratio(F.col(delta), F.col("_net")).alias("net_share"),
        (F.greatest(F.col(delta), F.lit(0.0)) / F.greatest(F.col("_pos"), F.lit(1e-30))).alias("positive_share"),
    )


def top_k(df: DataFrame, keys: Sequence[str], case: str, value: str, k: int, salts: int = 64) -> DataFrame:
    """Largest k rows per key (ties: smaller case). Salted first, so a hot key is ranked in parts."""
    order = [F.col(value).desc(), F.col(case)]
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    local = df.withColumn("_salt", F.pmod(F.xxhash64(case), F.lit(salts))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
    final = local.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return final.filter(F.col("rank") <= k).drop("_salt")


def remaining_mean(df: DataFrame, keys: Sequence[str], case: str, delta: str, k: int) -> DataFrame:
    """Mean change without the k largest cases; NULL when nothing remains."""
    total = df.groupBy(*keys).agg(F.sum(delta).alias("_s"), F.count(F.lit(1)).alias("_n"))
    top = top_k(df, keys, case, delta, k).groupBy(*keys).agg(F.sum(delta).alias("_ts"), F.count(F.lit(1)).alias("_tn"))
    return null_safe_join(total, top, list(keys)).select(
        *keys, ratio(F.col("_s") - F.col("_ts"), F.col("_n") - F.col("_tn")).alias("remaining_mean")
    )


def error_summary(df: DataFrame, keys: Sequence[str], track: str, error: str) -> DataFrame:
    """Clip mean, recording mean, p95 and maximum of an error RMS."""
    means = recording_mean(df, keys, track, [error])
    extra = df.groupBy(*keys).agg(F.max(error).alias("max_error"))
    q = quantile_columns(df, list(keys), error, {"p95_error": 0.95})
    return null_safe_join(null_safe_join(means, extra, list(keys)), q, list(keys))


def power_shares(df: DataFrame, keys: Sequence[str], rms: str, shares: Sequence[str]) -> DataFrame:
    """Power-weighted projection shares sum(share rms^2) / sum(rms^2); NULL without power."""
    power = F.sum(F.col(rms) * F.col(rms))
    return df.groupBy(*keys).agg(power.alias("power"), *[ratio(F.sum(F.col(s) * F.col(rms) * F.col(rms)), power).alias(s) for s in shares])


def violation_counts(df: DataFrame, keys: Sequence[str], nested: str) -> DataFrame:
    """Counts by keys and role of a nested array of violation roles."""
    return df.select(*keys, F.explode(nested).alias("role")).groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("violations"))


def joint_improvement(df: DataFrame, keys: Sequence[str], deltas: Sequence[str]) -> DataFrame:
    """Cases where all metrics improve, and where none increases."""
    better = reduce(lambda a, b: a & b, [F.col(d) < 0 for d in deltas])
    no_worse = reduce(lambda a, b: a & b, [F.col(d) <= 0 for d in deltas])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), count_if(better).alias("all_improved"), count_if(no_worse).alias("none_increased"))


def validation_aggregate(df: DataFrame, dims: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Stratum means from exact decimal sums: bit-equal for any row or worker order."""
    exact = df.select(*[F.col(d).cast("string").alias(d) for d in dims], *[F.col(m).cast("decimal(27,12)").alias(m) for m in metrics])
    slim = exact.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(m).alias(m) for m in metrics])
    out = slim.groupingSets([[], *[[d] for d in dims]], *dims).agg(
        F.sum("_n").alias("rows"), *[F.sum(m).alias(m) for m in metrics], *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    name, dimension = F.lit("all"), F.lit("overall")
    for d in dims:
        name = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(name)
        dimension = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dimension)
    return out.select(dimension.alias("dimension"), name.alias("stratum"), "rows", *[(F.col(m).cast("double") / F.col("rows")).alias(m) for m in metrics])


def control_assessment(df: DataFrame, keys: Sequence[str], source: str, margin: str, control: str, loss: str, initial: str, constant: float) -> DataFrame:
    """Margin over |control| per source: majority and mean tests, and the improved-loss test."""
    per = df.groupBy(*keys, source).agg((F.avg(margin) - F.abs(F.avg(control))).alias("_m"), F.avg(loss).alias("_l"), F.avg(initial).alias("_i"))
    out = per.groupBy(*keys).agg(
        F.avg("_m").alias("mean_margin"), count_if(F.col("_m") > 0).alias("wins"), F.count(F.lit(1)).alias("sources"),
        (F.avg("_l") < F.least(F.avg("_i"), F.lit(constant))).alias("loss_improved"),
    )
    ok = (F.col("mean_margin") > 0) & (F.col("wins") > F.col("sources") / 2)
    return out.withColumn("passes", ok & F.col("loss_improved"))


def stage_means(df: DataFrame, keys: Sequence[str], bands: str, cutoff: str) -> DataFrame:
    """Mean of every band per key (``band`` position) with the median cutoff of the key."""
    per_band = df.select(*keys, F.posexplode(bands).alias("band", "v")).groupBy(*keys, "band").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("clips"))
    return null_safe_join(per_band, quantile_columns(df, list(keys), cutoff, {"median_cutoff": 0.5}), list(keys))


def parity_evidence(cases: DataFrame, expected: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """Named results: missing and unexpected cases, and each metric within its budget."""
    missing = expected.join(cases, "case", "left_anti").agg(F.lit("missing_cases").alias("check"), F.count(F.lit(1)).alias("failures"))
    extra = cases.join(expected, "case", "left_anti").agg(F.lit("unexpected_cases").alias("check"), F.count(F.lit(1)).alias("failures"))
    over = cases.agg(*[count_if(~F.coalesce(F.col(m) <= b, F.lit(False))).alias(m) for m, b in budgets.items()])
    return missing.unionByName(extra).unionByName(over.unpivot([], list(budgets), "check", "failures"))


def variant_vs_control(df: DataFrame, control: str, metric: str) -> DataFrame:
    """Each variant against the named control per group: means, delta %, median, wins, losses."""
    rec = df.groupBy("group", "variant", "track_id").agg(recording_value(metric).alias("v"))
    base = rec.filter(F.col("variant") == control).select("group", "track_id", F.col("v").alias("o"))
    both = rec.join(base, ["group", "track_id"], "left").withColumn("d", F.col("v") - F.col("o"))
    main = both.groupBy("group", "variant").agg(
        F.avg("o").alias("control"), F.avg("v").alias("candidate"), ((ratio(F.avg("v"), F.avg("o")) - 1) * 100).alias("delta_pct"),
        count_if(F.col("d") < 0).alias("wins"), count_if(F.col("d") > 0).alias("losses"),
    )
    return main.join(quantile_columns(both, ["group", "variant"], "d", {"median_difference": 0.5}), ["group", "variant"])


def change_strata(base: DataFrame, other: DataFrame, key: str, cluster: str, metrics: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Row-wise metric changes against a base mode, summarised by strata."""
    old = base.select(key, *[F.col(m).alias(f"_o_{m}") for m in metrics])
    changed = other.join(old, key)
    for m in metrics:
        changed = changed.withColumn(m, F.col(m) - F.col(f"_o_{m}"))
    return strata_summary(changed, cluster, metrics, dims)


def trace_summary(df: DataFrame, keys: Sequence[str], active: str, gain: str, output: str, source: str) -> DataFrame:
    """Active ratio, mean gain of active hops (0 when none), peak, largest change from the input."""
    return df.groupBy(*keys).agg(
        F.avg(F.col(active).cast("double")).alias("active_ratio"),
        F.coalesce(F.avg(F.when(F.col(active), F.col(gain))), F.lit(0.0)).alias("mean_gain"),
        F.max(F.abs(F.col(output))).alias("peak"), F.max(F.abs(F.col(output) - F.col(source))).alias("max_change"),
    )
