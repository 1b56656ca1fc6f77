"""Evaluation queries: counts, strata, intervals, paired changes, curation coverage, gates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from wavelane.functions.numeric import fix
from wavelane.operators import aggregates as agg
from wavelane.operators import rules
from wavelane.plans import validation
from wavelane.plans.adapters import load
from wavelane.plans.registry import boot_sql, fx, query, with_ctes

DIMS = ["corpus", "codec_id", "quality", "sample_rate", "channel_role"]


def fixed(df, columns, digits=6):
    """Round the named double columns for the report."""
    for c in columns:
        df = df.withColumn(c, fix(F.col(c), digits))
    return df


def strata_sql(dims, select, source):
    """UNION ALL of the overall and the one-dimension groupings."""
    parts = [f"SELECT 'overall' AS dimension, 'all' AS stratum, {select} FROM {source}"]
    parts += [
        f"SELECT '{d}', CAST({d} AS VARCHAR), {select} FROM {source} GROUP BY {d}" for d in dims
    ]
    return " UNION ALL ".join(parts)


@query("a01_manifest_summary", with_ctes("manifest", body=strata_sql(
    ["split", "codec_id", "sample_rate", "channel_role"], "count(*) AS rows, count(DISTINCT track_id) AS tracks", "manifest"
).replace("AS stratum", "AS name")))
def a01(spark, sf):
    return agg.manifest_summary(load(spark, sf, "manifest"))


@query("a02_deployment_coverage", with_ctes("manifest", body="""
WITH e AS (SELECT * FROM (VALUES ('validation'), ('test')) s(split), (VALUES ('codec_id','A'), ('codec_id','N'), ('codec_id','R'), ('codec_id','X'),
 ('sample_rate','44100'), ('sample_rate','48000'), ('sample_rate','96000'), ('channel_role','left'), ('channel_role','mono')) d(dimension, name)),
a AS (SELECT split, 'codec_id' AS dimension, codec_id AS name FROM manifest UNION SELECT split, 'sample_rate', CAST(sample_rate AS VARCHAR) FROM manifest
 UNION SELECT split, 'channel_role', channel_role FROM manifest)
SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.split = e.split AND a.dimension = e.dimension AND a.name = e.name)"""))
def a02(spark, sf):
    expected = {"codec_id": ["A", "N", "R", "X"], "sample_rate": ["44100", "48000", "96000"], "channel_role": ["left", "mono"]}
    return agg.deployment_coverage(load(spark, sf, "manifest"), expected)


@query("a03_strata_summary", with_ctes("metric_rows", body="WITH s AS (" + strata_sql(
    DIMS, "count(*) AS count, count(DISTINCT track_id) AS clusters, avg(baseline) AS m1, avg(enhanced) AS m2, avg(delta) AS m3", "metric_rows"
) + f""") SELECT dimension, stratum, count, clusters, unnest(['baseline','enhanced','delta']) AS metric,
  unnest([{fx('m1')}, {fx('m2')}, {fx('m3')}]) AS mean FROM s"""))
def a03(spark, sf):
    return fixed(agg.strata_summary(load(spark, sf, "metric_rows"), "track_id", ["baseline", "enhanced", "delta"], DIMS), ["mean"])


def ci_select(keys, sums, extra=""):
    cols = ", ".join(f"{fx(f'{s}_{side}')} AS {s}_{side}" for s in sums for side in ("mean", "lo", "hi"))
    return f"SELECT {', '.join(keys)}, clusters, {cols}{extra} FROM ci"


def ci_fix(df, sums):
    return fixed(df, [f"{s}_{side}" for s in sums for side in ("mean", "lo", "hi")])


@query("a03_strata_intervals", with_ctes("metric_rows", body="WITH " + boot_sql(
    " UNION ALL ".join(
        ["SELECT 'overall' AS dimension, 'all' AS stratum, track_id, count(*) AS rows, sum(delta) AS delta FROM metric_rows GROUP BY track_id"]
        + [f"SELECT '{d}', CAST({d} AS VARCHAR), track_id, count(*), sum(delta) FROM metric_rows GROUP BY {d}, track_id" for d in ("corpus", "quality")]
    ), ["dimension", "stratum"], "track_id", ["delta"], "rows", 7, 2000) + "\n" + ci_select(["dimension", "stratum"], ["delta"])))
def a03_ci(spark, sf):
    out = agg.strata_intervals(load(spark, sf, "metric_rows"), "track_id", ["delta"], ["corpus", "quality"], 7, 2000)
    return ci_fix(out, ["delta"])


@query("a04_recording_mean", with_ctes("metric_rows", body=f"""
WITH t AS (SELECT corpus, codec_id, track_id, avg(delta) AS d, avg(enhanced) AS e, sum(delta) AS ds, sum(enhanced) AS es, count(*) AS n FROM metric_rows GROUP BY 1, 2, 3)
SELECT corpus, codec_id, CAST(sum(n) AS BIGINT) AS cases, count(*) AS recordings, {fx('sum(ds)/sum(n)')} AS delta_clip, {fx('sum(es)/sum(n)')} AS enhanced_clip,
 {fx('avg(d)')} AS delta_recording, {fx('avg(e)')} AS enhanced_recording FROM t GROUP BY 1, 2"""))
def a04(spark, sf):
    out = agg.recording_mean(load(spark, sf, "metric_rows"), ["corpus", "codec_id"], "track_id", ["delta", "enhanced"])
    return fixed(out, ["delta_clip", "enhanced_clip", "delta_recording", "enhanced_recording"])


@query("a05_bootstrap_ci", with_ctes("metric_rows", body="WITH " + boot_sql(
    "SELECT corpus, codec_id, track_id, avg(delta) AS value, 1 AS one FROM metric_rows GROUP BY 1, 2, 3",
    ["corpus", "codec_id"], "track_id", ["value"], "one", 0, 2000) + "\n" + ci_select(["corpus", "codec_id"], ["value"])))
def a05(spark, sf):
    means = load(spark, sf, "metric_rows").groupBy("corpus", "codec_id", "track_id").agg(F.avg("delta").alias("v"))
    return ci_fix(agg.bootstrap_ci(means, ["corpus", "codec_id"], "v", ["track_id"], 0, 2000), ["value"])


@query("a06_cluster_bootstrap_ci", with_ctes("metric_rows", body="WITH " + boot_sql(
    "SELECT corpus, track_id, count(*) AS rows, sum(delta) AS delta, sum(enhanced) AS enhanced FROM metric_rows GROUP BY 1, 2",
    ["corpus"], "track_id", ["delta", "enhanced"], "rows", 11, 2000) + "\n" + ci_select(["corpus"], ["delta", "enhanced"])))
def a06(spark, sf):
    out = agg.cluster_bootstrap_ci(load(spark, sf, "metric_rows"), ["corpus"], "track_id", ["delta", "enhanced"], 11, 2000)
    return ci_fix(out, ["delta", "enhanced"])


@query("a07_paired_source_bootstrap", with_ctes("pairs", body="WITH " + boot_sql(
    "SELECT quality, track_id, avg(delta) - avg(control) AS d1, avg(baseline) - avg(enhanced) AS d2, 1 AS one FROM pairs GROUP BY 1, 2",
    ["quality"], "track_id", ["d1", "d2"], "one", 20261012, 5000) + f""",
sg AS (SELECT quality, count(*) FILTER (d1 < 0) AS d1_better, count(*) FILTER (d1 > 0) AS d1_worse, count(*) FILTER (d1 = 0) AS d1_ties,
 count(*) FILTER (d2 < 0) AS d2_better, count(*) FILTER (d2 > 0) AS d2_worse, count(*) FILTER (d2 = 0) AS d2_ties FROM bsrc GROUP BY 1)
{ci_select(['quality'], ['d1', 'd2'], ', d1_better, d1_worse, d1_ties, d2_better, d2_worse, d2_ties')} JOIN sg USING (quality)"""))
def a07(spark, sf):
    out = agg.paired_source_bootstrap(
        load(spark, sf, "pairs"), ["quality"], "track_id", {"d1": ("delta", "control"), "d2": ("baseline", "enhanced")}, 20261012, 5000
    )
    return ci_fix(out, ["d1", "d2"])


@query("a08_paired_comparison", with_ctes("pairs", body="WITH " + boot_sql(
    "SELECT corpus, track_id, avg(delta - control) AS delta, 1 AS one FROM pairs GROUP BY 1, 2",
    ["corpus"], "track_id", ["delta"], "one", 3, 2000) + "\n" + ci_select(["corpus"], ["delta"])))
def a08(spark, sf):
    return ci_fix(agg.paired_comparison(load(spark, sf, "pairs"), "corpus", "track_id", "delta", "control", 3, 2000), ["delta"])


@query("a09_win_loss", with_ctes("pairs", body=f"""
WITH p AS (SELECT *, delta - control AS d, 8 * 1.1920928955078125e-07 * greatest(abs(control), 1e-12) AS tol FROM pairs)
SELECT corpus, codec_id, count(*) AS count, count(*) FILTER (d < 0) AS improved, count(*) FILTER (d = 0) AS unchanged, count(*) FILTER (d > 0) AS worsened,
 count(*) FILTER (d < -tol) AS improved_beyond, count(*) FILTER (d > tol) AS worsened_beyond, count(*) FILTER (control = 0) AS zero_base,
 {fx('avg(control)')} AS base_mean, {fx('avg(delta)')} AS current_mean, {fx('avg(d)')} AS mean_change, {fx('min(d)')} AS min_change, {fx('max(d)')} AS max_change,
 {fx('avg(d) / nullif(avg(control), 0)')} AS relative_change, {fx('median(d)')} AS median_change FROM p GROUP BY 1, 2"""))
def a09(spark, sf):
    out = agg.win_loss(load(spark, sf, "pairs"), ["corpus", "codec_id"], "control", "delta")
    return fixed(out, ["base_mean", "current_mean", "mean_change", "min_change", "max_change", "relative_change", "median_change"])


@query("a10_distribution", with_ctes("metric_rows", body=f"""
SELECT corpus, quality, count(*) AS count, {fx('avg(enhanced)')} AS mean, {fx('min(enhanced)')} AS min, {fx('max(enhanced)')} AS max,
 {fx('quantile_cont(enhanced, 0.5)')} AS p50, {fx('quantile_cont(enhanced, 0.9)')} AS p90, {fx('quantile_cont(enhanced, 0.95)')} AS p95,
 {fx('quantile_cont(enhanced, 0.99)')} AS p99 FROM metric_rows GROUP BY 1, 2"""))
def a10(spark, sf):
    out = agg.distribution(load(spark, sf, "metric_rows"), ["corpus", "quality"], "enhanced")
    return fixed(out, ["mean", "min", "max", "p50", "p90", "p95", "p99"])


@query("a11_nearest_rank", with_ctes("hops", body="""
WITH r AS (SELECT run_id, service_ns, row_number() OVER (PARTITION BY run_id ORDER BY service_ns) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM hops),
p AS (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS p)
SELECT run_id, p, CAST(service_ns AS DOUBLE) AS value FROM r, p WHERE k = greatest(ceil(n * p), 1)"""))
def a11(spark, sf):
    return agg.nearest_rank(load(spark, sf, "hops"), ["run_id"], "service_ns", [0.5, 0.95, 0.99])


GENRE_SQL = "CASE lower(trim(genre)) WHEN 'hip hop' THEN 'hiphop' WHEN 'r&b' THEN 'rnb' ELSE lower(trim(genre)) END"
AUDIT_SQL = f"""reviewed AS ({validation.REVIEW_SQL}), regional AS ({validation.REGION_SQL}),
g AS (SELECT * EXCLUDE (genre), {GENRE_SQL} AS genre,
  CASE WHEN region_name IS NOT NULL AND len(region_errors) = 0 THEN region_name ELSE 'unknown' END AS music_region FROM regional),
f AS (SELECT *, genre <> 'unlabeled' AND coalesce(genre_basis, '') = '' AS no_basis FROM g),
w AS (SELECT work, min(id) AS first_ok FROM f WHERE len(errors) = 0 AND NOT no_basis GROUP BY 1),
audit AS (SELECT f.*, CASE WHEN len(errors) > 0 THEN array_to_string(errors, ',') WHEN id > first_ok THEN 'duplicate_reviewed_work'
  WHEN no_basis THEN 'unreviewed_genre' ELSE '' END AS reasons FROM f LEFT JOIN w USING (work))"""


def audited(spark, sf):
    reviewed = validation.reviewed(spark, sf).withColumn("genre", rules.genre_normalise(F.col("genre")))
    return agg.coverage_audit(rules.region_information(reviewed, ("en", "fr", "es")))


@query("a12_coverage_audit", with_ctes("catalog", "reviews", body=f"""
WITH {AUDIT_SQL} SELECT id, CASE WHEN reasons = '' THEN 'approved' ELSE 'held' END AS status, reasons FROM audit"""))
def a12(spark, sf):
    return audited(spark, sf).select("id", "status", F.array_join("reasons", ",").alias("reasons"))


@query("a12_full_audit", with_ctes("catalog", "full_reviews", "evidence", "receipts", body=f"""
WITH reviewed AS ({validation.FULL_REVIEW_SQL}), g AS (SELECT * EXCLUDE (genre), {GENRE_SQL.replace('(genre)', '(coalesce(reviewed_genre, genre))')} AS genre,
  coalesce(content_kind, 'music') <> 'music' AS other_kind, coalesce(trim(reviewed_genre) = '', false) AS bad_genre FROM reviewed),
f AS (SELECT *, genre NOT IN ('unlabeled', 'unknown') AND coalesce(genre_basis, '') = '' AS no_basis FROM g),
w AS (SELECT work, min(id) AS first_ok FROM f WHERE len(errors) = 0 AND NOT other_kind AND NOT bad_genre AND NOT no_basis GROUP BY 1),
audit AS (SELECT f.*, CASE WHEN len(errors) > 0 THEN array_to_string(errors, ',') WHEN other_kind THEN 'not_a_music_recording' WHEN id > first_ok THEN 'duplicate_reviewed_work'
  WHEN bad_genre THEN 'invalid_reviewed_genre' WHEN no_basis THEN 'unreviewed_genre' ELSE '' END AS reasons FROM f LEFT JOIN w USING (work))
SELECT id, CASE WHEN reasons = '' THEN 'approved' ELSE 'held' END AS status, reasons FROM audit"""))
def a12_full(spark, sf):
    """Full reviews: receipts, all text fields, content kind and reviewed genre."""
    rows = validation.fully_reviewed(spark, sf).withColumn("genre", rules.genre_normalise(F.coalesce("reviewed_genre", "genre")))
    return agg.coverage_audit(rows).select("id", "status", F.array_join("reasons", ",").alias("reasons"))


TARGETS = [("music", "distinct-recordings", 100000), ("artists", "distinct-creators", 2), ("regions", "en", 5), ("regions", "de", 1),
           ("regional-artists", "fr", 100000), ("regional-genres", "en", 50), ("genres", "pop", 3), ("genre-artists", "rnb", 100000),
           ("regional-vocal-music", "en", 100000), ("regional-vocal-music", "fr", 1)]


@query("a12_coverage_gaps", with_ctes("catalog", "reviews", body=f"""
WITH {AUDIT_SQL}, ok AS (SELECT * FROM audit WHERE reasons = ''),
c AS (SELECT 'music' AS metric, 'distinct-recordings' AS name, count(*) AS actual FROM ok
 UNION ALL SELECT 'artists', 'distinct-creators', count(DISTINCT artist_id) FROM ok
 UNION ALL SELECT 'regions', music_region, count(*) FROM ok GROUP BY 2
 UNION ALL SELECT 'regional-artists', music_region, count(DISTINCT artist_id) FROM ok GROUP BY 2
 UNION ALL SELECT 'regional-genres', music_region, count(DISTINCT CASE WHEN genre <> 'unlabeled' THEN genre END) FROM ok GROUP BY 2
 UNION ALL SELECT 'genres', genre, count(*) FROM ok GROUP BY 2
 UNION ALL SELECT 'genre-artists', genre, count(DISTINCT artist_id) FROM ok GROUP BY 2
 UNION ALL SELECT 'regional-vocal-music', music_region, count(*) FILTER (vocal_music AND len(region_errors) = 0 AND
   ((music_region = 'en' AND vocal_language IN ('en')) OR (music_region = 'fr' AND vocal_language IN ('fr','br')))) FROM ok GROUP BY 2),
t(metric, name, required) AS (VALUES {', '.join(f"('{m}','{n}',{r}::BIGINT)" for m, n, r in TARGETS)})
SELECT metric, name, required, coalesce(actual, 0) AS actual, metric <> 'regional-genres' AS blocking FROM t LEFT JOIN c USING (metric, name)
WHERE coalesce(actual, 0) < required"""))
def a12_gaps(spark, sf):
    approved = audited(spark, sf).filter(F.col("status") == "approved")
    counts = agg.coverage_counts(approved, {"en": ["en"], "fr": ["fr", "br"]})
    return agg.coverage_gaps(counts, TARGETS, ["regional-genres"])


@query("a13_dominance", with_ctes("catalog", "reviews", body=f"""
WITH {AUDIT_SQL}, ok AS (SELECT * FROM audit WHERE reasons = ''), n AS (SELECT count(*) AS total FROM ok),
s AS (SELECT 'artist-dominance' AS metric, artist_id AS name, count(*) AS k, 0.05::DOUBLE AS lim FROM ok GROUP BY 2
 UNION ALL SELECT 'genre-dominance', genre, count(*), 0.2::DOUBLE FROM ok GROUP BY 2
 UNION ALL SELECT 'unknown-region', music_region, count(*), 0.1::DOUBLE FROM ok WHERE music_region = 'unknown' GROUP BY 2)
SELECT metric, name, {fx('k / total')} AS share, lim AS "limit" FROM s, n WHERE k / total > lim"""))
def a13(spark, sf):
    approved = audited(spark, sf).filter(F.col("status") == "approved")
    return fixed(agg.dominance(approved, {"artist-dominance": 0.05, "genre-dominance": 0.2, "unknown-region": 0.1}), ["share"])


@query("a14_recording_weights", with_ctes("manifest", body=f"""
SELECT row_id, {fx('sampling_weight / sum(sampling_weight) OVER (PARTITION BY track_id)', 9)} AS mass FROM manifest"""))
def a14(spark, sf):
    out = agg.recording_weights(load(spark, sf, "manifest"), "track_id", "sampling_weight")
    return out.select("row_id", fix(F.col("mass"), 9).alias("mass"))


@query("a15_speech_mix_ratios", with_ctes("catalog", body=f"""
WITH c AS (SELECT trim(genre) AS genre, count(*) AS recordings FROM catalog GROUP BY 1),
t AS (SELECT sum(recordings)::DOUBLE AS a, min(recordings) FILTER (genre <> 'unlabeled') AS s FROM c)
SELECT genre, recordings, {fx('1 / (1 + s / a)')} AS music_ratio, {fx('(s / a) / (1 + s / a)')} AS speech_ratio,
 {fx('1 / (1 + s / a) * recordings / a')} AS genre_ratio, recordings = s AS smallest FROM c, t"""))
def a15(spark, sf):
    rows = load(spark, sf, "catalog").select(F.col("id").alias("track_id"), "genre", F.lit("train").alias("split"))
    return fixed(agg.speech_mix_ratios(rows), ["music_ratio", "speech_ratio", "genre_ratio"])


@query("a16_corpus_weighted", with_ctes("metric_rows", body=f"""
SELECT {fx("0.8::DOUBLE * avg(delta) FILTER (corpus = 'ASIA') + 0.2::DOUBLE * avg(delta) FILTER (corpus = 'EUROPE')")} AS delta,
 {fx("0.8::DOUBLE * avg(enhanced) FILTER (corpus = 'ASIA') + 0.2::DOUBLE * avg(enhanced) FILTER (corpus = 'EUROPE')")} AS enhanced FROM metric_rows"""))
def a16(spark, sf):
    return fixed(agg.corpus_weighted(load(spark, sf, "metric_rows"), "corpus", {"ASIA": 0.8, "EUROPE": 0.2}, ["delta", "enhanced"]), ["delta", "enhanced"])


@query("a17_corpus_fraction_weights", with_ctes("metric_rows", body=f"""
WITH t AS (SELECT corpus, track_id, count(*) AS n FROM metric_rows GROUP BY 1, 2), c AS (SELECT corpus, count(*) AS k FROM t GROUP BY 1)
SELECT row_id, {fx("CASE corpus WHEN 'ASIA' THEN 253.0::DOUBLE / 254 WHEN 'EUROPE' THEN 1.0::DOUBLE / 254 ELSE 0 END / k / n", 12)} AS mass
FROM metric_rows JOIN t USING (corpus, track_id) JOIN c USING (corpus)"""))
def a17(spark, sf):
    out = agg.corpus_fraction_weights(load(spark, sf, "metric_rows"), {"ASIA": 253 / 254, "EUROPE": 1 / 254})
    return out.select("row_id", fix(F.col("mass"), 12).alias("mass"))


@query("a18_group_coverage", with_ctes("manifest", body="""
WITH t AS (SELECT split, track_id, min(corpus) AS corpus, min(source_checksum) AS source_checksum FROM manifest GROUP BY 1, 2)
SELECT split, 'corpus' AS dimension, corpus AS name, count(*) AS tracks FROM t GROUP BY 1, 3
UNION ALL SELECT split, 'source_checksum', source_checksum, count(*) FROM t GROUP BY 1, 3"""))
def a18(spark, sf):
    return agg.group_coverage(load(spark, sf, "manifest"), ["corpus", "source_checksum"])


CELLS_SQL = """SELECT unnest(['raw_full','raw_mid','log_full','log_mid']) AS arm, codec_id AS "group", track_id,
  unnest([cents * pct / 1e7, cents * (pct + row_id % 3 - 1) / 1e7, cents * (pct - row_id % 2) / 1e7, cents * (pct * 2 - 1) / 1e7]) AS value FROM metric_rows"""


# The same values in units of 1e-7: their sums are exact, so that signs of differences don't hang on the order of rows.
UNITS_SQL = """SELECT unnest(['raw_full','raw_mid','log_full','log_mid']) AS arm, codec_id AS "group", track_id,
  unnest([cents * pct, cents * (pct + row_id % 3 - 1), cents * (pct - row_id % 2), cents * (pct * 2 - 1)]) AS units FROM metric_rows"""
UNITS_MEAN = "sum(units)::DOUBLE / 1e7 / count(*)"


def cells(spark, sf, exact=False):
    """Clip rows of a 2x2 design; ``exact`` gives the values as decimals."""
    c, p, r = F.col("cents"), F.col("pct"), F.col("row_id")
    arm = [("raw_full", c * p), ("raw_mid", c * (p + r % 3 - 1)), ("log_full", c * (p - r % 2)), ("log_mid", c * (p * 2 - 1))]
    value = (lambda v: v.cast("decimal(20,0)") * F.lit(Decimal("1e-7").quantize(Decimal("1e-7")))) if exact else (lambda v: v / F.lit(1e7))
    exploded = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), value(v).alias("value")) for n, v in arm]))
    return load(spark, sf, "metric_rows").select(F.col("codec_id").alias("group"), "track_id", exploded.alias("x")).select("x.arm", "group", "track_id", "x.value")


CONTRASTS = {"compression": ("log_full", "raw_full"), "compression_mid": ("log_mid", "raw_mid"),
             "reduction": ("raw_mid", "raw_full"), "reduction_log": ("log_mid", "log_full")}


@query("a19_factorial_contrasts", with_ctes("metric_rows", body=f"""
WITH cells AS ({UNITS_SQL}), r AS (SELECT arm, "group", track_id, {UNITS_MEAN} AS v FROM cells GROUP BY 1, 2, 3),
k(contrast, a, b) AS (VALUES {', '.join(f"('{n}','{a}','{b}')" for n, (a, b) in CONTRASTS.items())}),
d AS (SELECT contrast, x."group", x.v AS new, y.v AS old, x.v - y.v AS d FROM k JOIN r x ON x.arm = k.a JOIN r y ON y.arm = k.b AND x."group" = y."group" AND x.track_id = y.track_id)
SELECT contrast, "group", {fx('avg(new) - avg(old)')} AS difference, {fx('(avg(new) / nullif(avg(old), 0) - 1) * 100', 4)} AS delta_pct,
 count(*) FILTER (d < 0) AS wins, count(*) FILTER (d > 0) AS losses, count(*) FILTER (d = 0) AS ties, {fx('median(d)')} AS median_difference FROM d GROUP BY 1, 2"""))
def a19(spark, sf):
    out = agg.factorial_contrasts(cells(spark, sf, exact=True), CONTRASTS, ["raw_full", "raw_mid", "log_full", "log_mid"])
    return fixed(fixed(out, ["difference", "median_difference"]), ["delta_pct"], 4)


@query("a19_factorial_interaction", with_ctes("metric_rows", body=f"""
WITH cells AS ({CELLS_SQL}), r AS (SELECT arm, "group", track_id, avg(value) AS v FROM cells GROUP BY 1, 2, 3), m AS (SELECT arm, "group", avg(v) AS v FROM r GROUP BY 1, 2)
SELECT "group", {fx("max(v) FILTER (arm = 'log_mid') - max(v) FILTER (arm = 'log_full') - (max(v) FILTER (arm = 'raw_mid') - max(v) FILTER (arm = 'raw_full'))")} AS interaction FROM m GROUP BY 1"""))
def a19_interaction(spark, sf):
    return fixed(agg.factorial_interaction(cells(spark, sf), ("log_mid", "log_full", "raw_mid", "raw_full")), ["interaction"])


PARTS_SQL = """SELECT row_id, b.band, c.component, (cents * c.k % (97 + b.band // 400)) / 1e3 AS value FROM metric_rows,
 (VALUES (0), (4000), (8000), (12000), (16000)) b(band), (VALUES ('amplitude', 1), ('log_shape', 3), ('envelope', 7), ('dynamics', 11)) c(component, k)"""
WEIGHT_SQL = """(CASE WHEN band = 0 THEN 0.25 / 4.25::DOUBLE ELSE 1 / 4.25::DOUBLE END * CASE component WHEN 'amplitude' THEN 1.0::DOUBLE WHEN 'log_shape' THEN 0.25::DOUBLE
 WHEN 'envelope' THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END * value)"""


def score_parts(spark, sf):
    kinds = [("amplitude", 1), ("log_shape", 3), ("envelope", 7), ("dynamics", 11)]
    items = [F.struct(F.lit(b).alias("band"), F.lit(n).alias("component"), ((F.col("cents") * k % (97 + b // 400)) / F.lit(1e3)).alias("value"))
             for b in agg.BAND_LOWS for n, k in kinds]
    return load(spark, sf, "metric_rows").select("row_id", F.explode(F.array(*items)).alias("p")).select("row_id", "p.*")


@query("a20_band_decomposition", with_ctes("metric_rows", body=f"""
WITH parts AS ({PARTS_SQL}), w AS (SELECT row_id, {WEIGHT_SQL} AS c FROM parts),
s AS (SELECT row_id, sum(c) AS rec, sum(abs(c)) AS size FROM w GROUP BY 1),
t AS (SELECT row_id, rec, size, rec + CASE WHEN row_id % 50 = 0 THEN 0.001::DOUBLE ELSE 0 END AS total FROM s)
SELECT row_id, {fx('rec')} AS reconstructed, {fx('total')} AS total, {fx('total - rec')} AS residual,
 abs(total - rec) <= 3.814697265625e-06 * greatest(size, abs(total)) AS consistent FROM t"""))
def a20(spark, sf):
    parts = score_parts(spark, sf)
    weighted = agg.contribution(F.col("band"), F.col("component"), F.col("value"))
    totals = parts.groupBy("row_id").agg(F.sum(weighted).alias("s")).select(
        "row_id", (F.col("s") + F.when(F.col("row_id") % 50 == 0, 0.001).otherwise(0.0)).alias("total")
    )
    return fixed(agg.band_decomposition(parts, totals, "row_id"), ["reconstructed", "total", "residual"])


STAGED_SQL = """SELECT unnest(['raw','native']) AS stage, quality AS role, track_id AS source, unnest([delta, enhanced]) AS candidate, unnest([control, baseline]) AS control FROM pairs"""


def staged(spark, sf):
    def s(stage, a, b):
        return F.struct(F.lit(stage).alias("stage"), F.col(a).alias("candidate"), F.col(b).alias("control"))
    both = F.explode(F.array(s("raw", "delta", "control"), s("native", "enhanced", "baseline")))
    return load(spark, sf, "pairs").select(F.col("quality").alias("role"), F.col("track_id").alias("source"), both.alias("x")).select("role", "source", "x.*")


@query("a21_attribution", with_ctes("pairs", body=f"""
WITH st AS ({STAGED_SQL}), p AS (SELECT stage, role, source, avg(candidate) AS a, avg(control) AS b, count(*) AS n FROM st GROUP BY 1, 2, 3),
o AS (SELECT stage, role, CAST(sum(n) AS BIGINT) AS cases, count(*) AS sources, avg(a) AS ca, avg(b) AS co, count(*) FILTER (a < b) AS better_sources, count(*) FILTER (a > b) AS worse_sources FROM p GROUP BY 1, 2)
SELECT o.stage, o.role, o.cases, o.sources, {fx('o.ca')} AS candidate_mean, {fx('o.co')} AS control_mean, {fx('o.ca - o.co')} AS delta, o.better_sources, o.worse_sources,
 CASE WHEN o.stage = 'native' THEN {fx('(o.ca - o.co) - (r.ca - r.co)')} END AS native_minus_raw FROM o LEFT JOIN o r ON r.stage = 'raw' AND r.role = o.role"""))
def a21(spark, sf):
    return fixed(agg.attribution(staged(spark, sf)), ["candidate_mean", "control_mean", "delta", "native_minus_raw"])


@query("a21_source_lists", with_ctes("pairs", body=f"""
WITH st AS ({STAGED_SQL}), p AS (SELECT stage, role, source, avg(candidate) - avg(control) AS d FROM st GROUP BY 1, 2, 3)
SELECT stage, role, CASE WHEN abs(d) < 1e-9 THEN 'tie' WHEN d < 0 THEN 'better' ELSE 'worse' END AS verdict, count(*) AS sources FROM p GROUP BY 1, 2, 3"""))
def a21_lists(spark, sf):
    return agg.source_lists(staged(spark, sf)).groupBy("stage", "role", "verdict").agg(F.count(F.lit(1)).alias("sources"))


@query("a22_guards", with_ctes("pairs", body="WITH " + boot_sql(
    "SELECT corpus, quality, track_id, avg(delta - control) AS delta, 1 AS one FROM pairs WHERE pct <> 0 GROUP BY 1, 2, 3",
    ["corpus", "quality"], "track_id", ["delta"], "one", 20261012, 2000) + "\n" + ci_select(["corpus", "quality"], ["delta"],
    ", CASE WHEN clusters < 2 THEN 'unsupported' WHEN delta_hi <= 0.0005 THEN 'supported' WHEN delta_lo > 0.0005 THEN 'regression' ELSE 'inconclusive' END AS status")))
def a22(spark, sf):
    weak = load(spark, sf, "pairs").filter(F.col("pct") != 0)
    out = agg.guards(weak, ["corpus", "quality"], "track_id", "delta", "control", 5e-4, 20261012, 2000)
    return ci_fix(out, ["delta"])


@query("a23_support_checks", with_ctes("pairs", body="""
WITH w AS (SELECT avg(delta) FILTER (corpus = 'ASIA') AS a, avg(control) FILTER (corpus = 'ASIA') AS b, avg(delta) FILTER (corpus = 'EUROPE') AS c, avg(control) FILTER (corpus = 'EUROPE') AS d,
  avg(delta) FILTER (corpus = 'NOWHERE') AS e FROM pairs),
l AS (SELECT 'music_below_control' AS "check", a < b - 1e-6 AS passed FROM w UNION ALL SELECT 'speech_not_worse', c <= d + 1e-6 FROM w UNION ALL SELECT 'unmeasured', coalesce(e < 0, false) FROM w)
SELECT * FROM l UNION ALL SELECT 'all_pass', bool_and(passed) FROM l"""))
def a23(spark, sf):
    def mean(corpus, m):
        return F.avg(F.when(F.col("corpus") == corpus, F.col(m)))
    wide = load(spark, sf, "pairs").agg(
        mean("ASIA", "delta").alias("a"), mean("ASIA", "control").alias("b"), mean("EUROPE", "delta").alias("c"),
        mean("EUROPE", "control").alias("d"), mean("NOWHERE", "delta").alias("e"),
    )
    return agg.support_checks(wide, {"music_below_control": F.col("a") < F.col("b") - 1e-6, "speech_not_worse": F.col("c") <= F.col("d") + 1e-6, "unmeasured": F.col("e") < 0})


GATE_ROWS = """SELECT track_id, delta, pct % 3 * 1e-7 AS chunk_error, CASE WHEN cents % 100000 = 1 THEN 1 ELSE 0 END AS clipped, 0 AS nonfinite,
 row_id % 211 = 0 AS false_bypass, channel_role IN ('left','right') AS stereo, true AS stereo_complete, cents / 1e7 AS perceptual, abs(delta) / 10 AS low FROM metric_rows"""


@query("a24_release_gates", with_ctes("metric_rows", body="WITH " + boot_sql(
    "SELECT 'overall' AS dimension, 'all' AS stratum, track_id, count(*) AS rows, sum(delta) AS delta FROM metric_rows GROUP BY track_id"
    " UNION ALL SELECT 'corpus', corpus, track_id, count(*), sum(delta) FROM metric_rows GROUP BY corpus, track_id"
    " UNION ALL SELECT 'quality', quality, track_id, count(*), sum(delta) FROM metric_rows GROUP BY quality, track_id",
    ["dimension", "stratum"], "track_id", ["delta"], "rows", 5, 2000) + f""",
g AS ({GATE_ROWS}), r AS (SELECT max(chunk_error) AS chunk, sum(clipped) AS clipped, sum(nonfinite) AS nonfinite, avg(false_bypass::INT) AS bypass, count(*) FILTER (stereo) AS st,
 count(*) FILTER (stereo AND stereo_complete) AS sc, count(perceptual) AS scored, count(*) AS rows, avg(perceptual) AS perceptual, avg(low) AS low FROM g),
s AS (SELECT count(*) FILTER (delta_lo > 0) AS regressions, count(DISTINCT dimension) AS dims FROM ci WHERE dimension <> 'overall'),
o AS (SELECT delta_mean, delta_hi FROM ci WHERE dimension = 'overall'),
l AS (SELECT unnest(['mean_high_band_improvement','high_band_improvement_ci','required_strata_no_supported_regression','low_band_preservation','stream_chunk_equivalence',
 'finite_unclipped_output','gate_false_bypass','parity_evidence','perceptual_score','manifest_file_audit','stereo_metrics_present']) AS gate,
 unnest([delta_mean < 0, delta_hi < 0.5, regressions = 0 AND dims >= 2, low <= 0.5, chunk <= 1e-6, clipped <= 0 AND nonfinite <= 0, bypass <= 0.01, true,
  scored = rows AND perceptual >= 0.1, false, st > 0 AND st = sc]) AS passed FROM o, s, r)
SELECT * FROM l UNION ALL SELECT 'all_pass', bool_and(passed) FROM l"""))
def a24(spark, sf):
    m = load(spark, sf, "metric_rows")
    ci = agg.strata_intervals(m, "track_id", ["delta"], ["corpus", "quality"], 5, 2000)
    rows = m.select(
        (F.col("pct") % 3 * F.lit(1e-7)).alias("chunk_error"), F.when(F.col("cents") % 100000 == 1, 1).otherwise(0).alias("clipped"),
        F.lit(0).alias("nonfinite"), (F.col("row_id") % 211 == 0).alias("false_bypass"), F.col("channel_role").isin("left", "right").alias("stereo"),
        F.lit(True).alias("stereo_complete"), (F.col("cents") / F.lit(1e7)).alias("perceptual"),
    )
    low = m.agg((F.avg(F.abs("delta")) / 10).alias("low_mean"))
    overall = ci.filter(F.col("dimension") == "overall").select(F.col("delta_mean").alias("mean_delta"), F.col("delta_hi").alias("hi_delta")).crossJoin(low)
    strata = ci.filter(F.col("dimension") != "overall").select("dimension", F.col("delta_lo").alias("lo"))
    limits = {"mean_delta_max": 0.0, "ci_upper_max": 0.5, "dimensions": 2, "low_mean_max": 0.5, "chunk_max": 1e-6, "clipped_max": 0,
              "nonfinite_max": 0, "false_bypass_max": 0.01, "perceptual_min": 0.1}
    return agg.release_gates(overall, strata, rows, limits, {"parity": True, "files_audited": False})


@query("a30_concentration", with_ctes("pairs", body=f"""
WITH p AS (SELECT corpus, row_id, delta - control AS d, row_number() OVER (PARTITION BY corpus ORDER BY delta - control DESC, row_id) AS rank,
 sum(delta - control) OVER (PARTITION BY corpus) AS net, sum(greatest(delta - control, 0)) OVER (PARTITION BY corpus) AS pos FROM pairs)
SELECT corpus, rank, row_id, {fx('d')} AS change, {fx('d / nullif(net, 0)')} AS net_share, {fx('greatest(d, 0) / greatest(pos, 1e-30)')} AS positive_share FROM p WHERE rank <= 5"""))
def a30(spark, sf):
    p = load(spark, sf, "pairs").withColumn("change", F.col("delta") - F.col("control"))
    out = agg.concentration(p, ["corpus"], "row_id", "change", 5)
    return fixed(out.withColumn("rank", F.col("rank").cast("bigint")), ["change", "net_share", "positive_share"])


@query("a30_remaining_mean", with_ctes("pairs", body=f"""
WITH p AS (SELECT corpus, delta - control AS d, row_number() OVER (PARTITION BY corpus ORDER BY delta - control DESC, row_id) AS rank FROM pairs)
SELECT corpus, {fx('avg(d)')} AS remaining_mean FROM p WHERE rank > 3 GROUP BY 1"""))
def a30_rest(spark, sf):
    p = load(spark, sf, "pairs").withColumn("change", F.col("delta") - F.col("control"))
    return fixed(agg.remaining_mean(p, ["corpus"], "row_id", "change", 3), ["remaining_mean"])


@query("a31_error_summary", with_ctes("metric_rows", body=f"""
WITH t AS (SELECT corpus, channel_role, track_id, avg(baseline) AS b FROM metric_rows GROUP BY 1, 2, 3), r AS (SELECT corpus, channel_role, count(*) AS recordings, avg(b) AS rm FROM t GROUP BY 1, 2)
SELECT corpus, channel_role, count(*) AS cases, any_value(recordings) AS recordings, {fx('avg(baseline)')} AS baseline_clip, {fx('any_value(rm)')} AS baseline_recording,
 {fx('max(baseline)')} AS max_error, {fx('quantile_cont(baseline, 0.95)')} AS p95_error FROM metric_rows JOIN r USING (corpus, channel_role) GROUP BY 1, 2"""))
def a31(spark, sf):
    out = agg.error_summary(load(spark, sf, "metric_rows"), ["corpus", "channel_role"], "track_id", "baseline")
    return fixed(out, ["baseline_clip", "baseline_recording", "max_error", "p95_error"])


@query("a32_power_shares", with_ctes("metric_rows", body=f"""
SELECT corpus, channel_role, {fx('sum(baseline * baseline)', 3)} AS power, {fx('sum(pct / 100 * baseline * baseline) / nullif(sum(baseline * baseline), 0)')} AS raw,
 {fx('sum((1 - pct / 100) * baseline * baseline) / nullif(sum(baseline * baseline), 0)')} AS rest FROM metric_rows GROUP BY 1, 2"""))
def a32(spark, sf):
    m = load(spark, sf, "metric_rows").withColumn("raw", F.col("pct") / F.lit(100.0)).withColumn("rest", 1 - F.col("raw"))
    return fixed(fixed(agg.power_shares(m, ["corpus", "channel_role"], "baseline", ["raw", "rest"]), ["raw", "rest"]), ["power"], 3)


@query("a33_violation_counts", with_ctes("metric_rows", body="""
WITH v AS (SELECT corpus, codec_id, unnest(list_filter([CASE WHEN pct > 0 THEN 'peak' END, CASE WHEN cents > 5000000 THEN 'rms' END, CASE WHEN row_id % 7 = 0 THEN 'difference' END], lambda z: z IS NOT NULL)) AS role FROM metric_rows)
SELECT corpus, codec_id, role, count(*) AS violations FROM v GROUP BY 1, 2, 3"""))
def a33(spark, sf):
    roles = F.array_compact(F.array(F.when(F.col("pct") > 0, "peak"), F.when(F.col("cents") > 5000000, "rms"), F.when(F.col("row_id") % 7 == 0, "difference")))
    return agg.violation_counts(load(spark, sf, "metric_rows").withColumn("fails", roles), ["corpus", "codec_id"], "fails")


@query("a34_joint_improvement", with_ctes("pairs", body="""
SELECT codec_id, quality, count(*) AS cases, count(*) FILTER (delta < control AND delta < 0 AND enhanced < baseline) AS all_improved,
 count(*) FILTER (delta <= control AND delta <= 0 AND enhanced <= baseline) AS none_increased FROM pairs GROUP BY 1, 2"""))
def a34(spark, sf):
    p = load(spark, sf, "pairs").select("codec_id", "quality", (F.col("delta") - F.col("control")).alias("d1"), F.col("delta").alias("d2"), (F.col("enhanced") - F.col("baseline")).alias("d3"))
    return agg.joint_improvement(p, ["codec_id", "quality"], ["d1", "d2", "d3"])


@query("a35_validation_aggregate", with_ctes("metric_rows", body="WITH s AS (" + strata_sql(
    DIMS, "count(*) AS rows, sum(CAST(enhanced AS DECIMAL(27,12)))::DOUBLE / count(*) AS enhanced, sum(CAST(delta AS DECIMAL(27,12)))::DOUBLE / count(*) AS delta", "metric_rows")
    + f") SELECT dimension, stratum, rows, {fx('enhanced')} AS enhanced, {fx('delta')} AS delta FROM s"))
def a35(spark, sf):
    return fixed(agg.validation_aggregate(load(spark, sf, "metric_rows"), DIMS, ["enhanced", "delta"]), ["enhanced", "delta"])


@query("a36_control_assessment", with_ctes("pairs", body=f"""
WITH p AS (SELECT corpus, codec_id, track_id, avg(delta) - abs(avg(control)) AS m, avg(enhanced) AS l, avg(baseline) AS i FROM pairs GROUP BY 1, 2, 3),
o AS (SELECT corpus, codec_id, avg(m) AS mm, count(*) FILTER (m > 0) AS wins, count(*) AS sources, avg(l) < least(avg(i), 450) AS loss_improved FROM p GROUP BY 1, 2)
SELECT corpus, codec_id, {fx('mm')} AS mean_margin, wins, sources, loss_improved, mm > 0 AND wins > sources / 2 AND loss_improved AS passes FROM o"""))
def a36(spark, sf):
    out = agg.control_assessment(load(spark, sf, "pairs"), ["corpus", "codec_id"], "track_id", "delta", "control", "enhanced", "baseline", 450.0)
    return fixed(out, ["mean_margin"])


@query("a42_stage_means", with_ctes("metric_rows", body=f"""
WITH b AS (SELECT corpus, quality, unnest([0,1,2,3,4]) AS band, unnest([baseline, enhanced, delta, cents / 1e7, pct * 1e0]) AS v FROM metric_rows),
m AS (SELECT corpus, quality, median(baseline) AS mc FROM metric_rows GROUP BY 1, 2)
SELECT corpus, quality, band, {fx('avg(v)')} AS mean, count(*) AS clips, {fx('any_value(mc)')} AS median_cutoff FROM b JOIN m USING (corpus, quality) GROUP BY 1, 2, 3"""))
def a42(spark, sf):
    bands = F.array("baseline", "enhanced", "delta", F.col("cents") / F.lit(1e7), F.col("pct").cast("double"))
    out = agg.stage_means(load(spark, sf, "metric_rows").withColumn("bands", bands), ["corpus", "quality"], "bands", "baseline")
    return fixed(out, ["mean", "median_cutoff"])


@query("a43_parity_evidence", with_ctes("metric_rows", body="""
WITH c AS (SELECT row_id AS "case", abs(delta) AS err, enhanced AS mag FROM metric_rows WHERE row_id % 1000 <> 11),
e AS (SELECT row_id AS "case" FROM metric_rows WHERE row_id % 1000 <> 21)
SELECT 'missing_cases' AS "check", count(*) AS failures FROM e WHERE "case" NOT IN (SELECT "case" FROM c)
UNION ALL SELECT 'unexpected_cases', count(*) FROM c WHERE "case" NOT IN (SELECT "case" FROM e)
UNION ALL SELECT 'err', count(*) FILTER (NOT err <= 60) FROM c UNION ALL SELECT 'mag', count(*) FILTER (NOT mag <= 1000) FROM c"""))
def a43(spark, sf):
    m = load(spark, sf, "metric_rows").select(F.col("row_id").alias("case"), F.abs("delta").alias("err"), F.col("enhanced").alias("mag"))
    return agg.parity_evidence(m.filter(F.col("case") % 1000 != 11), m.filter(F.col("case") % 1000 != 21).select("case"), {"err": 60.0, "mag": 1000.0})


@query("a44_variant_vs_control", with_ctes("metric_rows", body=f"""
WITH cells AS ({UNITS_SQL}), r AS (SELECT "group", arm AS variant, track_id, {UNITS_MEAN} AS v FROM cells GROUP BY 1, 2, 3),
d AS (SELECT r."group", r.variant, r.v, o.v AS o, r.v - o.v AS d FROM r JOIN r o ON o.variant = 'raw_full' AND o."group" = r."group" AND o.track_id = r.track_id)
SELECT "group", variant, {fx('avg(o)')} AS control, {fx('avg(v)')} AS candidate, {fx('(avg(v) / nullif(avg(o), 0) - 1) * 100', 4)} AS delta_pct,
 count(*) FILTER (d < 0) AS wins, count(*) FILTER (d > 0) AS losses, {fx('median(d)')} AS median_difference FROM d GROUP BY 1, 2"""))
def a44(spark, sf):
    out = agg.variant_vs_control(cells(spark, sf, exact=True).withColumnRenamed("arm", "variant"), "raw_full", "value")
    return fixed(fixed(out, ["control", "candidate", "median_difference"]), ["delta_pct"], 4)


@query("a45_change_strata", with_ctes("pairs", body="WITH s AS (" + strata_sql(
    ["corpus", "codec_id", "channel_role"], "count(*) AS count, count(DISTINCT track_id) AS clusters, avg(delta - control) AS m", "pairs")
    + f") SELECT dimension, stratum, count, clusters, 'delta' AS metric, {fx('m')} AS mean FROM s"))
def a45(spark, sf):
    return fixed(agg.change_strata(load(spark, sf, "control_rows"), load(spark, sf, "metric_rows"), "row_id", "track_id", ["delta"], ["corpus", "codec_id", "channel_role"]), ["mean"])


@query("a46_trace_summary", with_ctes("metric_rows", body=f"""
SELECT track_id, {fx('avg((pct > 0)::INT)')} AS active_ratio, {fx('coalesce(avg(pct) FILTER (pct > 0), 0)')} AS mean_gain, {fx('max(abs(enhanced))')} AS peak,
 {fx('max(abs(enhanced - baseline))')} AS max_change FROM metric_rows GROUP BY 1"""))
def a46(spark, sf):
    m = load(spark, sf, "metric_rows").withColumn("active", F.col("pct") > 0)
    return fixed(agg.trace_summary(m, ["track_id"], "active", "pct", "enhanced", "baseline"), ["active_ratio", "mean_gain", "peak", "max_change"])
