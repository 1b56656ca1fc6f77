"""Rule and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelane.functions.numeric import fix
from wavelane.operators import intervals, rules
from wavelane.plans.adapters import load
from wavelane.plans.registry import fx, query, with_ctes

CORPORA = ("AFRICA", "AMERICA", "ASIA", "EUROPE")


def sql_codes(pairs) -> str:
    """SQL: comma-joined codes of the conditions that hold."""
    parts = ", ".join(f"CASE WHEN coalesce({c}, true) THEN '{n}' END" for n, c in pairs)
    return f"array_to_string(list_filter([{parts}], lambda z: z IS NOT NULL), ',')"


V01_SQL = sql_codes([
    ("missing_field", "row_id IS NULL OR track_id IS NULL OR split IS NULL"),
    ("duplicate_row_id", "copies > 1"),
    ("invalid_split", "split NOT IN ('train','validation','test')"),
    ("schema_version", "schema_version <> 2"),
    ("recipe_hash", "recipe_hash <> 'recipe-1'"),
    ("corpus_track_mismatch", "corpus NOT IN ('AFRICA','AMERICA','ASIA','EUROPE') OR NOT starts_with(track_id, corpus || ':')"),
    ("sample_rate", "sample_rate NOT IN (44100, 48000)"),
    ("sample_interval", "length_samples <= 0 OR start_sample < 0"),
    ("held_out_in_train", "split = 'train' AND held_out"),
    ("channel_role", "channel_role NOT IN ('mono','left','right','mid','side')"),
    ("residual_alignment", "abs(residual_alignment_samples) > 1"),
    ("cutoff", "isnan(measured_cutoff_hz) OR measured_cutoff_hz < 0 OR measured_cutoff_hz > sample_rate / 2"),
    ("unsafe_path", "starts_with(clean_path, '/') OR clean_path LIKE '%..%'"),
])


@query("v01_validate_manifest", with_ctes("manifest", body=f"""
WITH d AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS copies FROM manifest),
c AS (SELECT row_id, {V01_SQL} AS violations FROM d)
SELECT row_id, violations FROM c WHERE violations <> ''"""))
def v01(spark, sf):
    out = rules.held(rules.validate_manifest(load(spark, sf, "manifest"), "recipe-1", CORPORA, required=("row_id", "track_id", "split")))
    return out.select("row_id", F.array_join("violations", ",").alias("violations"))


FULL_V01 = V01_SQL.replace("row_id IS NULL OR track_id IS NULL OR split IS NULL", "missing_fields <> ''").replace("clean_path LIKE '%..%'", "clean_path LIKE '%..%' OR starts_with(degraded_path, '/') OR degraded_path LIKE '%..%'")
LACKING = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in rules.REQUIRED_FIELDS) + "], lambda z: z IS NOT NULL), ',')"


@query("v01_required_fields", with_ctes("full_manifest", body=f"""
WITH d AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS copies, {LACKING} AS missing_fields FROM full_manifest),
c AS (SELECT row_id, missing_fields, {FULL_V01} AS violations FROM d)
SELECT row_id, violations, missing_fields FROM c WHERE violations <> ''"""))
def v01_full(spark, sf):
    """All required fields, both paths and an empty manifest."""
    out = rules.held(rules.validate_manifest(rules.require_rows(load(spark, sf, "full_manifest")), "recipe-1", CORPORA))
    return out.select("row_id", F.array_join("violations", ",").alias("violations"), F.array_join("missing_fields", ",").alias("missing_fields"))


@query("v02_check_codec_metadata", with_ctes("manifest", body="""
WITH r(codec_id, w_codec, w_encoder, w_setting) AS (VALUES ('A','aac','reference',128.0::DOUBLE), ('R','opus','reference',64.0::DOUBLE))
SELECT m.codec_id, CASE WHEN r.codec_id IS NULL THEN 'absent'
  WHEN codec IS NOT DISTINCT FROM w_codec AND encoder IS NOT DISTINCT FROM w_encoder AND codec_setting IS NOT DISTINCT FROM w_setting
  THEN 'ok' ELSE 'differs' END AS codec_status, count(*) AS n
FROM manifest m LEFT JOIN r USING (codec_id) GROUP BY 1, 2"""))
def v02(spark, sf):
    recipe = spark.createDataFrame(
        [("A", "aac", "reference", 128.0), ("R", "opus", "reference", 64.0)],
        "codec_id string, codec string, encoder string, codec_setting double",
    )
    out = rules.check_codec_metadata(load(spark, sf, "manifest"), recipe, ["codec", "encoder", "codec_setting"])
    return out.groupBy("codec_id", "codec_status").agg(F.count(F.lit(1)).alias("n"))


REVIEW_SQL = """
SELECT c.*, r.* EXCLUDE (id), CASE WHEN coalesce(status = 'accepted' AND scope = 'music-training', false) THEN
  list_sort(list_distinct(list_filter([
   CASE WHEN coalesce(audio_sha256 <> pcm, true) THEN 'source_review_audio_binding_mismatch' END,
   CASE WHEN NOT coalesce(commercial_training, false) THEN 'unresolved_commercial_training' END,
   CASE WHEN NOT coalesce(weight_distribution, false) THEN 'unresolved_apache_weight_distribution' END,
   CASE WHEN coalesce(unresolved_issues <> 0, true) THEN 'unresolved_source_rights' END,
   CASE WHEN NOT coalesce(starts_with(evidence_url, 'https:'), false) THEN 'missing_primary_evidence_url' END,
   CASE WHEN trim(coalesce(grant_basis, '')) = '' THEN 'missing_grant_basis' END,
   CASE WHEN trim(coalesce(artist_id, '')) = '' THEN 'missing_artist_id' END], lambda z: z IS NOT NULL)))
  ELSE ['source_review_pending_or_incompatible'] END AS errors
FROM catalog c LEFT JOIN reviews r USING (id)"""

REGION_SQL = """
SELECT *, CASE WHEN region_name IS NULL THEN []
  WHEN NOT coalesce(region_basis IN ('publisher-repertoire','artist-repertoire','recorded-market'), false) THEN ['unverified_regional_basis']
  ELSE list_filter([CASE WHEN NOT coalesce(starts_with(evidence_url, 'https:'), false) THEN 'missing_primary_evidence_url' END,
   CASE WHEN coalesce(region_explanation, '') = '' THEN 'missing_regional_explanation' END,
   CASE WHEN region_name NOT IN ('en','fr','es') THEN 'unverified_region_name' END], lambda z: z IS NOT NULL) END AS region_errors
FROM reviewed"""


def reviewed(spark, sf):
    joined = load(spark, sf, "catalog").join(load(spark, sf, "reviews"), "id", "left")
    return rules.review_errors(joined, "music-training", ["grant_basis", "artist_id"])


@query("v06_review_errors", with_ctes("catalog", "reviews", body=f"""
WITH reviewed AS ({REVIEW_SQL}) SELECT id, array_to_string(errors, ',') AS errors FROM reviewed"""))
def v06(spark, sf):
    return reviewed(spark, sf).select("id", F.array_join("errors", ",").alias("errors"))


FULL_REVIEW_SQL = """
SELECT c.*, r.* EXCLUDE (id), CASE WHEN coalesce(status = 'accepted' AND scope = 'music-training', false) THEN
  list_sort(list_distinct(list_concat(list_filter([
   CASE WHEN coalesce(audio_sha256 <> pcm, true) THEN 'source_review_audio_binding_mismatch' END,
   CASE WHEN NOT coalesce(commercial_training, false) THEN 'unresolved_commercial_training' END,
   CASE WHEN NOT coalesce(weight_distribution, false) THEN 'unresolved_apache_weight_distribution' END,
   CASE WHEN coalesce(unresolved_issues <> 0, true) THEN 'unresolved_source_rights' END,
   CASE WHEN trim(credited_author) = '' THEN 'invalid_credited_author' END, """ + ", ".join(f"CASE WHEN trim(coalesce({b}, '')) = '' THEN 'missing_{b}' END" for b in rules.REVIEW_BASES) + """],
  lambda z: z IS NOT NULL), coalesce(x.receipt_errors, ['missing_primary_evidence']))))
  ELSE ['source_review_pending_or_incompatible'] END AS errors
FROM catalog c LEFT JOIN full_reviews r USING (id) LEFT JOIN (SELECT e.id, list_filter(list_distinct(list(CASE WHEN NOT starts_with(e.url, 'https://') THEN 'missing_primary_evidence_url'
 WHEN k.sha256 IS DISTINCT FROM e.sha256 THEN 'missing_or_changed_primary_evidence' END)), lambda z: z IS NOT NULL) AS receipt_errors FROM evidence e LEFT JOIN receipts k USING (path) GROUP BY 1) x USING (id)"""


def fully_reviewed(spark, sf):
    """The catalog with full reviews and the errors of their receipts."""
    receipts = rules.receipt_errors(load(spark, sf, "evidence"), load(spark, sf, "receipts"))
    joined = load(spark, sf, "catalog").join(load(spark, sf, "full_reviews"), "id", "left").join(receipts, "id", "left")
    return rules.review_errors(joined, "music-training", receipts="receipt_errors", credited="credited_author")


@query("v06_full_review", with_ctes("catalog", "full_reviews", "evidence", "receipts", body=f"""
WITH reviewed AS ({FULL_REVIEW_SQL}) SELECT id, array_to_string(errors, ',') AS errors FROM reviewed"""))
def v06_full(spark, sf):
    return fully_reviewed(spark, sf).select("id", F.array_join("errors", ",").alias("errors"))


@query("v07_finite_guard", with_ctes("metric_rows", body="""
WITH x AS (SELECT CASE WHEN pct <> 0 THEN delta / pct ELSE 'inf'::DOUBLE END AS per_pct, baseline FROM metric_rows)
SELECT 'baseline' AS metric, count(*) FILTER (isnan(baseline) OR isinf(baseline)) AS nonfinite FROM x
UNION ALL SELECT 'per_pct', count(*) FILTER (isnan(per_pct) OR isinf(per_pct)) FROM x"""))
def v07(spark, sf):
    rows = load(spark, sf, "metric_rows").withColumn(
        "per_pct", F.when(F.col("pct") != 0, F.col("delta") / F.col("pct")).otherwise(F.lit(float("inf")))
    )
    return rules.finite_guard(rows, ["baseline", "per_pct"])


@query("v08_region_information", with_ctes("catalog", "reviews", body=f"""
WITH reviewed AS ({REVIEW_SQL}), regional AS ({REGION_SQL})
SELECT id, CASE WHEN region_name IS NOT NULL AND len(region_errors) = 0 THEN region_name ELSE 'unknown' END AS music_region,
  array_to_string(region_errors, ',') AS region_errors FROM regional"""))
def v08(spark, sf):
    out = rules.region_information(reviewed(spark, sf), ("en", "fr", "es"))
    return out.select("id", "music_region", F.array_join("region_errors", ",").alias("region_errors"))


@query("v09_candidate_reason", with_ctes("catalog", body="""
SELECT id, CASE WHEN id % 6 = 5 THEN 'historical_source_or_work_alias' WHEN review_flag IS NOT NULL THEN 'unresolved_source_quality'
 WHEN sample_rate < 44100 OR duration_seconds < 35 THEN 'insufficient_rate_or_duration'
 WHEN channels NOT IN (1, 2) THEN 'unsupported_channels' WHEN id % 43 = 0 THEN 'original_checksum_not_verified'
 WHEN author = 'src3' THEN 'missing_publisher_evidence' END AS reason FROM catalog"""))
def v09(spark, sf):
    catalog = load(spark, sf, "catalog").select(
        "*",
        (F.col("id") % 6 == 5).alias("exposed"),
        (F.col("id") % 43 != 0).alias("checksum_verified"),
        F.when(F.col("author") != "src3", F.col("pcm")).alias("evidence_path"),
    )
    return rules.candidate_reason(catalog).select("id", "reason")


@query("v10_validate_pairs", with_ctes("spectra", body=f"""
WITH p AS (SELECT a.track_id, a.frame, CASE WHEN a.frame % 7 = 0 THEN list_transform(a.samples, lambda v: v * 1e-7) ELSE a.samples END AS c,
  CASE WHEN a.frame % 11 = 0 THEN list_transform(coalesce(b.samples, a.samples), lambda v: v * 100) ELSE coalesce(b.samples, a.samples) END AS d
  FROM spectra a LEFT JOIN spectra b ON a.track_id = b.track_id AND b.frame = a.frame + 1),
r AS (SELECT *, sqrt(list_sum(list_transform(c, lambda v: v * v)) / len(c)) AS cr, sqrt(list_sum(list_transform(d, lambda v: v * v)) / len(d)) AS dr,
  greatest(list_max(list_transform(c, lambda v: abs(v))), list_max(list_transform(d, lambda v: abs(v)))) AS peak FROM p)
SELECT track_id, frame, {fx('cr')} AS clean_rms, {fx('dr')} AS degraded_rms,
  CASE WHEN peak > 8 THEN 'peak' WHEN least(cr, dr) < 1e-6 THEN 'silent' END AS reason FROM r"""))
def v10(spark, sf):
    s = load(spark, sf, "spectra")
    clean = F.when(F.col("frame") % 7 == 0, F.transform("samples", lambda v: v * 1e-7)).otherwise(F.col("samples"))
    after = s.select("track_id", (F.col("frame") - 1).alias("frame"), F.col("samples").alias("next"))
    both = s.withColumn("clean", clean).join(after, ["track_id", "frame"], "left").withColumn("next", F.coalesce("next", "samples"))
    pairs = both.withColumn(
        "degraded", F.when(F.col("frame") % 11 == 0, F.transform("next", lambda v: v * 100)).otherwise(F.col("next"))
    )
    out = rules.validate_pairs(pairs, "clean", "degraded")
    return out.select("track_id", "frame", fix(F.col("clean_rms")).alias("clean_rms"), fix(F.col("degraded_rms")).alias("degraded_rms"), "reason")


@query("v11_publisher_evidence", """
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN 1 THEN 'https://creativecommons.org/licenses/by/3.0'
  WHEN 2 THEN 'https://creativecommons.org/licenses/by-nc/4.0/' ELSE 'https://example.org/licenses/by/4.0/' END AS url, md5(html) AS md5,
  CASE WHEN page_id % 5 = 0 THEN 'derivative' ELSE 'original' END AS source, page_id % 9 = 0 AS stale, page_id % 10 < 7 AS by4 FROM pages),
k AS (SELECT *, CASE page_id % 4 WHEN 0 THEN '/licenses/by/4.0' WHEN 1 THEN '/licenses/by/3.0' END AS licence FROM p)
SELECT page_id, licence, CASE WHEN licence IS NULL THEN 'license_not_preapproved'
  WHEN licence <> CASE WHEN by4 THEN '/licenses/by/4.0' ELSE '/licenses/by/3.0' END THEN 'license_differs_from_publisher'
  WHEN source <> 'original' THEN 'no_original_file' WHEN stale THEN 'original_checksum_differs' END AS evidence_reason FROM k""")
def v11(spark, sf):
    k = F.col("page_id")
    base = "https://creativecommons.org/licenses/"
    pages = load(spark, sf, "pages").select(
        k,
        F.when(k % 4 == 0, base + "by/4.0/").when(k % 4 == 1, base + "by/3.0").when(k % 4 == 2, base + "by-nc/4.0/")
        .otherwise("https://example.org/licenses/by/4.0/").alias("license_url"),
        F.array(F.when(k % 10 < 7, base + "by/4.0/").otherwise(base + "by/3.0/")).alias("published"),
        F.md5("html").alias("md5"),
        F.array(
            F.struct(F.lit("cover").alias("name"), F.lit("x").alias("md5"), F.lit("original").alias("source")),
            F.struct(
                F.lit("track").alias("name"),
                F.when(k % 9 == 0, F.lit("stale")).otherwise(F.md5("html")).alias("md5"),
                F.when(k % 5 == 0, "derivative").otherwise("original").alias("source"),
            ),
        ).alias("files"),
        F.lit("track").alias("file_name"),
    )
    out = rules.publisher_evidence(pages, "license_url", "published", "files", "file_name", "md5")
    return out.select("page_id", "licence", "evidence_reason")


@query("v12_receipt_drift", """
WITH e AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 77 <> 0),
a AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN sha256(lower(text)) ELSE sha256(text) END AS h FROM documents WHERE doc_id % 91 <> 0)
SELECT doc_id AS artifact, e.h AS expected, a.h AS actual FROM e FULL JOIN a USING (doc_id) WHERE e.h IS DISTINCT FROM a.h""")
def v12(spark, sf):
    d = load(spark, sf, "documents").withColumnRenamed("doc_id", "artifact")
    expected = d.filter(F.col("artifact") % 77 != 0).select("artifact", F.sha2("text", 256).alias("h"))
    actual = d.filter(F.col("artifact") % 91 != 0).select(
        "artifact", F.when(F.col("artifact") % 50 == 0, F.sha2(F.lower("text"), 256)).otherwise(F.sha2("text", 256)).alias("h")
    )
    return rules.receipt_drift(expected, actual, "artifact", "h")


def schedule(spark, sf):
    """Crops as a schedule with its manifest-side flags, and the protected intervals."""
    crops = load(spark, sf, "crops")
    protected = crops.filter(F.col("codec_id") == "signup").select("source_id", "lo_tick", "hi_tick")
    specs = crops.filter(F.col("codec_id") != "signup").select(
        "spec_id", "source_id", "lo_tick", "hi_tick",
        F.when(F.col("source_id") % 10 == 0, "test").otherwise("train").alias("split"),
        (F.col("codec_id") == "error").alias("held_out"),
    )
    return specs, protected


@query("v13_schedule_purity", with_ctes("crops", body="""
WITH p AS (SELECT source_id, lo_tick, hi_tick FROM crops WHERE codec_id = 'signup'),
s AS (SELECT *, source_id % 10 = 0 AS test, codec_id = 'error' AS held FROM crops WHERE codec_id <> 'signup')
SELECT spec_id, CASE WHEN test OR held THEN 'non_training_recording' ELSE 'protected_overlap' END AS reason FROM s
WHERE test OR held OR EXISTS (SELECT 1 FROM p WHERE p.source_id = s.source_id AND s.lo_tick < p.hi_tick AND p.lo_tick < s.hi_tick)"""))
def v13(spark, sf):
    specs, protected = schedule(spark, sf)
    flagged = intervals.overlapping(specs, protected, "source_id", "spec_id")
    impure = (F.col("split") != "train") | F.col("held_out")
    return flagged.select(
        "spec_id", rules.first_reason([("non_training_recording", impure), ("protected_overlap", F.col("overlaps"))]).alias("reason")
    ).filter(F.col("reason").isNotNull())


@query("v14_fixed_selection", with_ctes("manifest", body="""
WITH r AS (SELECT row_id FROM manifest WHERE split = 'validation' UNION ALL SELECT row_id FROM manifest WHERE row_id % 300 = 0),
w AS (SELECT row_id, count(*) AS asked FROM r GROUP BY 1),
p AS (SELECT row_id, count(*) AS found, min(track_id) AS track_id, min(recipe_hash) AS recipe_hash FROM manifest WHERE split = 'validation' GROUP BY 1),
j AS (SELECT * FROM w LEFT JOIN p USING (row_id))
SELECT 'requested_twice' AS "check", count(*) FILTER (asked > 1) AS failures FROM j
UNION ALL SELECT 'not_present_once', count(*) FILTER (coalesce(found, 0) <> 1) FROM j
UNION ALL SELECT 'extra_recipes', count(DISTINCT recipe_hash) - 1 FROM j
UNION ALL SELECT 'training_tracks', count(DISTINCT track_id) FROM j WHERE track_id IN (SELECT track_id FROM manifest WHERE split = 'train')"""))
def v14(spark, sf):
    m = load(spark, sf, "manifest")
    requested = m.filter(F.col("split") == "validation").select("row_id").unionByName(
        m.filter(F.col("row_id") % 300 == 0).select("row_id")
    )
    return rules.fixed_selection(requested, m)


@query("v16_matched_config", """
WITH a AS (SELECT c_name AS key, c_mktsegment AS value FROM customer),
b AS (SELECT c_name AS key, CASE WHEN c_custkey % 100 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 250 <> 1)
SELECT key, a.value AS a, b.value AS b FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value AND key NOT IN ('Customer#000000001')""")
def v16(spark, sf):
    c = load(spark, sf, "customer")
    a = c.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    b = c.filter(F.col("c_custkey") % 250 != 1).select(
        F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 100 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("value")
    )
    return rules.matched_config(a, b, ["Customer#000000001"])


@query("v17_validate_schedule", with_ctes("crops", body="""
WITH s AS (SELECT spec_id // 5 AS draw_id, spec_id % 5 AS slot, row_id, start_sample AS start, source_id AS track_id,
  CASE WHEN codec_id = 'error' OR spec_id % 5 = 4 THEN 'speech' ELSE 'music' END AS corpus FROM crops),
g AS (SELECT draw_id, count(*) AS n, count(DISTINCT (row_id, start)) AS specs, count(DISTINCT track_id) AS tracks,
  count(*) FILTER (corpus <> CASE WHEN slot = 4 THEN 'speech' ELSE 'music' END) AS misplaced FROM s GROUP BY 1),
v AS (SELECT draw_id, array_to_string(list_filter([CASE WHEN n <> 5 THEN 'slots' END, CASE WHEN specs <> n THEN 'repeated_spec' END,
  CASE WHEN misplaced > 0 THEN 'corpus_pattern' END, CASE WHEN tracks <> n THEN 'repeated_recording' END], lambda z: z IS NOT NULL), ',') AS violations FROM g)
SELECT * FROM v WHERE violations <> ''"""))
def v17(spark, sf):
    c = load(spark, sf, "crops").select(
        F.floor(F.col("spec_id") / 5).alias("draw_id"), (F.col("spec_id") % 5).alias("slot"), "row_id",
        F.col("start_sample").alias("start"), F.col("source_id").alias("track_id"),
        F.when((F.col("codec_id") == "error") | (F.col("spec_id") % 5 == 4), "speech").otherwise("music").alias("corpus"),
    )
    out = rules.validate_schedule(c, 5, ["music"] * 4 + ["speech"])
    return out.select("draw_id", F.array_join("violations", ",").alias("violations"))


@query("p01_identity_controls", with_ctes("metric_rows", body="""
WITH base AS (SELECT row_id, codec_id, cents AS clean, cents + pct AS degraded FROM metric_rows),
b AS (SELECT CAST(row_id AS VARCHAR) AS row_id, codec_id, clean, degraded FROM base
  UNION ALL SELECT row_id || ':identity', 'identity', clean, clean FROM base)
SELECT *, CASE WHEN clean % 16 = 0 AND codec_id <> 'identity' THEN row_id || ':identity' ELSE row_id END AS scheduled FROM b"""))
def p01(spark, sf):
    m = load(spark, sf, "metric_rows").select("row_id", "codec_id", F.col("cents").alias("clean"), (F.col("cents") + F.col("pct")).alias("degraded"))
    both = rules.identity_controls(m)
    swapped = rules.swap_identity_slots(both.withColumn("plain", F.col("row_id")), "clean", 8)
    scheduled = F.when(F.col("codec_id") != "identity", F.col("row_id")).otherwise(F.col("plain"))
    return swapped.select(F.col("plain").alias("row_id"), "codec_id", "clean", "degraded", scheduled.alias("scheduled"))


@query("p02_genre_normalise", with_ctes("catalog", body="""
SELECT CASE lower(trim(genre)) WHEN 'hip hop' THEN 'hiphop' WHEN 'r&b' THEN 'rnb' ELSE lower(trim(genre)) END AS genre,
  count(*) AS n, count(DISTINCT author) AS authors FROM catalog GROUP BY 1"""))
def p02(spark, sf):
    c = load(spark, sf, "catalog").withColumn("genre", rules.genre_normalise(F.col("genre")))
    return c.groupBy("genre").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("authors"))


@query("p03_source_origin", with_ctes("manifest", body="""
SELECT row_id, start_sample + greatest(0, -alignment_offset_samples) AS origin FROM manifest"""))
def p03(spark, sf):
    return load(spark, sf, "manifest").select(
        "row_id", rules.source_origin(F.col("start_sample"), F.col("alignment_offset_samples")).alias("origin")
    )


@query("p04_quality_label", with_ctes("metric_rows", body="""
SELECT codec_id || ':' || CASE WHEN (pct / 4e0) = floor(pct / 4e0) THEN CAST(CAST(pct / 4e0 AS BIGINT) AS VARCHAR) ELSE CAST(pct / 4e0 AS VARCHAR) END AS label,
  count(*) AS n FROM metric_rows GROUP BY 1"""))
def p04(spark, sf):
    m = load(spark, sf, "metric_rows")
    return m.groupBy(rules.quality_label(F.col("codec_id"), F.col("pct") / F.lit(4.0)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("p05_attach_metric_strata", with_ctes("metric_rows", body="""
SELECT row_id, corpus, codec_id, 'cents' AS metric, CAST(cents AS DOUBLE) AS value FROM metric_rows
UNION ALL SELECT row_id, corpus, codec_id, 'pct', CAST(pct AS DOUBLE) FROM metric_rows"""))
def p05(spark, sf):
    return rules.attach_metric_strata(load(spark, sf, "metric_rows"), ["row_id", "corpus", "codec_id"], ["cents", "pct"])
