"""Validation rules and small projections. Rules yield a ``violations`` array per row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.numeric import finite
from wavelane.functions.ordinals import null_safe_join

# Fixed values of the data contract.
SPLITS = ("train", "validation", "test")
ROLES = ("mono", "left", "right", "mid", "side")
RATES = (44100, 48000)
LOSSLESS = ("WAV", "WAVEX", "RF64", "FLAC", "AIFF", "W64", "CAF")
PCM_SUBTYPES = ("PCM_U8", "PCM_S8", "PCM_16", "PCM_24", "PCM_32", "FLOAT", "DOUBLE")
GENRE_ALIASES = {
    "hip hop": "hiphop",
    "hip-hop": "hiphop",
    "r&b": "rnb",
    "rhythm and blues": "rnb",
    "classical music": "classical",
}
REGION_BASES = ("publisher-repertoire", "artist-repertoire", "recorded-market")
# Fields that every manifest row must have.
REQUIRED_FIELDS = (
    "row_id", "schema_version", "recipe_hash", "corpus", "corpus_version", "track_id", "split", "source_id", "source_path", "source_checksum", "sample_rate", "source_channels",
    "channel_role", "codec_id", "codec", "encoder", "codec_mode", "codec_setting", "codec_weight", "held_out", "clean_path", "degraded_path", "start_sample", "length_samples",
    "alignment_offset_samples", "residual_alignment_samples", "measured_cutoff_hz", "clean_checksum", "degraded_checksum",
)
# Text fields of an accepted review that must not be blank.
REVIEW_BASES = ("composition_basis", "recording_basis", "performers_and_samples_basis", "grant_basis", "credit_text", "reviewed_at", "artist_id")
LICENCE_HOSTS = ("creativecommons.org", "www.creativecommons.org")
LICENCE_PATHS = ("/licenses/by/3.0", "/licenses/by/4.0", "/publicdomain/zero/1.0")


def violations(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes of all rules whose condition holds; an undecidable (NULL) condition counts as broken."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(code)) for code, cond in rules])
    )


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that holds, in order; NULL when none does."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(code)) for code, cond in rules])


def held(df: DataFrame, column: str = "violations") -> DataFrame:
    """Rows with at least one reason."""
    return df.filter(F.size(column) > 0)


def require_clean(df: DataFrame, column: str = "violations") -> DataFrame:
    """Fail the job on the first row with a reason; pass other rows through unchanged."""
    message = F.concat(F.lit("rule broken: "), F.array_join(column, ","))
    return df.filter(
        F.when(F.size(column) > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    ).drop(column)


def with_duplicates(df: DataFrame, key: str, name: str) -> DataFrame:
    """Flag rows whose key occurs more than once. Counts combine map-side; no window on the key."""
    many = (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key, F.lit(True).alias(name))
    )
    return null_safe_join(df, many, [key], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def validate_manifest(
    df: DataFrame,
    recipe_hash: str,
    corpora: Sequence[str],
    schema_version: int = 2,
    rates: Sequence[int] = RATES,
    tolerance: int = 1,
    required: Sequence[str] = REQUIRED_FIELDS,
) -> DataFrame:
    """Adds ``violations`` to every manifest row (empty array = valid) and ``missing_fields``, the required ones it lacks.

    A required field that is no column is missing in every row. ``require_rows`` refuses an empty manifest.
    """
    lacking = [F.when(F.col(f).isNull() if f in df.columns else F.lit(True), F.lit(f)) for f in required]
    paths = [p for p in ("clean_path", "degraded_path") if p in df.columns]
    unsafe = reduce(lambda a, b: a | b, [F.col(p).startswith("/") | F.array_contains(F.split(p, "/"), "..") for p in paths])
    rate = F.col("sample_rate")
    cutoff = F.col("measured_cutoff_hz")
    rules = [
        ("missing_field", F.size("missing_fields") > 0),
        ("duplicate_row_id", F.col("_dup")),
        ("invalid_split", ~F.col("split").isin(*SPLITS)),
        ("schema_version", F.col("schema_version") != schema_version),
        ("recipe_hash", F.col("recipe_hash") != recipe_hash),
        ("corpus_track_mismatch", ~F.col("corpus").isin(*corpora) | ~F.col("track_id").startswith(F.concat(F.col("corpus"), F.lit(":")))),
        ("sample_rate", ~rate.isin(*rates)),
        ("sample_interval", (F.col("length_samples") <= 0) | (F.col("start_sample") < 0)),
        ("held_out_in_train", (F.col("split") == "train") & F.col("held_out")),
        ("channel_role", ~F.col("channel_role").isin(*ROLES)),
        ("residual_alignment", F.abs("residual_alignment_samples") > tolerance),
        ("cutoff", ~finite(cutoff) | (cutoff < 0) | (cutoff > rate / 2)),
        ("unsafe_path", unsafe),
    ]
    told = df.withColumn("missing_fields", F.array_compact(F.array(*lacking)).cast("array<string>"))
    return with_duplicates(told, "row_id", "_dup").withColumn("violations", violations(rules)).drop("_dup")


def require_rows(df: DataFrame) -> DataFrame:
    """The rows; a table without any is refused at once."""
    if df.isEmpty():
        raise ValueError("manifest must contain at least one row")
    return df


def check_codec_metadata(df: DataFrame, recipe: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Compare the codec fields of each row with its recipe entry (null-safe).

    ``recipe`` is the recipe's codec list (a handful of rows by contract). Adds ``codec_status``:
    ok, absent or differs.
    """
    wanted = F.broadcast(recipe.select("codec_id", *[F.col(f).alias(f"_w_{f}") for f in fields], F.lit(True).alias("_known")))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_w_{f}"))
    status = F.when(F.col("_known").isNull(), "absent").when(same, "ok").otherwise("differs")
    return df.join(wanted, "codec_id", "left").withColumn("codec_status", status).drop("_known", *[f"_w_{f}" for f in fields])


def receipt_errors(evidence: DataFrame, receipts: DataFrame, key: str = "id") -> DataFrame:
    """``key, receipt_errors``: what is wrong with the receipts (``url, path, sha256``) of each review.

    ``receipts`` lists the retained files (``path, sha256``). A link must be https, and its file must
    be there with the digest that the review bound.
    """
    found = evidence.join(receipts.select("path", F.col("sha256").alias("_kept")), "path", "left")
    wrong = first_reason([
        ("missing_primary_evidence_url", F.parse_url("url", F.lit("PROTOCOL")) != "https"),
        ("missing_or_changed_primary_evidence", F.col("_kept") != F.col("sha256")),
    ])
    return found.groupBy(key).agg(F.collect_set(wrong).alias("receipt_errors"))


def review_errors(catalog: DataFrame, scope: str, bases: Sequence[str] = REVIEW_BASES, receipts: str | None = None, credited: str | None = None) -> DataFrame:
    """All reasons a review cannot be accepted, sorted and distinct, in ``errors``.

    A missing, pending or foreign-scope review has that single reason. ``bases`` are the text
    fields that must not be blank. ``receipts`` names the column with the errors of the review's
    receipts (``receipt_errors``), NULL where it has none; without it, one ``evidence_url`` is
    checked. ``credited`` names a column that may be NULL, but not blank.
    """
    pending = ~F.coalesce((F.col("status") == "accepted") & (F.col("scope") == scope), F.lit(False))
    rules = [
        ("source_review_audio_binding_mismatch", F.col("audio_sha256") != F.col("pcm")),
        ("unresolved_commercial_training", ~F.col("commercial_training")),
        ("unresolved_apache_weight_distribution", ~F.col("weight_distribution")),
        ("unresolved_source_rights", F.col("unresolved_issues") != 0),
        *[(f"missing_{b}", F.trim(F.coalesce(F.col(b), F.lit(""))) == "") for b in bases],
    ]
    if receipts is None:
        rules.append(("missing_primary_evidence_url", F.parse_url("evidence_url", F.lit("PROTOCOL")) != "https"))
    if credited is not None:
        rules.append(("invalid_credited_author", F.coalesce(F.trim(credited) == "", F.lit(False))))
    found = violations(rules)
    if receipts is not None:
        found = F.concat(found, F.coalesce(F.col(receipts), F.array(F.lit("missing_primary_evidence"))))
    errors = F.when(pending, F.array(F.lit("source_review_pending_or_incompatible"))).otherwise(F.array_sort(F.array_distinct(found)))
    return catalog.withColumn("errors", errors)


def region_information(df: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Adds ``music_region`` (``unknown`` unless fully evidenced) and ``region_errors``."""
    absent = F.col("region_name").isNull()
    wrong_basis = ~F.coalesce(F.col("region_basis").isin(*REGION_BASES), F.lit(False))
    details = violations(
        [
            ("missing_primary_evidence_url", F.parse_url("evidence_url", F.lit("PROTOCOL")) != "https"),
            ("missing_regional_explanation", F.coalesce(F.col("region_explanation"), F.lit("")) == ""),
            ("unverified_region_name", ~F.col("region_name").isin(*regions)),
        ]
    )
    empty = F.array().cast("array<string>")
    errors = F.when(absent, empty).when(wrong_basis, F.array(F.lit("unverified_regional_basis"))).otherwise(details)
    accepted = ~absent & (F.size(errors) == 0)
    return df.withColumn("region_errors", errors).withColumn(
        "music_region", F.when(accepted, F.col("region_name")).otherwise(F.lit("unknown"))
    )


def finite_guard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: how many values are NaN or infinite (NULL is allowed)."""
    counts = df.agg(
        *[F.count(F.when(F.col(c).isNotNull() & ~finite(F.col(c).cast("double")), 1)).alias(c) for c in columns]
    )
    return counts.unpivot([], list(columns), "metric", "nonfinite").select("metric", "nonfinite")


def candidate_reason(df: DataFrame, min_rate: int = 44100, min_seconds: float = 35.0) -> DataFrame:
    """First exclusion reason per candidate in ``reason`` (NULL = candidate)."""
    return df.withColumn(
        "reason",
        first_reason(
            [
                ("historical_source_or_work_alias", F.col("exposed")),
                ("unresolved_source_quality", F.col("review_flag").isNotNull()),
                ("insufficient_rate_or_duration", (F.col("sample_rate") < min_rate) | (F.col("duration_seconds") < min_seconds)),
                ("unsupported_channels", ~F.col("channels").isin(1, 2)),
                ("original_checksum_not_verified", ~F.col("checksum_verified")),
                ("missing_publisher_evidence", F.col("evidence_path").isNull()),
            ]
        ),
    )


def validate_pairs(df: DataFrame, clean: str, degraded: str, max_peak: float = 8.0, min_rms: float = 1e-6) -> DataFrame:
    """Array pairs: adds ``clean_rms``, ``degraded_rms`` and ``reason`` (NULL = valid)."""
    a, b = F.col(clean), F.col(degraded)

    def rms(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / F.size(v))

    def bad(v):
        return F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))

    peak = F.greatest(F.array_max(F.transform(a, F.abs)), F.array_max(F.transform(b, F.abs)))
    out = df.withColumn("clean_rms", rms(a)).withColumn("degraded_rms", rms(b))
    return out.withColumn(
        "reason",
        first_reason(
            [
                ("shape", F.size(a) != F.size(b)),
                ("empty", F.size(a) == 0),
                ("nonfinite", bad(a) | bad(b)),
                ("peak", peak > max_peak),
                ("silent", F.least("clean_rms", "degraded_rms") < min_rms),
            ]
        ),
    )


def license_key(url: Column) -> Column:
    """Whitelisted licence path of a URL, NULL when host or path need separate review."""
    path = F.rtrim(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.when(F.parse_url(url, F.lit("HOST")).isin(*LICENCE_HOSTS) & path.isin(*LICENCE_PATHS), path)


def publisher_evidence(df: DataFrame, url: str, published_urls: str, files: str, name: str, md5: str) -> DataFrame:
    """Adds ``licence`` and ``evidence_reason`` (NULL = bound to the original publisher file)."""
    key = license_key(F.col(url))
    file = F.filter(F.col(files), lambda f: f["name"] == F.col(name))[0]
    reason = first_reason(
        [
            ("license_not_preapproved", key.isNull()),
            ("license_differs_from_publisher", ~F.exists(published_urls, lambda u: F.coalesce(license_key(u) == key, F.lit(False)))),
            ("no_original_file", ~F.coalesce(file["source"] == "original", F.lit(False))),
            ("original_checksum_differs", ~file["md5"].eqNullSafe(F.col(md5))),
        ]
    )
    return df.withColumn("licence", key).withColumn("evidence_reason", reason)


def receipt_drift(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """Artifacts whose registered and present digest differ; a missing side is NULL."""
    e = expected.select(key, F.col(digest).alias("expected"))
    a = actual.select(key, F.col(digest).alias("actual"))
    return e.join(a, key, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def fixed_selection(requested: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per check of a requested validation set: ``check, failures``.

    Requested ids must be unique, present exactly once, free of training tracks, and of one recipe.
    """
    wanted = requested.groupBy("row_id").agg(F.count(F.lit(1)).alias("asked"))
    present = rows.filter(F.col("split") == "validation").groupBy("row_id").agg(
        F.count(F.lit(1)).alias("found"), F.min("track_id").alias("track_id"), F.min("recipe_hash").alias("recipe_hash")
    )
    joined = wanted.join(present, "row_id", "left")
    counts = joined.agg(
        F.count(F.when(F.col("asked") > 1, 1)).alias("requested_twice"),
        F.count(F.when(F.coalesce("found", F.lit(0)) != 1, 1)).alias("not_present_once"),
        (F.countDistinct("recipe_hash") - 1).alias("extra_recipes"),
    ).unpivot([], ["requested_twice", "not_present_once", "extra_recipes"], "check", "failures")
    train = rows.filter(F.col("split") == "train").select("track_id").distinct()
    leaked = joined.select("track_id").distinct().join(train, "track_id", "left_semi")
    return counts.unionByName(leaked.agg(F.lit("training_tracks").alias("check"), F.count(F.lit(1)).alias("failures")))


def matched_config(a: DataFrame, b: DataFrame, ignore: Sequence[str]) -> DataFrame:
    """Keys whose values differ between two arms, outside the ignored keys. Columns key,a,b."""
    left = a.select("key", F.col("value").alias("a"))
    right = b.select("key", F.col("value").alias("b"))
    out = left.join(right, "key", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return out.filter(~F.col("key").isin(*ignore)) if ignore else out


def validate_schedule(specs: DataFrame, slots: int, pattern: Sequence[str]) -> DataFrame:
    """Draws that break the contract: ``draw_id, violations``.

    Each draw needs ``slots`` distinct specs, the corpus pattern by slot, and distinct recordings.
    """
    expected = F.element_at(F.array(*[F.lit(p) for p in pattern]), (F.col("slot") + 1).cast("int"))
    per = specs.groupBy("draw_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("row_id", "start").alias("specs"),
        F.countDistinct("track_id").alias("tracks"),
        F.count(F.when(~F.col("corpus").eqNullSafe(expected), 1)).alias("misplaced"),
    )
    return per.select(
        "draw_id",
        violations(
            [
                ("slots", F.col("n") != slots),
                ("repeated_spec", F.col("specs") != F.col("n")),
                ("corpus_pattern", F.col("misplaced") > 0),
                ("repeated_recording", F.col("tracks") != F.col("n")),
            ]
        ).alias("violations"),
    ).filter(F.size("violations") > 0)


def identity_controls(df: DataFrame, suffix: str = ":identity") -> DataFrame:
    """Every row plus a twin whose degraded side is its clean side."""
    twin = (
        df.withColumn("row_id", F.concat(F.col("row_id").cast("string"), F.lit(suffix)))
        .withColumn("degraded", F.col("clean"))
        .withColumn("codec_id", F.lit("identity"))
    )
    return df.withColumn("row_id", F.col("row_id").cast("string")).unionByName(twin)


def swap_identity_slots(schedule: DataFrame, position: str, batch: int, suffix: str = ":identity") -> DataFrame:
    """Every 2*batch-th slot refers to the identity twin instead."""
    return schedule.withColumn(
        "row_id",
        F.when(F.col(position) % (2 * batch) == 0, F.concat(F.col("row_id").cast("string"), F.lit(suffix))).otherwise(
            F.col("row_id").cast("string")
        ),
    )


def genre_normalise(genre: Column) -> Column:
    """Trimmed lower-case label with aliases; NULL becomes ``unlabeled``."""
    label = F.lower(F.trim(F.coalesce(genre, F.lit("unlabeled"))))
    out = label
    for alias, target in GENRE_ALIASES.items():
        out = F.when(label == alias, F.lit(target)).otherwise(out)
    return out


def source_origin(start: Column, offset: Column) -> Column:
    """Start in source coordinates after alignment trimmed leading samples."""
    return start + F.greatest(F.lit(0), -F.coalesce(offset, F.lit(0)))


def quality_label(mode: Column, setting: Column) -> Column:
    """``mode:setting`` with whole settings written without a fraction (%g style)."""
    text = F.when(setting == F.floor(setting), setting.cast("bigint").cast("string")).otherwise(setting.cast("string"))
    return F.concat(mode, F.lit(":"), text)


def attach_metric_strata(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form ``(ids..., metric, value)`` of wide metric rows."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(ids), list(metrics), "metric", "value"
    )


def lossless_reason(df: DataFrame) -> DataFrame:
    """Rejection reason of a container/subtype/channel layout; NULL = accepted."""
    return df.withColumn(
        "reason",
        first_reason(
            [
                ("container", ~F.col("container").isin(*LOSSLESS)),
                ("subtype", ~F.col("subtype").isin(*PCM_SUBTYPES)),
                ("channels", ~F.col("channels").isin(1, 2)),
                ("empty", F.col("frames") <= 0),
            ]
        ),
    )
