"""Join operators: coverage-strict pairing, units, plans and template matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.hashing import row_digest, text_hash
from wavelane.functions.ordinals import attach_row, ordinal
from wavelane.operators.rules import first_reason


def paired(candidate: DataFrame, control: DataFrame, keys: Sequence[str], invariants: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer pairing with ``pair_error`` (NULL = a valid pair).

    Both sides must hold exactly the same keys; invariant fields must agree (null-safe). Values
    come back as ``<v>_candidate`` and ``<v>_control``. The keys are expected to be unique.
    """
    a = candidate.select(*keys, F.lit(True).alias("_a"), *[F.col(i).alias(f"_a_{i}") for i in invariants], *[F.col(v).alias(f"{v}_candidate") for v in values])
    b = control.select(*keys, F.lit(True).alias("_b"), *[F.col(i).alias(f"_b_{i}") for i in invariants], *[F.col(v).alias(f"{v}_control") for v in values])
    joined = a.join(b, list(keys), "full_outer")
    reasons = [("missing_control", F.col("_b").isNull()), ("missing_candidate", F.col("_a").isNull())]
    reasons += [(f"changed_{i}", ~F.col(f"_a_{i}").eqNullSafe(F.col(f"_b_{i}"))) for i in invariants]
    return joined.withColumn("pair_error", first_reason(reasons)).drop("_a", "_b", *[f"_{s}_{i}" for s in "ab" for i in invariants])


def stereo_units(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units ``unit_id, members, kind``: left/right rows with equal keys form one; others are single.

    With several rows of one role under a key, the largest row id pairs and the rest are single.
    """
    sides = rows.filter(F.col("channel_role").isin("left", "right")).groupBy(*keys).agg(
        F.max(F.when(F.col("channel_role") == "left", F.col("row_id"))).alias("left"),
        F.max(F.when(F.col("channel_role") == "right", F.col("row_id"))).alias("right"),
    ).filter(F.col("left").isNotNull() & F.col("right").isNotNull())
    taken = sides.select(F.explode(F.array("left", "right")).alias("row_id"))
    singles = rows.join(taken, "row_id", "left_anti").select(F.col("row_id").alias("unit_id"), F.lit(1).alias("members"), F.lit("single").alias("kind"))
    return sides.select(F.col("left").alias("unit_id"), F.lit(2).alias("members"), F.lit("stereo").alias("kind")).unionByName(singles)


def join_reviews(entries: DataFrame, reviews: DataFrame, key: str = "id") -> DataFrame:
    """Entries with their review; a second review of one id fails the job."""
    fields = [c for c in reviews.columns if c != key]
    one = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in fields])
    safe = one.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("duplicate review")).cast("boolean")))
    return entries.join(safe.drop("_n"), key, "left")


def unresolved(plan: DataFrame, failed: DataFrame, acquired: DataFrame, key: str = "id") -> DataFrame:
    """Planned ids that failed and were never acquired."""
    return plan.join(failed.select(key), key, "left_semi").join(acquired.select(key), key, "left_anti")


def plan_degradations(tracks: DataFrame, rates: Sequence[int], codecs: Sequence[tuple[str, bool]], segments: int, rejected: DataFrame | None = None) -> DataFrame:
    """Rows to produce: rate x codec x role x segment per track, with deterministic row ids.

    ``codecs`` are (id, held_out); held-out codecs never enter train. Recipe lists are literals,
    so the expansion is a narrow explode. ``rejected`` removes (track, rate, codec) cells.
    """
    codec = F.array(*[F.struct(F.lit(c).alias("codec_id"), F.lit(h).alias("held_out")) for c, h in codecs])
    roles = F.when(F.col("channels") == 1, F.array(F.lit("mono"))).otherwise(F.array(*[F.lit(r) for r in ("left", "right", "mid", "side")]))
    cells = (
        tracks.withColumn("sample_rate", F.explode(F.array(*[F.lit(r) for r in rates])))
        .withColumn("_c", F.explode(codec))
        .filter(~((F.col("split") == "train") & F.col("_c.held_out")))
        .withColumn("codec_id", F.col("_c.codec_id"))
    )
    if rejected is not None:
        cells = cells.join(rejected.select("track_id", "sample_rate", "codec_id"), ["track_id", "sample_rate", "codec_id"], "left_anti")
    out = cells.withColumn("channel_role", F.explode(roles)).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    return out.withColumn("row_id", row_digest("track_id", "split", "sample_rate", "codec_id", "channel_role", "segment")).select(
        "row_id", "track_id", "split", "sample_rate", "codec_id", "channel_role", "segment"
    )


def match_template(tracks: DataFrame, templates: DataFrame, rows: DataFrame, crop: int, bucket: Column) -> DataFrame:
    """Each new track takes template ``rank mod n`` and its hash-least row of the same profile.

    ``templates``: ``template_ix`` dense from 0, ``codec_id, channel_role, start, length_samples``
    (a registered list; its size is counted, not assumed). The start keeps its relative position.
    Tracks without a matching row come back with NULL row_id.
    """
    size = templates.agg(F.count(F.lit(1)).alias("_size"))
    ranked = attach_row(ordinal(tracks.select("track_id"), [], ["track_id"], bucket, "_rank"), size)
    wanted = ranked.withColumn("template_ix", F.pmod(F.col("_rank") - 1, F.col("_size"))).join(
        templates.select("template_ix", "codec_id", "channel_role", F.col("start").alias("_ts"), F.col("length_samples").alias("_tl")), "template_ix"
    )
    fits = rows.filter(F.col("length_samples") >= 2 * crop).select("track_id", "codec_id", "channel_role", "row_id", "length_samples")
    best = (
        wanted.join(fits, ["track_id", "codec_id", "channel_role"], "left")
        .groupBy("track_id", "template_ix", "_ts", "_tl")
        .agg(F.min_by(F.struct("row_id", "length_samples"), text_hash(F.col("row_id").cast("string"))).alias("r"))
    )
    start = F.floor(F.col("_ts") / (F.col("_tl") - crop) * (F.col("r.length_samples") - crop) + 0.5)
    return best.select("track_id", "template_ix", F.col("r.row_id").alias("row_id"), start.alias("start"))


def align_results(inputs: DataFrame, results: DataFrame, run: str = "run_id") -> DataFrame:
    """Hop status: a result counts only at its own presentation, one hop after its input.

    ``results``: ``run, seq, presented_at``. For presentation p the result of hop p-1 must have
    ``presented_at <= p`` (accepted); a later one is stale; none is missing. The first two
    presentations are start-up and never misses.
    """
    r = results.select(run, (F.col("seq") + 1).alias("seq"), "presented_at")
    joined = inputs.select(run, "seq").join(r, [run, "seq"], "left")
    status = (
        F.when(F.col("presented_at") <= F.col("seq"), "accepted").when(F.col("seq") < 2, "startup")
        .when(F.col("presented_at").isNotNull(), "stale").otherwise("missing")
    )
    return joined.select(run, "seq", status.alias("status"))


def bind_hashes(catalog: DataFrame, quality: DataFrame, key: str, digest: str) -> DataFrame:
    """Catalog rows with ``binding``: ok, mismatch or missing quality receipt."""
    q = quality.select(key, F.col(digest).alias("_q"), F.lit(True).alias("_has"))
    status = F.when(F.col("_has").isNull(), "missing").when(F.col(digest).eqNullSafe(F.col("_q")), "ok").otherwise("mismatch")
    return catalog.join(q, key, "left").withColumn("binding", status).drop("_q", "_has")


def factor_cells(cells: DataFrame, keys: Sequence[str], arms: Sequence[str], value: str) -> DataFrame:
    """Recording-equal mean of each arm side by side per key; ``complete`` when every arm is present."""
    means = cells.groupBy(*keys, "track_id", "arm").agg(F.avg(value).alias("_v"))
    wide = means.groupBy(*keys).pivot("arm", list(arms)).agg(F.avg("_v"))
    complete = F.lit(True)
    for a in arms:
        complete = complete & F.col(a).isNotNull()
    return wide.withColumn("complete", complete)


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys seen in more than one split: ``key_value, first_split, last_split``.

    Minimum and maximum combine map-side; no set of splits is gathered.
    """
    g = df.groupBy(F.col(key).cast("string").alias("key_value")).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
    return g.filter(F.col("first_split") != F.col("last_split"))
