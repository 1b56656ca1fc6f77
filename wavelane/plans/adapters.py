"""Adapters that give the driver's tables the shapes of the operators.

``SQL`` holds the comparison form (DuckDB text). Row-level shapes run the same text on Spark;
shapes that number rows inside a group use the block-wise ordinals instead of a group window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelane.functions.ordinals import block, ordinal

SQL: dict[str, str] = {}

SQL["catalog"] = """
SELECT doc_id AS id, source AS author, lang AS region, sha256(text) AS pcm,
       sha256(source || ':' || list_max(string_split(lower(text), ' '))) AS work,
       CASE doc_id % 5 WHEN 0 THEN 'pop' WHEN 1 THEN 'Hip Hop' WHEN 2 THEN 'r&b'
            WHEN 3 THEN ' Rock ' ELSE 'unlabeled' END AS genre,
       CASE WHEN doc_id % 10 = 0 THEN 22050 WHEN doc_id % 2 = 0 THEN 44100 ELSE 48000 END AS sample_rate,
       CAST(n_chars AS DOUBLE) / 10e0 AS duration_seconds, n_chars,
       CASE doc_id % 7 WHEN 0 THEN 'MP3' WHEN 1 THEN 'FLAC' WHEN 2 THEN 'AIFF' ELSE 'WAV' END AS container,
       CASE doc_id % 11 WHEN 0 THEN 'VORBIS' WHEN 1 THEN 'FLOAT' WHEN 2 THEN 'PCM_24' ELSE 'PCM_16' END AS subtype,
       CAST(1 + doc_id % 3 AS INT) AS channels,
       CASE WHEN doc_id % 17 = 0 THEN 'over_full_scale' END AS review_flag
FROM documents
"""

SQL["reviews"] = """
SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'pending' END AS status,
       'music-training' AS scope, toxic AS unresolved_issues,
       CASE WHEN l.doc_id % 13 = 0 THEN 'stale' ELSE sha256(d.text) END AS audio_sha256,
       l.doc_id % 19 <> 0 AS commercial_training, l.doc_id % 23 <> 0 AS weight_distribution,
       CASE WHEN l.doc_id % 29 = 0 THEN ' ' ELSE 'basis ' || d.lang END AS grant_basis,
       CASE WHEN l.doc_id % 31 <> 0 THEN d.source END AS artist_id,
       CASE WHEN l.doc_id % 37 = 0 THEN 'http://example.org/a' ELSE 'https://example.org/' || d.lang END AS evidence_url,
       CASE l.doc_id % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'publisher-repertoire'
            WHEN 2 THEN 'artist-repertoire' ELSE 'recorded-market' END AS region_basis,
       d.lang AS region_name, CASE WHEN l.doc_id % 9 <> 0 THEN 'spoken' END AS region_explanation,
       l.doc_id % 3 = 0 AS vocal_music, d.lang AS vocal_language,
       CASE WHEN l.doc_id % 41 = 0 THEN '' ELSE 'listened' END AS genre_basis
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

# One-letter codes go through their character number: numeric minima keep the aggregate hashed.
SQL["metric_rows"] = """
SELECT l.row_id, o.o_custkey AS track_id, r.r_name AS corpus, l.codec_id, l.quality,
       CASE WHEN l.row_id % 2 = 0 THEN 44100 ELSE 48000 END AS sample_rate,
       CASE l.row_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'mid' ELSE 'side' END AS channel_role,
       l.cents / 1e5 AS baseline, l.cents * (100 + l.tax - l.disc) / 1e7 AS enhanced,
       l.cents * (l.tax - l.disc) / 1e7 AS delta, l.cents, l.tax - l.disc AS pct
FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_orderkey, chr(min(ascii(l_returnflag))) AS codec_id,
             chr(min(ascii(l_linestatus))) AS quality, CAST(round(max(l_extendedprice) * 100, 0) AS BIGINT) AS cents,
             CAST(round(max(l_tax) * 100, 0) AS BIGINT) AS tax,
             CAST(round(max(l_discount) * 100, 0) AS BIGINT) AS disc
      FROM lineitem GROUP BY l_orderkey, l_linenumber) l
JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

# The second arm of paired operators and the four cells of a 2x2 design.
SQL["control_rows"] = """
SELECT row_id, track_id, corpus, codec_id, quality, sample_rate, channel_role, baseline,
       cents * pct * (20 + row_id % 7 - 3) / 2e8 AS delta, cents, pct
FROM metric_rows
"""

SQL["pairs"] = """
SELECT m.*, c.delta AS control FROM metric_rows m JOIN control_rows c USING (row_id)
"""

SQL["manifest"] = """
SELECT m.row_id, corpus || ':' || CASE WHEN m.row_id % 97 = 0 THEN 'x' ELSE '' END || CAST(track_id AS VARCHAR(20)) AS track_id,
       corpus, 2 AS schema_version,
       CASE WHEN m.row_id % 101 = 0 THEN 'other' ELSE 'recipe-1' END AS recipe_hash,
       CASE WHEN m.row_id % 211 = 0 THEN 'holdback' WHEN track_id % 10 = 0 THEN 'validation'
            WHEN track_id % 10 = 1 THEN 'test' ELSE 'train' END AS split,
       'src-' || CAST(track_id % 5000 AS VARCHAR(20)) AS source_checksum,
       CASE WHEN m.row_id % 89 = 0 THEN 22050 ELSE sample_rate END AS sample_rate, channel_role,
       codec_id, CASE codec_id WHEN 'A' THEN 'aac' WHEN 'N' THEN 'mp3' ELSE 'opus' END AS codec,
       CASE WHEN m.row_id % 83 = 0 THEN 'fast' ELSE 'reference' END AS encoder,
       CASE codec_id WHEN 'A' THEN 128e0 WHEN 'N' THEN 192e0 ELSE 96e0 END AS codec_setting,
       codec_id = 'R' AND m.row_id % 3 = 0 AS held_out,
       1e0 + m.row_id % 4 AS sampling_weight,
       (m.row_id * 7919) % 2000000 - CASE WHEN m.row_id % 79 = 0 THEN 2000001 ELSE 0 END AS start_sample,
       40000 + (m.row_id * 31) % 100000 AS length_samples,
       m.row_id % 5 - 2 AS residual_alignment_samples, m.row_id % 9 - 4 AS alignment_offset_samples,
       CASE WHEN m.row_id % 73 = 0 THEN 30000e0 ELSE 8000e0 + m.cents % 12000 END AS measured_cutoff_hz,
       CASE WHEN m.row_id % 71 = 0 THEN '/abs/' ELSE 'clips/' END || CAST(m.row_id AS VARCHAR(20)) AS clean_path
FROM metric_rows m
"""

# The manifest with all required fields, some planted as missing (values replaced, columns added).
MANIFEST_GAPS = {
    "length_samples": "CASE WHEN row_id % 179 <> 0 THEN length_samples END", "codec": "CASE WHEN row_id % 181 <> 0 THEN codec END",
    "alignment_offset_samples": "CASE WHEN row_id % 191 <> 0 THEN alignment_offset_samples END",
}
MANIFEST_MORE = {
    "corpus_version": "CASE WHEN row_id % 131 <> 0 THEN 'v' || CAST(row_id % 3 AS VARCHAR(20)) END", "source_id": "CASE WHEN row_id % 137 <> 0 THEN 'source-' || track_id END",
    "source_path": "CASE WHEN row_id % 139 <> 0 THEN 'music/' || track_id END", "source_channels": "CASE WHEN row_id % 149 <> 0 THEN 1 + row_id % 2 END",
    "codec_mode": "CASE WHEN row_id % 151 <> 0 THEN CASE WHEN codec_id = 'A' THEN 'cbr' ELSE 'vbr' END END", "codec_weight": "CASE WHEN row_id % 157 <> 0 THEN 1e0 END",
    "degraded_path": "CASE WHEN row_id % 163 <> 0 THEN CASE WHEN row_id % 67 = 0 THEN '../' ELSE 'coded/' END || CAST(row_id AS VARCHAR(20)) END",
    "clean_checksum": "CASE WHEN row_id % 167 <> 0 THEN 'c' || CAST(row_id AS VARCHAR(20)) END", "degraded_checksum": "CASE WHEN row_id % 173 <> 0 THEN 'd' || CAST(row_id AS VARCHAR(20)) END",
}
SQL["full_manifest"] = f"""
SELECT * REPLACE ({', '.join(f"{e} AS {n}" for n, e in MANIFEST_GAPS.items())}), {', '.join(f"{e} AS {n}" for n, e in MANIFEST_MORE.items())} FROM manifest
"""

# What a full review has beside the fields of ``reviews``: text bases, credit, kind and genre.
REVIEW_MORE = {
    "composition_basis": "CASE WHEN id % 47 <> 0 THEN 'score' END", "recording_basis": "CASE WHEN id % 53 = 0 THEN '  ' ELSE 'session' END",
    "performers_and_samples_basis": "CASE WHEN id % 59 <> 0 THEN 'named' END", "credit_text": "CASE WHEN id % 61 = 0 THEN '' ELSE 'credit' END", "reviewed_at": "CASE WHEN id % 67 <> 0 THEN '2024-05-06' END",
    "credited_author": "CASE WHEN id % 71 = 0 THEN ' ' WHEN id % 2 = 0 THEN 'someone' END", "content_kind": "CASE WHEN id % 73 = 0 THEN 'speech' WHEN id % 3 = 0 THEN 'music' END",
    "reviewed_genre": "CASE WHEN id % 79 = 0 THEN ' ' WHEN id % 7 = 3 THEN ' Hip Hop ' END",
}
SQL["full_reviews"] = f"""
SELECT *, {', '.join(f"{e} AS {n}" for n, e in REVIEW_MORE.items())} FROM reviews
"""
# Two receipts of most reviews, one of some, none of a few; and the files that were kept.
EVIDENCE = "SELECT id, 'https' || CASE WHEN (id + k) % 43 = 0 THEN '' ELSE '://' END || 'example.org/' AS url, 'receipts/' || CAST(id * 2 + k AS VARCHAR(20)) AS path, 'h' || CAST(id * 2 + k AS VARCHAR(20)) AS sha256 FROM pairs_of WHERE id % 31 <> 5 AND (k = 0 OR id % 3 <> 0)"
SQL["evidence"] = EVIDENCE.replace("pairs_of", "(SELECT id, unnest([0, 1]) AS k FROM reviews)")
RECEIPTS = "SELECT 'receipts/' || CAST(id * 2 + k AS VARCHAR(20)) AS path, CASE WHEN (id * 2 + k) % 37 = 0 THEN 'changed' ELSE 'h' || CAST(id * 2 + k AS VARCHAR(20)) END AS sha256 FROM pairs_of WHERE (id * 2 + k) % 41 <> 0"
SQL["receipts"] = RECEIPTS.replace("pairs_of", "(SELECT id, unnest([0, 1]) AS k FROM reviews)")

SQL["crops"] = """
SELECT event_id AS spec_id, user_id AS source_id, user_id * 2 + event_id % 2 AS row_id,
       CASE WHEN event_id % 2 = 0 THEN 44100 ELSE 48000 END AS sample_rate,
       (event_id * 7919) % 2000000 AS start_sample, 32768 AS length_samples,
       event_type AS codec_id, value,
       (event_id * 7919) % 2000000 * CASE WHEN event_id % 2 = 0 THEN 160 ELSE 147 END AS lo_tick,
       ((event_id * 7919) % 2000000 + 32768) * CASE WHEN event_id % 2 = 0 THEN 160 ELSE 147 END AS hi_tick
FROM events
"""

SQL["signal"] = """
SELECT user_id AS track_id, event_id % 2 AS channel, event_id,
       row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) - 1 AS sample_ix,
       round((value - 50) / 500, 6) AS x, abs(value - 50) < 5 AS silent, value > 200 AS rail
FROM events
"""

SQL["hops"] = """
SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
       event_id, ts AS event_time, CAST(round(value * 60000, 0) AS BIGINT) AS service_ns,
       value / 16 > 8 AS missed, event_type = 'error' AS rejected, event_type
FROM events
"""

SQL["spectra"] = """
SELECT label AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
       vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS samples
FROM embeddings
"""

# Bin-level form of consecutive frames: reference (t*), prediction (p*) and a third signal (o*).
SQL["bins"] = """
SELECT a.track_id, a.frame, unnest(range(64)) AS bin,
       unnest(list_transform(a.samples, lambda v: abs(v))) AS t, unnest(list_transform(a.samples, lambda v: pi() * v)) AS tp,
       unnest(list_transform(coalesce(b.samples, a.samples), lambda v: abs(v))) AS p, unnest(list_transform(coalesce(b.samples, a.samples), lambda v: pi() * v)) AS pp,
       unnest(list_transform(coalesce(c.samples, b.samples, a.samples), lambda v: abs(v))) AS o, unnest(list_transform(coalesce(c.samples, b.samples, a.samples), lambda v: pi() * v)) AS op
FROM spectra a LEFT JOIN spectra b ON a.track_id = b.track_id AND b.frame = a.frame + 1
LEFT JOIN spectra c ON a.track_id = c.track_id AND c.frame = a.frame + 2
"""


def _tables(spark: SparkSession, sf: str, text: str) -> dict[str, DataFrame]:
    names = (
        "region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations"
    ).split()
    return {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names if "{" + n + "}" in text}


#: Rows of a part that one task aggregates at once.
PART_ROWS = 1 << 19


def dealt(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by their key to parts of about ``PART_ROWS`` rows, so a task's hash tables don't grow with the table.

    Keys that hardly repeat are aggregated after the exchange only: tables before it would hold every row.
    """
    parts = df.count() // PART_ROWS + 1
    return df.repartition(parts, key) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def _same_text(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Run a row-level adapter's text on Spark."""
    text = SQL[name]
    text = text.replace("sha256(text)", "sha2(text,256)").replace("sha256(d.text)", "sha2(d.text,256)")
    text = text.replace(
        "sha256(source || ':' || list_max(string_split(lower(text), ' ')))",
        "sha2(source || ':' || array_max(split(lower(text), ' ')), 256)",
    )
    for table in ("lineitem", "orders", "customer", "nation", "region", "documents", "labels", "events"):
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table} ", f"JOIN {{{table}}} ")
    frames = _tables(spark, sf, text)
    if name == "metric_rows":
        frames["lineitem"] = dealt(spark, frames["lineitem"], "l_orderkey")  # the key of the join with orders as well
    if "FROM metric_rows" in text:
        text = text.replace("FROM metric_rows", "FROM {metric_rows}")
        frames["metric_rows"] = load(spark, sf, "metric_rows")
    return spark.sql(text, **frames)


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """An adapter as a DataFrame."""
    if name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        return spark.read.parquet(f"{sf}/{name}.parquet")
    if name == "signal":
        events = load(spark, sf, "events").select(
            F.col("user_id").alias("track_id"),
            (F.col("event_id") % 2).alias("channel"),
            "event_id",
            F.round((F.col("value") - 50) / 500, 6).alias("x"),
            (F.abs(F.col("value") - 50) < 5).alias("silent"),
            (F.col("value") > 200).alias("rail"),
        )
        out = ordinal(events, ["track_id", "channel"], ["event_id"], block("event_id"), "sample_ix")
        return out.withColumn("sample_ix", F.col("sample_ix") - 1)
    if name == "hops":
        events = load(spark, sf, "events").select(
            F.col("user_id").alias("run_id"),
            "event_id",
            F.col("ts").alias("event_time"),
            F.round(F.col("value") * 60000, 0).cast("bigint").alias("service_ns"),
            (F.col("value") / 16 > 8).alias("missed"),
            (F.col("event_type") == "error").alias("rejected"),
            "event_type",
        )
        out = ordinal(events, ["run_id"], ["event_id"], block("event_id"), "seq")
        return out.withColumn("seq", F.col("seq") - 1)
    if name == "spectra":
        frames = load(spark, sf, "embeddings").select(
            F.col("label").alias("track_id"), "vec_id", F.col("embedding").cast("array<double>").alias("samples")
        )
        out = ordinal(frames, ["track_id"], ["vec_id"], block("vec_id"), "frame")
        return out.withColumn("frame", F.col("frame") - 1)
    if name == "triples":
        return consecutive(load(spark, sf, "spectra"))
    if name == "pairs":
        # Both arms are functions of one row: no join.
        return load(spark, sf, "metric_rows").withColumn("control", F.expr("cents * pct * (20 + row_id % 7 - 3) / 2e8"))
    if name == "full_manifest":
        return load(spark, sf, "manifest").withColumns({n: F.expr(e) for n, e in {**MANIFEST_MORE, **MANIFEST_GAPS}.items()})
    if name == "full_reviews":
        return load(spark, sf, "reviews").withColumns({n: F.expr(e) for n, e in REVIEW_MORE.items()})
    if name in ("evidence", "receipts"):
        both = load(spark, sf, "reviews").select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        return spark.sql((EVIDENCE if name == "evidence" else RECEIPTS).replace("pairs_of", "{both}"), both=both)
    return _same_text(spark, sf, name)


def consecutive(spectra: DataFrame) -> DataFrame:
    """Frames t (reference), t+1 (prediction) and t+2 (original input) of a track side by side.

    A track's last frame stands for the ones after it, so every frame and every track is kept. The
    join key (track, frame) is unique, so a long track spreads over all tasks.
    """
    def shifted(k: int, m: str, ph: str) -> DataFrame:
        return spectra.select(
            "track_id",
            (F.col("frame") - k).alias("frame"),
            F.transform("samples", F.abs).alias(m),
            F.transform("samples", lambda v: F.pi() * v).alias(ph),
        )

    return (
        shifted(0, "t", "tp")
        .join(shifted(1, "p", "pp"), ["track_id", "frame"], "left")
        .join(shifted(2, "o", "op"), ["track_id", "frame"], "left")
        .select("track_id", "frame", "t", "tp", F.coalesce("p", "t").alias("p"), F.coalesce("pp", "tp").alias("pp"), F.coalesce("o", "p", "t").alias("o"), F.coalesce("op", "pp", "tp").alias("op"))
    )
