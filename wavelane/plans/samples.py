"""Split, sampling and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelane.functions import hashing
from wavelane.functions.numeric import fix
from wavelane.functions.ordinals import block
from wavelane.operators import intervals, sampling
from wavelane.plans.adapters import load
from wavelane.plans.registry import fx, hu, hx, query, with_ctes
from wavelane.session import cut_lineage


@query("x01_assign_split", with_ctes("catalog", body=f"""
WITH u AS (SELECT id, work, {hu("'42:' || work")} AS p FROM catalog)
SELECT id, CASE WHEN p < {0.8 / 1.0} THEN 'train' WHEN p < {0.8 + 0.1} THEN 'validation' ELSE 'test' END AS split FROM u"""))
def x01(spark, sf):
    return load(spark, sf, "catalog").select("id", sampling.assign_split(F.col("work"), 42, {"train": 0.8, "validation": 0.1, "test": 0.1}).alias("split"))


@query("x02_is_inner_validation", with_ctes("metric_rows", body=f"""
SELECT track_id, {hx("sha256('gain-inner-v1:' || track_id)", 8)} % 5 = 0 AS inner_validation, count(*) AS n FROM metric_rows GROUP BY 1"""))
def x02(spark, sf):
    m = load(spark, sf, "metric_rows")
    return m.groupBy("track_id", sampling.is_inner_validation(F.col("track_id")).alias("inner_validation")).agg(F.count(F.lit(1)).alias("n"))


@query("x03_stratified_cap", with_ctes("metric_rows", body="""
WITH h AS (SELECT *, sha256('5:' || row_id) AS h FROM metric_rows), m AS (SELECT *, h = min(h) OVER (PARTITION BY codec_id, sample_rate, channel_role) AS mandatory FROM h),
r AS (SELECT *, row_number() OVER (ORDER BY mandatory DESC, h) AS k FROM m)
SELECT row_id, codec_id, sample_rate, channel_role, mandatory FROM r WHERE k <= 500"""))
def x03(spark, sf):
    m = load(spark, sf, "metric_rows").select("row_id", "codec_id", "sample_rate", "channel_role")
    return sampling.stratified_cap(m, ["codec_id", "sample_rate", "channel_role"], "row_id", 500, 5)


@query("x04_weighted_mix", with_ctes("manifest", body=f"""
WITH s AS (SELECT corpus, sum(sampling_weight) AS s FROM manifest WHERE corpus IN ('ASIA', 'EUROPE') GROUP BY 1)
SELECT row_id, {fx("CASE corpus WHEN 'ASIA' THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END * sampling_weight / s", 12)} AS probability FROM manifest JOIN s USING (corpus)"""))
def x04(spark, sf):
    out = sampling.weighted_mix(load(spark, sf, "manifest"), "corpus", "sampling_weight", {"ASIA": 3.0, "EUROPE": 1.0, "AFRICA": 0.0})
    return out.select("row_id", fix(F.col("probability"), 12).alias("probability"))


RANKED = "SELECT row_id, corpus, row_number() OVER (PARTITION BY corpus ORDER BY sha256('{seed}:' || corpus || ':' || row_id)) AS k, count(*) OVER (PARTITION BY corpus) AS n FROM manifest"


@query("x05_proportional_rebalance", with_ctes("manifest", body=f"""
WITH r AS ({RANKED.format(seed=9)})
SELECT row_id, corpus FROM r WHERE k <= greatest(least(n, CASE corpus WHEN 'ASIA' THEN 1500 WHEN 'EUROPE' THEN 450 WHEN 'AFRICA' THEN 1050 END), 1) AND corpus IN ('ASIA', 'EUROPE', 'AFRICA')"""))
def x05(spark, sf):
    out = sampling.proportional_rebalance(load(spark, sf, "manifest"), "corpus", "row_id", 3000, {"ASIA": 0.5, "EUROPE": 0.15, "AFRICA": 0.35}, 9)
    return out.select("row_id", "corpus")


@query("x06_validation_quota", with_ctes("manifest", body=f"""
WITH r AS ({RANKED.format(seed=1000)}) SELECT row_id, corpus FROM r WHERE k <= CASE corpus WHEN 'ASIA' THEN 400 WHEN 'AMERICA' THEN 100 END"""))
def x06(spark, sf):
    return sampling.validation_quota(load(spark, sf, "manifest"), "corpus", "row_id", {"ASIA": 400, "AMERICA": 100}, 1000).select("row_id", "corpus")


@query("x07_weighted_draws", with_ctes("manifest", body=f"""
WITH d AS (SELECT range AS draw, {hu("'3:corpus:' || range")} AS uc, {hu("'3:row:' || range")} AS u FROM range(5000)),
c AS (SELECT *, CASE WHEN uc < 0.8::DOUBLE THEN 'ASIA' ELSE 'EUROPE' END AS corpus FROM d),
w AS (SELECT corpus, row_id, length_samples, sum(sampling_weight) OVER (PARTITION BY corpus ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS hi, sampling_weight AS w,
  sum(sampling_weight) OVER (PARTITION BY corpus) AS total FROM manifest),
t AS (SELECT corpus, any_value(total) AS total FROM w GROUP BY 1), p AS (SELECT c.*, u * total AS at FROM c JOIN t USING (corpus))
SELECT p.draw, p.corpus, w.row_id, CAST(floor({hu("'3:start:' || p.draw")} * greatest(1, length_samples - 32768 + 1)) AS BIGINT) AS start,
 {fx("-6.0::DOUBLE + " + hu("'3:gain:' || p.draw") + " * 9.0::DOUBLE")} AS gain_db FROM p ASOF JOIN w ON p.corpus = w.corpus AND p.at < w.hi"""))
def x07(spark, sf):
    out = sampling.weighted_draws(load(spark, sf, "manifest"), "corpus", "row_id", "sampling_weight", "length_samples", {"ASIA": 0.8, "EUROPE": 0.2}, 5000, 3, 32768, block("row_id"))
    return out.withColumn("gain_db", fix(F.col("gain_db")))


def legal(spark, sf, crop):
    """Eligible manifest rows with their legal start spans outside protected crops."""
    m = load(spark, sf, "manifest").filter((F.col("split") == "train") & ~F.col("held_out") & (F.col("start_sample") >= 0) & F.col("sample_rate").isin(44100, 48000))
    rows = m.select(
        "row_id", F.split("source_checksum", "-")[1].cast("bigint").alias("source_id"), F.col("start_sample").alias("origin"), "length_samples", "sample_rate",
        "corpus", "track_id", "sampling_weight",
    )
    protected = load(spark, sf, "crops").filter(F.col("codec_id") == "signup")
    return intervals.legal_starts(rows, protected, "source_id", crop)


def spans_of(rows):
    """The legal spans of rows one by one."""
    return rows.select("row_id", F.explode("legal").alias("s")).select("row_id", "s.lo", "s.hi")


@query("x08_balanced_schedule")
def x08(spark, sf):
    rows = cut_lineage(legal(spark, sf, 32768))  # made once for rows and spans
    return sampling.balanced_schedule(rows, spans_of(rows), {"ASIA": 4, "EUROPE": 1}, 500, 20261014)


@query("x09_deterministic_segments", with_ctes("manifest", body=f"""
WITH s AS (SELECT row_id, track_id, sample_rate, length_samples, CAST(range AS INT) AS segment, least(length_samples, greatest(1, CAST(floor((0.25::DOUBLE + {hu("'7:length:' || track_id || ':' || row_id || ':' || range")} * 0.5::DOUBLE) * sample_rate + 0.5::DOUBLE) AS BIGINT))) AS segment_length
 FROM manifest, range(2))
SELECT row_id, segment, segment_length, CAST(floor({hu("'7:start:' || track_id || ':' || row_id || ':' || segment")} * (length_samples - segment_length + 1)) AS BIGINT) AS segment_start FROM s"""))
def x09(spark, sf):
    out = sampling.deterministic_segments(load(spark, sf, "manifest"), ["track_id", "row_id"], "length_samples", "sample_rate", 2, (0.25, 0.75), 7)
    return out.select("row_id", "segment", "segment_length", "segment_start")


@query("x10_set_hash", with_ctes("catalog", body="""
WITH l AS (SELECT DISTINCT region, sha256(pcm) AS h FROM catalog), b AS (SELECT region, substr(h, 1, 3) AS b, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS d FROM l GROUP BY 1, 2)
SELECT region, CAST(sum(n) AS BIGINT) AS members, sha256(string_agg(d, ',' ORDER BY b)) AS set_hash FROM b GROUP BY 1"""))
def x10(spark, sf):
    return hashing.set_hash(load(spark, sf, "catalog"), ["region"], F.col("pcm"))


@query("x10_row_digest", with_ctes("manifest", body="""
SELECT row_id, substr(sha256(track_id || ':' || split || ':' || sample_rate || ':' || codec_id || ':' || start_sample), 1, 24) AS digest FROM manifest"""))
def x10_rows(spark, sf):
    return load(spark, sf, "manifest").select("row_id", hashing.row_digest("track_id", "split", "sample_rate", "codec_id", "start_sample").alias("digest"))


@query("x12_epoch_augment", with_ctes("manifest", body=f"""
SELECT row_id, CASE WHEN length_samples > 65536 THEN CAST(floor({hu("'42:3:' || row_id || ':crop'")} * (length_samples - 65536 + 1)) AS BIGINT) ELSE 0 END AS start,
 greatest(0, 65536 - length_samples) AS padding, {fx("-6.0::DOUBLE + " + hu("'42:3:' || row_id || ':gain'") + " * 9.0::DOUBLE")} AS gain_db FROM manifest"""))
def x12(spark, sf):
    return sampling.epoch_augment(load(spark, sf, "manifest"), "row_id", "length_samples", 65536, 42, 3).withColumn("gain_db", fix(F.col("gain_db")))


@query("x13_train_probe_specs", with_ctes("manifest", body="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY corpus, track_id ORDER BY sha256('8:row:' || row_id)) AS rr FROM manifest WHERE split = 'train' AND NOT held_out AND corpus IN ('ASIA', 'EUROPE')),
t AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY sha256('8:track:' || track_id)) AS k FROM r WHERE rr = 1)
SELECT corpus, track_id, row_id, greatest(0, (length_samples - 32768) // 2) AS start FROM t WHERE k <= CASE corpus WHEN 'ASIA' THEN 32 ELSE 8 END"""))
def x13(spark, sf):
    return sampling.train_probe_specs(load(spark, sf, "manifest"), {"ASIA": 32, "EUROPE": 8}, 8, 32768)


@query("x14_blind_trials", with_ctes("catalog", body="""
WITH d AS (SELECT DISTINCT author, genre FROM catalog)
SELECT author, lpad(CAST(row_number() OVER (PARTITION BY author ORDER BY sha256('1:' || author || ':' || genre)) AS VARCHAR), 2, '0') AS opaque, genre FROM d"""))
def x14(spark, sf):
    return sampling.blind_trials(load(spark, sf, "catalog"), "author", "genre", 1)
