"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelane.functions.numeric import fix
from wavelane.functions.ordinals import block
from wavelane.operators import intervals, joins
from wavelane.plans.adapters import load
from wavelane.plans.evaluation import CELLS_SQL, cells, fixed
from wavelane.plans.registry import fx, query, with_ctes


@query("j01_paired", with_ctes("metric_rows", "control_rows", body=f"""
WITH a AS (SELECT * FROM metric_rows WHERE row_id % 500 <> 3), b AS (SELECT row_id, CASE WHEN row_id % 400 = 7 THEN 'Z' ELSE codec_id END AS codec_id, corpus, delta FROM control_rows WHERE row_id % 700 <> 5)
SELECT row_id, CASE WHEN b.corpus IS NULL THEN 'missing_control' WHEN a.corpus IS NULL THEN 'missing_candidate' WHEN a.codec_id <> b.codec_id THEN 'changed_codec_id' END AS pair_error,
 {fx('a.delta')} AS delta_candidate, {fx('b.delta')} AS delta_control FROM a FULL JOIN b USING (row_id)"""))
def j01(spark, sf):
    a = load(spark, sf, "metric_rows").filter(F.col("row_id") % 500 != 3)
    b = load(spark, sf, "control_rows").filter(F.col("row_id") % 700 != 5)
    b = b.withColumn("codec_id", F.when(F.col("row_id") % 400 == 7, "Z").otherwise(F.col("codec_id")))
    return fixed(joins.paired(a, b, ["row_id"], ["codec_id", "corpus"], ["delta"]), ["delta_candidate", "delta_control"])


@query("j02_stereo_units", with_ctes("metric_rows", body="""
WITH s AS (SELECT track_id, codec_id, quality, max(row_id) FILTER (channel_role = 'left') AS l, max(row_id) FILTER (channel_role = 'right') AS r FROM metric_rows GROUP BY 1, 2, 3),
p AS (SELECT * FROM s WHERE l IS NOT NULL AND r IS NOT NULL)
SELECT l AS unit_id, 2 AS members, 'stereo' AS kind FROM p
UNION ALL SELECT row_id, 1, 'single' FROM metric_rows WHERE row_id NOT IN (SELECT l FROM p UNION ALL SELECT r FROM p)"""))
def j02(spark, sf):
    return joins.stereo_units(load(spark, sf, "metric_rows"), ["track_id", "codec_id", "quality"])


@query("j03_join_reviews", with_ctes("catalog", "reviews", body="""
SELECT c.id, c.author, r.status, r.artist_id FROM catalog c LEFT JOIN reviews r USING (id)"""))
def j03(spark, sf):
    return joins.join_reviews(load(spark, sf, "catalog"), load(spark, sf, "reviews")).select("id", "author", "status", "artist_id")


@query("j04_unresolved", """
SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def j04(spark, sf):
    line = load(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "id")
    plan = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return joins.unresolved(plan, line.filter(F.col("l_returnflag") == "R"), line.filter(F.col("l_linestatus") == "F"))


@query("j06_overlap", with_ctes("crops", body="""
WITH p AS (SELECT source_id, lo_tick, hi_tick FROM crops WHERE codec_id = 'signup'), s AS (SELECT * FROM crops WHERE codec_id <> 'signup')
SELECT spec_id, EXISTS (SELECT 1 FROM p WHERE p.source_id = s.source_id AND s.lo_tick < p.hi_tick AND p.lo_tick < s.hi_tick) AS overlaps FROM s"""))
def j06(spark, sf):
    crops = load(spark, sf, "crops")
    specs = crops.filter(F.col("codec_id") != "signup").select("spec_id", "source_id", "lo_tick", "hi_tick")
    protected = crops.filter(F.col("codec_id") == "signup")
    return intervals.overlapping(specs, protected, "source_id", "spec_id").select("spec_id", "overlaps")


@query("j07_plan_degradations", """
WITH t AS (SELECT c_custkey AS track_id, CASE WHEN c_custkey % 10 = 0 THEN 'test' ELSE 'train' END AS split, 1 + c_custkey % 2 AS channels FROM customer),
x AS (SELECT * FROM t, (VALUES (44100), (48000)) r(sample_rate), (VALUES ('mp3', false), ('aac', false), ('opus', true)) c(codec_id, held_out),
 (VALUES ('mono', 1), ('left', 2), ('right', 2), ('mid', 2), ('side', 2)) o(channel_role, ch), range(2) g(segment)
 WHERE NOT (split = 'train' AND held_out) AND ch = channels AND NOT (track_id % 40 = 3 AND sample_rate = 48000 AND codec_id = 'aac'))
SELECT substr(sha256(concat_ws(':', track_id, split, sample_rate, codec_id, channel_role, segment)), 1, 24) AS row_id, track_id, split, sample_rate, codec_id, channel_role, CAST(segment AS INT) AS segment FROM x""")
def j07(spark, sf):
    c = load(spark, sf, "customer")
    tracks = c.select(
        F.col("c_custkey").alias("track_id"), F.when(F.col("c_custkey") % 10 == 0, "test").otherwise("train").alias("split"),
        (1 + F.col("c_custkey") % 2).alias("channels"),
    )
    rejected = c.filter(F.col("c_custkey") % 40 == 3).select(F.col("c_custkey").alias("track_id"), F.lit(48000).alias("sample_rate"), F.lit("aac").alias("codec_id"))
    return joins.plan_degradations(tracks, [44100, 48000], [("mp3", False), ("aac", False), ("opus", True)], 2, rejected)


@query("j08_match_template", with_ctes("manifest", body="""
WITH tr AS (SELECT DISTINCT track_id FROM manifest WHERE split = 'train'), r AS (SELECT track_id, row_number() OVER (ORDER BY track_id) - 1 AS k FROM tr),
te AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS template_ix, codec_id, channel_role, 1000 + row_id % 3000 AS start, length_samples FROM manifest WHERE split = 'validation'),
w AS (SELECT r.track_id, te.* FROM r JOIN te ON te.template_ix = r.k % (SELECT count(*) FROM te)),
f AS (SELECT * FROM manifest WHERE length_samples >= 65536),
b AS (SELECT w.track_id, w.template_ix, w.start AS ts, w.length_samples AS tl, f.row_id, f.length_samples,
  row_number() OVER (PARTITION BY w.track_id ORDER BY sha256(CAST(f.row_id AS VARCHAR))) AS rn FROM w LEFT JOIN f ON f.track_id = w.track_id AND f.codec_id = w.codec_id AND f.channel_role = w.channel_role)
SELECT track_id, template_ix, row_id, CAST(floor(ts::DOUBLE / (tl - 32768) * (length_samples - 32768) + 0.5::DOUBLE) AS BIGINT) AS start FROM b WHERE rn = 1"""))
def j08(spark, sf):
    m = load(spark, sf, "manifest")
    tracks = m.filter(F.col("split") == "train").select("track_id").distinct()
    from wavelane.functions.ordinals import ordinal
    t = ordinal(m.filter(F.col("split") == "validation").select("row_id", "codec_id", "channel_role", "length_samples"), [], ["row_id"], block("row_id"), "k")
    templates = t.select((F.col("k") - 1).alias("template_ix"), "codec_id", "channel_role", (1000 + F.col("row_id") % 3000).alias("start"), "length_samples")
    # Track ids start with their corpus: the first letter keeps the order and splits the work.
    return joins.match_template(tracks, templates, m, 32768, F.ascii(F.substring("track_id", 2, 1)) + 256 * F.ascii("track_id"))


@query("j09_align_results", with_ctes("hops", body="""
WITH r AS (SELECT run_id, seq, seq + CASE WHEN missed THEN 3 ELSE 1 END AS presented_at FROM hops WHERE NOT rejected)
SELECT h.run_id, h.seq, CASE WHEN r.presented_at <= h.seq THEN 'accepted' WHEN h.seq < 2 THEN 'startup' WHEN r.presented_at IS NOT NULL THEN 'stale' ELSE 'missing' END AS status
FROM hops h LEFT JOIN r ON r.run_id = h.run_id AND r.seq = h.seq - 1"""))
def j09(spark, sf):
    hops = load(spark, sf, "hops")
    results = hops.filter(~F.col("rejected")).select("run_id", "seq", (F.col("seq") + F.when(F.col("missed"), 3).otherwise(1)).alias("presented_at"))
    return joins.align_results(hops, results)


@query("j10_bind_hashes", with_ctes("catalog", "reviews", body="""
SELECT c.id, CASE WHEN r.id IS NULL THEN 'missing' WHEN r.audio_sha256 = c.pcm THEN 'ok' ELSE 'mismatch' END AS binding FROM catalog c LEFT JOIN reviews r USING (id)"""))
def j10(spark, sf):
    quality = load(spark, sf, "reviews").select("id", F.col("audio_sha256").alias("pcm"))
    return joins.bind_hashes(load(spark, sf, "catalog"), quality, "id", "pcm").select("id", "binding")


@query("j11_factor_cells", with_ctes("metric_rows", body=f"""
WITH cells AS ({CELLS_SQL}), r AS (SELECT "group", track_id, arm, avg(value) AS v FROM cells GROUP BY 1, 2, 3)
SELECT "group", {', '.join(fx(f"avg(v) FILTER (arm = '{a}')") + ' AS ' + a for a in ('raw_full', 'raw_mid', 'log_full', 'log_mid'))}, true AS complete FROM r GROUP BY 1"""))
def j11(spark, sf):
    arms = ["raw_full", "raw_mid", "log_full", "log_mid"]
    return fixed(joins.factor_cells(cells(spark, sf), ["group"], arms, "value"), arms)


@query("j12_leakage", """
WITH s AS (SELECT sha256(text) AS text_hash, conv_id, CASE WHEN conv_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM conversations)
SELECT text_hash AS key_value, min(split) AS first_split, max(split) AS last_split FROM s GROUP BY 1 HAVING min(split) <> max(split)
UNION ALL SELECT source_checksum, min(split), max(split) FROM (SELECT sha256(text) AS source_checksum, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY 1 HAVING min(split) <> max(split)""")
def j12(spark, sf):
    def split(c):
        return F.when(F.col(c) % 5 == 0, "test").otherwise("train").alias("split")
    conv = load(spark, sf, "conversations").select(F.sha2("text", 256).alias("k"), split("conv_id"))
    docs = load(spark, sf, "documents").select(F.sha2("text", 256).alias("k"), split("doc_id"))
    return joins.leakage(conv, "k").unionByName(joins.leakage(docs, "k"))
