"""Extension-point queries: user scorers, degradations, mergeable aggregates, table functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavelane.functions import checks
from wavelane.functions.numeric import fix
from wavelane.operators import extend
from wavelane.plans.adapters import load
from wavelane.plans.evaluation import fixed
from wavelane.plans.registry import fx, query, with_ctes


def mean_absolute(pdf: pd.DataFrame) -> pd.DataFrame:
    """An example scorer: mean absolute difference of each pair of frames."""
    score = [float(np.mean(np.abs(np.asarray(p) - np.asarray(t)))) for p, t in zip(pdf["p"], pdf["t"])]
    return pd.DataFrame({"track_id": pdf["track_id"], "frame": pdf["frame"], "score": score})


@query("y01_score_frames", with_ctes("bins", body=f"SELECT track_id, frame, {fx('avg(abs(p - t))')} AS score FROM bins GROUP BY 1, 2"))
def y01(spark, sf):
    pairs = load(spark, sf, "triples").select("track_id", "frame", "p", "t")
    return fixed(extend.score_frames(pairs, ["track_id"], mean_absolute, "track_id int, frame bigint, score double"), ["score"])


@query("y02_degrade", with_ctes("spectra", body=f"""
WITH s AS (SELECT track_id, frame, unnest(range(64)) AS j, unnest(samples) AS x FROM spectra) SELECT track_id, frame, {fx('sum(CASE WHEN j % 2 = 0 THEN x * 0.5 ELSE 0 END)')} AS total FROM s GROUP BY 1, 2"""))
def y02(spark, sf):
    def decimate(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = [[float(v) * 0.5 if i % 2 == 0 else 0.0 for i, v in enumerate(x)] for x in pdf["samples"]]
        return pdf.assign(samples=kept)
    s = load(spark, sf, "spectra").select("track_id", "frame", "samples")
    out = extend.degrade(s, decimate, "track_id int, frame bigint, samples array<double>")
    return out.select("track_id", "frame", fix(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("y03_mergeable_aggregates", with_ctes("signal", body=f"""
WITH f AS (SELECT *, x < 0 AS f, sample_ix - row_number() OVER (PARTITION BY track_id, channel, x < 0 ORDER BY sample_ix) AS isl FROM signal),
r AS (SELECT track_id, channel, max(n) AS longest FROM (SELECT track_id, channel, isl, count(*) AS n FROM f WHERE f GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT track_id, channel, count(x) AS count, {fx('avg(x)')} AS mean, {fx('var_pop(x)', 8)} AS variance, coalesce(any_value(longest), 0) AS longest FROM signal LEFT JOIN r USING (track_id, channel) GROUP BY 1, 2"""))
def y03(spark, sf):
    s = load(spark, sf, "signal").withColumn("f", F.col("x") < 0)
    keys = ["track_id", "channel"]
    runs = extend.merge_runs(extend.run_partials(s, keys, "sample_ix", "f", rows=8), keys)
    return fixed(fixed(extend.moments(s, keys, "x").join(runs, keys), ["mean"]), ["variance"], 8)


@query("y04_table_functions", with_ctes("spectra", body=f"""
WITH s AS (SELECT track_id, frame AS source, unnest(range(64)) AS j, unnest(samples) AS x FROM spectra) SELECT track_id, source, CAST(f AS INT) AS frame, {fx('sum(x)')} AS total FROM s, range(4) g(f) WHERE j >= f * 16 AND j < f * 16 + 16 GROUP BY 1, 2, 3"""))
def y04(spark, sf):
    extend.register_table_functions(spark)
    s = load(spark, sf, "spectra").select("track_id", F.col("frame").alias("source"), "samples")
    out = spark.sql("SELECT s.track_id, s.source, f.frame, f.samples FROM {s} s, LATERAL frames(s.samples, 16, 16) f", s=s)
    return out.select("track_id", "source", "frame", fix(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("y04_spans", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(unnest(range(o_orderkey % 50, o_orderkey % 50 + o_orderkey % 4 + 1)) AS BIGINT) AS start FROM orders""")
def y04_spans(spark, sf):
    extend.register_table_functions(spark)
    o = load(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"))
    return spark.sql("SELECT o.o_orderkey, s.start FROM {o} o, LATERAL spans(o.o_orderkey % 50, o.o_orderkey % 50 + o.o_orderkey % 4) s", o=o)


DATE_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-', '/') WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 7)
 WHEN 2 THEN substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 8) || '31' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END"""


@query("fn_iso_date", f"""
WITH t AS (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, {DATE_TEXT} AS text FROM orders)
SELECT o_orderkey, text, regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_cast(text AS DATE) IS NOT NULL AS valid FROM t""")
def fn_iso_date(spark, sf):
    text = F.expr(DATE_TEXT.replace("VARCHAR", "STRING"))
    return load(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), text.alias("text")).withColumn("valid", checks.iso_date("text").isNotNull())


@query("fn_shared_keys", """
WITH c AS (SELECT conv_id, role, count(*) FILTER (turn < 2) AS a, count(*) FILTER (turn >= 2) AS b FROM conversations GROUP BY 1, 2)
SELECT conv_id, coalesce(string_agg(role, ',' ORDER BY role) FILTER (a > 0 AND b > 0), '') AS roles, CAST(coalesce(sum(a * b) FILTER (a > 0 AND b > 0), 0) AS BIGINT) AS weight FROM c GROUP BY 1""")
def fn_shared_keys(spark, sf):
    """Roles of a conversation that speak both early and late (a conversation has a few roles)."""
    c = load(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count(F.when(F.col("turn") < 2, 1)).alias("a"), F.count(F.when(F.col("turn") >= 2, 1)).alias("b"))
    side = lambda n: F.map_from_entries(F.collect_list(F.when(F.col(n) > 0, F.struct("role", n))))
    maps = c.groupBy("conv_id").agg(side("a").alias("early"), side("b").alias("late"))
    both = checks.shared_values("early", "late", lambda x, y: x * y)
    return maps.select("conv_id", F.array_join(checks.shared_keys("early", "late"), ",").alias("roles"), F.aggregate(F.map_values(both), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("weight"))
