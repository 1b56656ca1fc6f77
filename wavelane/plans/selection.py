"""Order, top-k, subset and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelane.functions.numeric import fix
from wavelane.functions.ordinals import block
from wavelane.operators import aggregates, selection
from wavelane.plans.adapters import load
from wavelane.plans.evaluation import fixed
from wavelane.plans.registry import fx, query, with_ctes


@query("k01_canonical_order", """
SELECT conv_id, turn, role, sha256(text) AS digest FROM conversations""")
def k01(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))
    return selection.canonical_order(c, "conv_id", "turn")


@query("k02_top_k", with_ctes("pairs", body=f"""
WITH r AS (SELECT corpus, row_id, delta - control AS change, row_number() OVER (PARTITION BY corpus ORDER BY delta - control DESC, row_id) AS rank FROM pairs)
SELECT corpus, rank, row_id, {fx('change')} AS change FROM r WHERE rank <= 10"""))
def k02(spark, sf):
    p = load(spark, sf, "pairs").select("corpus", "row_id", (F.col("delta") - F.col("control")).alias("change"))
    out = aggregates.top_k(p, ["corpus"], "row_id", "change", 10)
    return out.select("corpus", F.col("rank").cast("bigint").alias("rank"), "row_id", fix(F.col("change")).alias("change"))


@query("k03_first_per_track", with_ctes("metric_rows", body="""
WITH f AS (SELECT corpus, track_id, min(row_id) AS row_id FROM metric_rows GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY row_id) AS position FROM f)
SELECT * FROM r WHERE position <= 40"""))
def k03(spark, sf):
    return selection.first_per_track(load(spark, sf, "metric_rows"), "corpus", "track_id", "row_id", 40, block("row_id"))


@query("k04_median_case", with_ctes("metric_rows", body=f"""
WITH r AS (SELECT corpus, codec_id, row_id, enhanced, row_number() OVER (PARTITION BY corpus, codec_id ORDER BY enhanced, row_id) - 1 AS k, count(*) OVER (PARTITION BY corpus, codec_id) AS n FROM metric_rows)
SELECT corpus, codec_id, row_id, {fx('enhanced')} AS enhanced FROM r WHERE k = n // 2"""))
def k04(spark, sf):
    m = load(spark, sf, "metric_rows").select("corpus", "codec_id", "row_id", "enhanced")
    return fixed(selection.median_case(m, ["corpus", "codec_id"], "enhanced", "row_id"), ["enhanced"])


@query("k05_argmin_choice", with_ctes("metric_rows", body=f"""
WITH e AS (SELECT corpus, unnest([0.001::DOUBLE, 0.01::DOUBLE, 0.1::DOUBLE, 1.0::DOUBLE]) AS penalty, cents, pct FROM metric_rows),
a AS (SELECT corpus, penalty, avg(abs(pct - penalty * (cents % 7 - 3))) AS error FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY error, penalty) AS k FROM a)
SELECT corpus, penalty, {fx('error')} AS error FROM r WHERE k = 1"""))
def k05(spark, sf):
    e = load(spark, sf, "metric_rows").withColumn("penalty", F.explode(F.array(*[F.lit(p) for p in (0.001, 0.01, 0.1, 1.0)])))
    a = e.groupBy("corpus", "penalty").agg(F.avg(F.abs(F.col("pct") - F.col("penalty") * (F.col("cents") % 7 - 3))).alias("error"))
    return fixed(selection.argmin_choice(a, ["corpus"], "penalty", "error"), ["error"])


@query("k06_spaced_sample", with_ctes("crops", body="""
WITH r AS (SELECT source_id, spec_id, row_number() OVER (PARTITION BY source_id ORDER BY spec_id) - 1 AS k, count(*) OVER (PARTITION BY source_id) AS n FROM crops)
SELECT source_id, spec_id FROM r WHERE k IN (SELECT i * (n - 1) // 7 FROM range(8) g(i))"""))
def k06(spark, sf):
    return selection.spaced_sample(load(spark, sf, "crops").select("source_id", "spec_id"), ["source_id"], "spec_id", 8, block("spec_id"))


@query("u01_nested_subsets", with_ctes("metric_rows", body="""
WITH r AS (SELECT corpus, row_id, row_number() OVER (PARTITION BY corpus ORDER BY row_id) AS k FROM metric_rows), s(size) AS (VALUES (5), (10), (40))
SELECT size, corpus, row_id FROM r, s WHERE (corpus = 'ASIA' AND k <= size * 4 // 5) OR (corpus = 'EUROPE' AND k <= size // 5)"""))
def u01(spark, sf):
    return selection.nested_subsets(load(spark, sf, "metric_rows"), "corpus", "row_id", [5, 10, 40], {"ASIA": (4, 5), "EUROPE": (1, 5)}, block("row_id"))


@query("u02_expected_minus_actual", """
SELECT n_name AS codec, p_brand AS label FROM nation, (SELECT DISTINCT p_brand FROM part) EXCEPT
SELECT n_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' AND l_quantity > 40""")
def u02(spark, sf):
    """Expected: every (codec, label); observed: those of large returned lines."""
    line, part, supplier, nation = (load(spark, sf, t) for t in ("lineitem", "part", "supplier", "nation"))
    # The expected grid is nation names (25 rows by contract) times labels: one list, exploded over the labels.
    names = F.array(*[F.lit(r.n_name) for r in nation.select("n_name").collect()]).cast("array<string>")
    expected = part.select(F.col("p_brand").alias("label")).distinct().select(F.explode(names).alias("codec"), "label")
    maker = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    large = line.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
    seen = large.join(part, F.col("l_partkey") == F.col("p_partkey")).join(maker, F.col("l_suppkey") == F.col("s_suppkey"))
    return selection.expected_minus_actual(expected, seen.select(F.col("n_name").alias("codec"), F.col("p_brand").alias("label")))


@query("u03_superset_check", """
WITH s AS (SELECT DISTINCT conv_id, role FROM conversations WHERE turn >= 2), w AS (SELECT DISTINCT conv_id, role FROM conversations WHERE turn <= 2)
SELECT count(*) AS rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM w WHERE w.conv_id = s.conv_id AND w.role = s.role)) AS missing FROM s""")
def u03(spark, sf):
    c = load(spark, sf, "conversations")
    return selection.superset_check(c.filter("turn >= 2"), c.filter("turn <= 2"), ["conv_id", "role"])


@query("u04_merge_catalogs", """
SELECT doc_id AS id, source AS author, n_chars, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, NULL, url FROM pages""")
def u04(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("author"), "n_chars")
    return selection.merge_catalogs([docs, load(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")])


@query("u05_common_metrics", with_ctes("metric_rows", body="""
WITH e AS (SELECT corpus, row_id, unnest(list_filter(['baseline', 'delta', CASE WHEN pct <> 0 THEN 'ratio' END, CASE WHEN corpus <> 'ASIA' THEN 'mr' END], lambda z: z IS NOT NULL)) AS metric FROM metric_rows),
n AS (SELECT corpus, count(*) AS n FROM metric_rows GROUP BY 1)
SELECT corpus, metric, count(*) AS rows FROM e GROUP BY 1, 2 HAVING count(*) = (SELECT n FROM n WHERE n.corpus = e.corpus)"""))
def u05(spark, sf):
    names = F.array_compact(F.array(F.lit("baseline"), F.lit("delta"), F.when(F.col("pct") != 0, "ratio"), F.when(F.col("corpus") != "ASIA", "mr")))
    e = load(spark, sf, "metric_rows").select("corpus", "row_id", F.explode(names).alias("metric"))
    return selection.common_metrics(e, ["corpus"], "row_id", "metric")
