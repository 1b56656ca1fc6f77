"""Scan, source and sink queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.functions.numeric import fix
from wavelane.operators import rules
from wavelane.plans.adapters import load
from wavelane.plans.registry import fx, query, with_ctes
from wavelane.plans.streams import scratch
from wavelane.session import cut_lineage
from wavelane.sources import files, manifests, pages

MANIFEST = "row_id bigint, track_id string, corpus string, split string, codec_id string, sampling_weight double"


def manifest_lines(spark, sf):
    """The manifest as JSON lines, with a blank and a truncated line for every 100th row."""
    m = load(spark, sf, "manifest").select("row_id", "track_id", "corpus", "split", "codec_id", "sampling_weight")
    line = F.to_json(F.struct(*m.columns))
    extra = F.when(F.col("row_id") % 100 == 1, F.array(F.lit("  "), F.substring(line, 1, 30), F.lit("[1]"))).otherwise(F.array().cast("array<string>"))
    return m.select(F.explode(F.concat(F.array(line), extra)).alias("value"))


@query("s01_read_manifest", with_ctes("manifest", body="""
SELECT split, count(*) AS rows, count(DISTINCT track_id) AS tracks, CAST(0 AS BIGINT) AS rejected FROM manifest GROUP BY 1 UNION ALL SELECT 'rejected', 0, 0, 2 * count(*) FROM manifest WHERE row_id % 100 = 1"""))
def s01(spark, sf):
    folder = scratch(spark) + "/manifest"
    manifest_lines(spark, sf).write.text(folder)
    rows, bad = manifests.read_manifest(spark, folder, MANIFEST)
    good = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("track_id").alias("tracks"), F.lit(0).cast("bigint").alias("rejected"))
    return good.unionByName(bad.agg(F.lit("rejected").alias("split"), F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("tracks"), F.count(F.lit(1)).alias("rejected")))


@query("s02_bind_catalog", """
WITH e AS (SELECT doc_id AS position, 'albums/' || source || '/Track No.' || doc_id || '.v2.wav' AS id, sha256(text) AS checksum, CASE WHEN doc_id % 60 = 0 THEN 'bad' WHEN doc_id % 3 = 0 THEN sha256(text) END AS declared,
 CASE WHEN doc_id % 4 = 0 THEN 'work-' || source END AS split_group, doc_id % 77 = 5 AS absent FROM documents),
b AS (SELECT *, CASE WHEN absent THEN NULL ELSE checksum END AS ck FROM e), g AS (SELECT *, ck IS NOT NULL AND (declared IS NULL OR declared = ck) AS good FROM b), f AS (SELECT ck, min(position) AS first_at FROM g WHERE good GROUP BY 1)
SELECT id, 'library:track-no-' || position || '-v2-' || substr(sha256(id), 1, 16) AS track_id, ck AS checksum, coalesce(split_group, ck) AS split_group,
 CASE WHEN ck IS NULL THEN 'missing' WHEN NOT good THEN 'mismatch' WHEN position > first_at THEN 'copy' ELSE 'bound' END AS status FROM g LEFT JOIN f USING (ck)""")
def s02(spark, sf):
    d = load(spark, sf, "documents")
    k, digest = F.col("doc_id"), F.sha2("text", 256)
    path = F.concat(F.lit("f/"), k.cast("string"))
    entries = d.select(
        k.alias("position"), F.concat(F.lit("albums/"), "source", F.lit("/Track No."), k.cast("string"), F.lit(".v2.wav")).alias("id"), path.alias("path"),
        F.when(k % 60 == 0, "bad").when(k % 3 == 0, digest).alias("declared"), F.when(k % 4 == 0, F.concat(F.lit("work-"), "source")).alias("split_group"),
    )
    stored = d.filter(k % 77 != 5).select(path.alias("path"), digest.alias("checksum"))
    return manifests.bind_catalog(entries, stored, "library").select("id", "track_id", "checksum", "split_group", "status")


@query("s02_catalog_hash")
def s02_hash(spark, sf):
    d = load(spark, sf, "documents")
    bound = d.select(F.concat(F.lit("library:"), F.col("doc_id").cast("string")).alias("track_id"), F.sha2("text", 256).alias("checksum"), F.col("source").alias("split_group"), F.lit("bound").alias("status"))
    return manifests.catalog_hash(bound)


@query("s03_scan_directory")
def s03(spark, sf):
    out = files.scan_directory(spark, sf, ("parquet",))
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query("s04_decode_pcm", """
WITH s AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding) AS x FROM embeddings)
SELECT vec_id, CAST(0 AS INT) AS channel, j // 16 AS chunk_id, 48000 AS sample_rate, count(*) AS samples, """ + fx("sum(x::DOUBLE * (j % 16 + 1))") + """ AS moment, NULL::VARCHAR AS error FROM s WHERE vec_id % 9 <> 4 GROUP BY 1, 3
UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, NULL, 'payload length does not match header' FROM embeddings WHERE vec_id % 9 = 4""")
def s04(spark, sf):
    e = files.encode_pcm(load(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 48000)
    broken = F.when(F.col("vec_id") % 9 == 4, F.expr("substring(content, 1, 100)")).otherwise(F.col("content"))
    out = files.decode_pcm(e.select(F.col("vec_id").cast("string").alias("path"), broken.alias("content")), chunk=16)
    moment = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select(F.col("path").cast("bigint").alias("vec_id"), "channel", "chunk_id", "sample_rate", F.size("samples").cast("bigint").alias("samples"), fix(moment).alias("moment"), "error").withColumn(
        "samples", F.when(F.col("error").isNull(), F.col("samples"))
    )


@query("s05_lossless_filter", with_ctes("catalog", body="""
SELECT id, CASE WHEN container NOT IN ('WAV','WAVEX','RF64','FLAC','AIFF','W64','CAF') THEN 'container' WHEN subtype NOT IN ('PCM_U8','PCM_S8','PCM_16','PCM_24','PCM_32','FLOAT','DOUBLE') THEN 'subtype'
 WHEN channels NOT IN (1, 2) THEN 'channels' WHEN n_chars <= 20 THEN 'empty' END AS reason FROM catalog"""))
def s05(spark, sf):
    return rules.lossless_reason(load(spark, sf, "catalog").withColumn("frames", F.col("n_chars") - 20)).select("id", "reason")


@query("s06_union_manifests", with_ctes("manifest", body="""
WITH u AS (SELECT * FROM manifest WHERE corpus <> 'EUROPE' UNION ALL SELECT * FROM manifest WHERE corpus IN ('ASIA', 'EUROPE'))
SELECT 'duplicate_row_id' AS problem, count(*) AS n FROM (SELECT row_id FROM u GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'mixed_recipes', count(DISTINCT recipe_hash) - 1 FROM u
UNION ALL SELECT 'missing_corpora', 3 - count(DISTINCT CASE WHEN corpus IN ('ASIA', 'EUROPE', 'MOON') THEN corpus END) FROM u
UNION ALL SELECT 'split_leakage_track_id', count(*) FROM (SELECT track_id FROM u GROUP BY 1 HAVING min(split) <> max(split)) UNION ALL SELECT 'split_leakage_source_checksum', count(*) FROM (SELECT source_checksum FROM u GROUP BY 1 HAVING min(split) <> max(split))"""))
def s06(spark, sf):
    m = load(spark, sf, "manifest")
    parts = {"a": m.filter(F.col("corpus") != "EUROPE"), "b": m.filter(F.col("corpus").isin("ASIA", "EUROPE"))}
    return manifests.union_manifests(parts, ("ASIA", "EUROPE", "MOON"))[1]


@query("s07_scan_history", with_ctes("manifest", body="SELECT corpus, count(*) AS rows FROM manifest WHERE corpus <> 'AFRICA' GROUP BY 1"))
def s07(spark, sf):
    """Manifests below a root, in folders and file names that count and in those that don't."""
    root = scratch(spark)
    m = load(spark, sf, "manifest").select("row_id", "track_id", "corpus")
    m.filter(F.col("corpus") != "AFRICA").write.json(f"{root}/catalogs")
    m.filter(F.col("corpus") == "AFRICA").write.json(f"{root}/source_snapshot/catalogs")
    return manifests.scan_history(spark, root, "row_id bigint, track_id string, corpus string").groupBy("corpus").agg(F.count(F.lit(1)).alias("rows"))


@query("s08_publish_dataset", with_ctes("manifest", body="""
SELECT corpus, split, count(*) AS rows, count(DISTINCT track_id) AS tracks FROM manifest GROUP BY 1, 2"""))
def s08(spark, sf):
    """Every corpus becomes a published version of its own; the versions are read back."""
    rows = cut_lineage(load(spark, sf, "manifest").select("row_id", "track_id", "corpus", "split", "length_samples"))  # made once for the five
    root, versions = scratch(spark), []
    for corpus in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"):  # the five corpora of the tables
        mine = rows.filter(F.col("corpus") == corpus)
        versions.append(manifests.publish_dataset(mine, root, corpus, {"seed": 7, "codecs": ["aac", "mp3"]}, lambda d: d.filter(F.col("length_samples") <= 0)))
    read = [spark.read.parquet(f"{v}/rows").select("corpus", "split", "track_id") for v in versions]
    return reduce(DataFrame.unionByName, read).groupBy("corpus", "split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("track_id").alias("tracks"))


@query("s09_write_report", with_ctes("metric_rows", body=f"SELECT corpus, count(*) AS rows, {fx('avg(delta)')} AS delta FROM metric_rows GROUP BY 1"))
def s09(spark, sf):
    path = scratch(spark) + "/report"
    out = load(spark, sf, "metric_rows").groupBy("corpus").agg(F.count(F.lit(1)).alias("rows"), fix(F.avg("delta")).alias("delta"))
    manifests.write_report(out, path)
    return spark.read.schema("corpus string, rows bigint, delta double").json(path)


@query("s10_write_credits", with_ctes("catalog", body="""
WITH f AS (SELECT work AS source_id, min(CAST(id AS VARCHAR)) AS title FROM catalog GROUP BY 1), r AS (SELECT f.*, c.author FROM f JOIN catalog c ON c.work = f.source_id AND CAST(c.id AS VARCHAR) = f.title)
SELECT source_id, title, author, 'https://example.org/' || author AS source_page, 'https://creativecommons.org/licenses/by/4.0' AS license_url, 'cropped' AS changes FROM r"""))
def s10(spark, sf):
    path = scratch(spark) + "/credits"
    rows = load(spark, sf, "catalog").select(
        F.col("work").alias("source_id"), F.col("id").cast("string").alias("title"), "author", F.concat(F.lit("https://example.org/"), "author").alias("source_page"),
        F.lit("https://creativecommons.org/licenses/by/4.0").alias("license_url"),
    )
    manifests.write_credits(rows, path, "cropped")
    return spark.read.option("header", "true").csv(path)


@query("s11_read_catalog_stream", with_ctes("catalog", body="SELECT region, count(*) AS receipts FROM catalog GROUP BY 1"))
def s11(spark, sf):
    """Receipts written in two lots and read by a file stream until none is left."""
    from wavelane.streaming import monitors
    root = scratch(spark)
    receipts = load(spark, sf, "catalog").select("id", "region")
    for lot in (0, 1):
        receipts.filter(F.col("id") % 2 == lot).write.mode("append").json(f"{root}/in")
        stream = manifests.read_catalog_stream(spark, f"{root}/in", "id bigint, region string")
        monitors.run_available(stream, root)
    return spark.read.parquet(f"{root}/data").groupBy("region").agg(F.count(F.lit(1)).alias("receipts"))


# As the parser reads references: these names and numbers may go without their semicolon. The ampersand comes last.
TEXT = r"""regexp_extract(html, '<{t}>(.*?)</{t}>', 1)"""
for pattern, sign in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#0*39(?:;|([^0-9;])|$)", r"''\1"), ("&amp;?", "&"), (r"\s+", " ")):
    TEXT = f"regexp_replace({TEXT}, '{pattern}', '{sign}', 'g')"
TEXT = f"trim({TEXT})"


@query("s12_publisher_fields", f"""
WITH t AS (SELECT page_id, {TEXT.format(t='title')} AS title, {TEXT.format(t='h1')} AS h1 FROM pages),
e AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN 'another title' ELSE title END AS expected FROM t)
SELECT page_id, CASE WHEN expected <> title THEN 'title does not match' WHEN trim(regexp_replace(h1, '\\s*\\([^()]*[0-9]+[^()]*\\)\\s*$', '')) = '' THEN 'owner is empty' END AS reason,
 CASE WHEN expected = title THEN nullif(trim(regexp_replace(h1, '\\s*\\([^()]*[0-9]+[^()]*\\)\\s*$', '')), '') END AS rights_owner FROM e""")
def s12(spark, sf):
    fields = pages.page_fields(load(spark, sf, "pages"), "page_id", "html", ("title", "h1"))
    expected = F.when(F.col("page_id") % 5 == 0, "another title").otherwise(F.try_element_at(F.col("fields")["title"], F.lit(1)))
    return pages.publisher_fields(fields, expected, "title", "h1").select("page_id", "reason", "rights_owner")


@query("s13_portable_index", with_ctes("catalog", body="""
SELECT id, author, pcm, 'raw/music/' || id || '.flac' AS path, sample_rate AS native_sample_rate, channels AS native_channels, duration_seconds, CASE WHEN id % 3 = 0 THEN 'md5-' || id ELSE 'file-' || id END AS publisher_original_md5 FROM catalog"""))
def s13(spark, sf):
    c = load(spark, sf, "catalog")
    name = F.col("id").cast("string")
    full = c.select(
        "id", "author", "pcm", F.concat(F.lit("/private/store/"), name, F.lit(".flac")).alias("path"), F.struct("sample_rate", "channels", "duration_seconds").alias("source_quality"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("md5-"), name)).alias("publisher_md5"), F.concat(F.lit("file-"), name).alias("file_md5"),
    )
    return manifests.portable_index(full, ["id", "author", "pcm", "genre_basis"])


@query("s15_provenance", with_ctes("manifest", body="""
WITH m AS (SELECT corpus, sha256(sha256(row_id || ':' || track_id || ':' || split || ':' || clean_path)) AS h, CASE WHEN split = 'validation' THEN sha256(CAST(row_id AS VARCHAR)) END AS v FROM manifest),
a AS (SELECT corpus, substr(h, 1, 3) AS b, sha256(string_agg(DISTINCT h, ',' ORDER BY h)) AS d FROM m GROUP BY 1, 2), c AS (SELECT corpus, substr(v, 1, 3) AS b, sha256(string_agg(DISTINCT v, ',' ORDER BY v)) AS d FROM m WHERE v IS NOT NULL GROUP BY 1, 2),
n AS (SELECT corpus, count(*) AS rows, count(DISTINCT track_id) AS tracks FROM manifest GROUP BY 1)
SELECT corpus, rows, tracks, (SELECT sha256(string_agg(d, ',' ORDER BY b)) FROM a WHERE a.corpus = n.corpus) AS manifest_hash, (SELECT sha256(string_agg(d, ',' ORDER BY b)) FROM c WHERE c.corpus = n.corpus) AS validation_hash FROM n"""))
def s15(spark, sf):
    return manifests.provenance(load(spark, sf, "manifest"))


@query("v03_audit_file_checksums", """
WITH r AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT 'f/' || doc_id AS path, split, CASE WHEN doc_id % 70 = 0 THEN 'missing' WHEN doc_id % 41 = 0 THEN 'length' ELSE 'checksum' END AS reason FROM r
WHERE split IN ('validation', 'test') AND (doc_id % 70 = 0 OR doc_id % 41 = 0 OR doc_id % 31 = 0)""")
def v03(spark, sf):
    k = F.col("doc_id")
    d = load(spark, sf, "documents").withColumn("path", F.concat(F.lit("f/"), k.cast("string")))
    split = F.when(k % 10 == 0, "validation").when(k % 10 == 1, "test").otherwise("train")
    rows = d.select("path", split.alias("split"), F.sha2("text", 256).alias("checksum"), F.col("n_chars").alias("length_samples"))
    present = d.filter(k % 70 != 0).select("path", F.when(k % 31 == 0, F.sha2(F.reverse("text"), 512)).otherwise(F.sha2("text", 256)).alias("sha256"), (F.col("n_chars") + (k % 41 == 0).cast("int")).alias("frames"))
    return manifests.audit_file_checksums(rows, present, ["validation", "test"])
