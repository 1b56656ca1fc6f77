"""Manifest and catalog scans, bindings and versioned publication."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelane.functions.hashing import set_hash, text_hash
from wavelane.functions.ordinals import null_safe_join


def read_manifest(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected)`` of JSON lines. Blank lines are skipped; malformed or non-object lines
    come back as ``rejected`` with the raw text and file."""
    raw = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = raw.withColumn("r", F.from_json("value", f"{schema}, _corrupt string", options))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~F.ltrim("value").startswith("{")
    names = [f.name for f in parsed.select("r.*").schema.fields if f.name != "_corrupt"]
    rows = parsed.filter(~bad).select(*[F.col(f"r.{n}").alias(n) for n in names], "file")
    return rows, parsed.filter(bad).select(F.col("value").alias("line"), "file")


def scan_history(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of all historical manifests and catalogs, leaving out source-code snapshots."""
    rows = (
        spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,json}").json(root)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    return keep_history(rows)


def keep_history(rows: DataFrame) -> DataFrame:
    """Rows whose ``file`` is a manifest or catalog outside source snapshots."""
    parts = F.split("file", "/")
    name = F.element_at(parts, -1)
    skip = F.arrays_overlap(parts, F.array(F.lit("source"), F.lit("source_snapshot"), F.lit(".venv")))
    return rows.filter(~skip & ((name == "manifest.jsonl") | name.contains("catalog") | F.array_contains(parts, "catalogs")))


def canonical_stem(identity: Column) -> Column:
    """Lower-case file stem with runs of punctuation as single dashes."""
    stem = F.regexp_replace(F.element_at(F.split(identity, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(stem, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))


def bind_catalog(entries: DataFrame, files: DataFrame, corpus: str, position: str = "position") -> DataFrame:
    """Entries joined with file digests: ``track_id, checksum, split_group, status``.

    ``entries``: position, id, path, declared (nullable), split_group (nullable); ``files``: path,
    checksum. Byte-identical copies keep the first position (status ``copy``); a declared digest
    that differs is ``mismatch`` and an absent file ``missing``.
    """
    ident = F.concat(canonical_stem(F.col("id")), F.lit("-"), F.substring(F.sha2("id", 256), 1, 16))
    track = F.concat(F.lit(f"{corpus}:"), F.regexp_replace(F.regexp_replace(ident, "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    bound = entries.join(files, "path", "left").withColumn("track_id", track)
    good = F.col("checksum").isNotNull() & (F.col("declared").isNull() | (F.col("declared") == F.col("checksum")))
    first = bound.filter(good).groupBy("checksum").agg(F.min(position).alias("_first"))
    status = (
        F.when(F.col("checksum").isNull(), "missing").when(~good, "mismatch").when(F.col(position) > F.col("_first"), "copy").otherwise("bound")
    )
    out = bound.join(first, "checksum", "left").withColumn("status", status)
    return out.withColumn("split_group", F.coalesce("split_group", "checksum")).drop("_first")


def catalog_hash(bound: DataFrame) -> DataFrame:
    """Order-free digest of the bound entries."""
    member = F.concat_ws("|", "track_id", "checksum", "split_group")
    return set_hash(bound.filter(F.col("status") == "bound").withColumn("catalog", F.lit("catalog")), ["catalog"], member)


def union_manifests(manifests: dict[str, DataFrame], corpora: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(rows, problems)``: the union with its ``root``, and named problem counts.

    Problems: duplicate row ids, mixed recipes, missing corpora, and split leakage of a recording
    or of an original source.
    """
    rows = None
    for root, df in manifests.items():
        part = df.withColumn("root", F.lit(root))
        rows = part if rows is None else rows.unionByName(part)
    def leaks(key: str) -> DataFrame:
        g = rows.groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("z")).filter(F.col("a") != F.col("z"))
        return g.agg(F.lit(f"split_leakage_{key}").alias("problem"), F.count(F.lit(1)).alias("n"))
    dup = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").agg(F.lit("duplicate_row_id").alias("problem"), F.count(F.lit(1)).alias("n"))
    sets = rows.agg((F.countDistinct("recipe_hash") - 1).alias("mixed_recipes"), (F.lit(len(corpora)) - F.countDistinct(F.when(F.col("corpus").isin(*corpora), F.col("corpus")))).alias("missing_corpora"))
    named = sets.unpivot([], ["mixed_recipes", "missing_corpora"], "problem", "n")
    return rows, dup.unionByName(named).unionByName(leaks("track_id")).unionByName(leaks("source_checksum"))


def provenance(rows: DataFrame, manifest: str = "corpus") -> DataFrame:
    """Per manifest: rows, tracks, content hash and validation-set hash."""
    content = set_hash(rows, [manifest], text_hash(F.col("row_id").cast("string"), F.col("track_id"), F.col("split"), F.col("clean_path")))
    val = set_hash(rows.filter(F.col("split") == "validation"), [manifest], F.col("row_id").cast("string"))
    counts = rows.groupBy(manifest).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("track_id").alias("tracks"))
    out = null_safe_join(counts, content.select(manifest, F.col("set_hash").alias("manifest_hash")), [manifest])
    return null_safe_join(out, val.select(manifest, F.col("set_hash").alias("validation_hash")), [manifest], "left")


def portable_index(catalog: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Whitelisted columns with flattened quality measures and only the file name of the path."""
    keep = [c for c in fields if c in catalog.columns]
    return catalog.select(
        *keep, F.concat(F.lit("raw/music/"), F.element_at(F.split("path", "/"), -1)).alias("path"),
        F.col("source_quality.sample_rate").alias("native_sample_rate"), F.col("source_quality.channels").alias("native_channels"),
        F.col("source_quality.duration_seconds").alias("duration_seconds"), F.coalesce("publisher_md5", "file_md5").alias("publisher_original_md5"),
    )


def credit_rows(rows: DataFrame, changes: str) -> DataFrame:
    """One credit row per distinct source."""
    first = rows.groupBy("source_id").agg(F.min(F.struct("title", "author", "source_page", "license_url")).alias("r"))
    return first.select("source_id", F.coalesce("r.title", "source_id").alias("title"), F.coalesce("r.author", F.lit("unknown")).alias("author"), "r.source_page", "r.license_url", F.lit(changes).alias("changes"))


def write_credits(rows: DataFrame, path: str, changes: str) -> None:
    """Credits as CSV with a header; fails when the path exists."""
    credit_rows(rows, changes).write.mode("errorifexists").option("header", "true").csv(path)


def audit_file_checksums(rows: DataFrame, digests: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Files of the chosen splits whose digest or length differs, or which are missing.

    ``rows``: path, split, checksum, length_samples; ``digests``: path, sha256, frames. The split
    filter prunes partitions before any file is looked at.
    """
    d = digests.select("path", F.col("sha256").alias("_s"), F.col("frames").alias("_f"))
    joined = rows.filter(F.col("split").isin(*splits)).join(d, "path", "left")
    reason = F.when(F.col("_s").isNull(), "missing").when(F.col("_f") != F.col("length_samples"), "length").when(F.col("_s") != F.col("checksum"), "checksum")
    return joined.select("path", "split", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish_dataset(df: DataFrame, root: str, corpus: str, recipe: dict, validate: Callable[[DataFrame], DataFrame], partition: str = "split", reuse: bool = False) -> str:
    """Write, validate and rename a dataset version to ``<root>/<corpus>-<hash16>``.

    ``validate`` returns the rows that break a rule. An existing version fails, or with ``reuse``
    is checked against the recipe. A failed run removes only its own staging folder.
    """
    spark = df.sparkSession
    text = json.dumps(recipe, sort_keys=True, separators=(",", ":"))
    digest = spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]
    target = f"{root}/{corpus}-{digest[:16]}"
    fs, target_path = _file_system(spark, target)
    if fs.exists(target_path):
        if not reuse:
            raise FileExistsError(f"dataset version already exists: {target}")
        found = spark.read.text(f"{target}/recipe").first()
        if found is None or json.loads(found[0])["recipe_hash"] != digest:
            raise ValueError("existing dataset recipe hash mismatch")
        return target
    staging = f"{root}/.staging-{corpus}-{digest[:8]}-{uuid.uuid4().hex}"
    try:
        df.write.mode("errorifexists").partitionBy(partition).parquet(f"{staging}/rows")
        written = spark.read.schema(df.schema).parquet(f"{staging}/rows")
        if written.isEmpty():
            raise ValueError("manifest must contain at least one row")
        if not written.filter(F.col("corpus") != corpus).isEmpty():
            raise ValueError("row outside the published corpus")
        if not validate(written).isEmpty():
            raise ValueError("manifest breaks a rule")
        summary = written.groupBy(partition).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("track_id").alias("tracks"))
        summary.coalesce(1).write.json(f"{staging}/summary")
        spark.range(1).select(F.lit(json.dumps({**recipe, "recipe_hash": digest}, sort_keys=True)).alias("value")).coalesce(1).write.text(f"{staging}/recipe")
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staging), target_path):
            raise OSError("publication rename failed")
    except BaseException:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staging), True)
        raise
    return target


def write_report(df: DataFrame, path: str) -> None:
    """Strict JSON report of a small result; NaN or infinite numbers fail before anything is written."""
    numbers = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    bad = F.lit(False)
    for n in numbers:
        bad = bad | F.coalesce(F.isnan(n) | (F.abs(F.col(n)) == float("inf")), F.lit(False))
    if not df.filter(bad).isEmpty():
        raise ValueError("report contains non-finite numbers")
    df.coalesce(1).write.mode("errorifexists").json(path)


def read_catalog_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Growing receipt files as a stream; an empty folder is an empty stream."""
    return spark.readStream.schema(schema).json(folder)
