"""Small cases of the findings of round 3; each failed before its change."""

import tempfile

import duckdb
import numpy as np
from pyspark.sql import functions as F

import wavelane.plans.evaluation as evaluation
from wavelane.plans import adapters, scans, streams
from wavelane.plans.registry import ORACLES
from wavelane.streaming import monitors, stateful
from wavelane.operators import aggregates, graph, intervals, sampling, selection, sequence, signal


def test_equal_clips_in_another_order_tie(spark, monkeypatch):
    # raw_full is 0.3, 0.1, 0.2 and raw_mid 0.3, 0.2, 0.1: as doubles their sums differ in the last place.
    rows = spark.createDataFrame([(1, "A", 7, 10**6, 3), (2, "A", 7, 10**6, 1), (3, "A", 7, 10**6, 2)], "row_id bigint, codec_id string, track_id bigint, cents bigint, pct bigint").coalesce(1)
    monkeypatch.setattr(evaluation, "load", lambda *_: rows)
    cells = evaluation.cells(spark, "", exact=True)
    a19 = aggregates.factorial_contrasts(cells, evaluation.CONTRASTS, ["raw_full", "raw_mid", "log_full", "log_mid"]).filter("contrast = 'reduction'").first()
    assert (a19.wins, a19.losses, a19.ties) == (0, 0, 1)
    a44 = aggregates.variant_vs_control(cells.withColumnRenamed("arm", "variant"), "raw_full", "value").filter("variant = 'raw_mid'").first()
    assert (a44.wins, a44.losses) == (0, 0)


def test_publisher_statement_reads_references_without_semicolon(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    texts = ["a &amp", "b &amp;&amp;", "c &lt;d&gt", "e &quot f", "g &#39;h", "i &amp;lt; j", "&#39", "k &#39l"]
    rows = [(i, "u", f"<html><head><title>{x}</title></head><body><h1>{x}</h1></body></html>") for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = sorted(duck.execute(ORACLES["s12_publisher_fields"]).fetchall())
    assert want == sorted(tuple(r) for r in scans.s12(spark, folder).collect())


def test_frames_in_the_padding_of_an_excerpt_count(spark):
    # 10 samples in an excerpt of 64: windows of 16 begin at 0, 4, ..., 48, all but three of them in the padding.
    x, y = np.sin(np.arange(10.0)), np.cos(np.arange(10.0)) / 2
    rows = spark.createDataFrame([(1, i, float(x[i]), float(y[i])) for i in range(10)], "track_id int, i bigint, x double, y double")
    clips = signal.excerpts(rows, ["track_id"], "i", ["x", "y"], 64)
    n, hop = 16, 4
    cut = lambda v: [np.abs(np.fft.rfft(np.pad(v, (0, 54))[f : f + n] * signal.hann(n))) for f in range(0, 64 - n + 1, hop)]
    p, t = np.maximum(cut(y), 1e-10), np.maximum(cut(x), 1e-10)
    unit = np.sqrt(np.array([1, *[2] * 7, 1]) / (n * (signal.hann(n) ** 2).sum()))
    floor = ((t * unit) ** 2).sum(axis=1).mean() * 1e-4 + 1e-12
    got = signal.multires_score(clips, ["track_id"], "y", "x", 48000, (n,)).filter("band = 0 and component = 'amplitude'").first()
    band = slice(0, 2)  # 0 and 3000 Hz
    ee, tt = (((p - t) * unit)[:, band] ** 2).sum(axis=1).mean(), ((t * unit)[:, band] ** 2).sum(axis=1).mean()
    assert len(p) == 13 and abs(got.value - (np.sqrt(ee / (tt + floor) + 1e-6) - 1e-3)) < 1e-9
    whole = signal.multires_reconstruction(clips.withColumn("cut", F.lit(9000.0)), ["track_id"], "y", "x", "x", "cut", 48000, 4000.0, (n,)).first()
    w = signal._crossover(np.array([9000.0]), 9, 3000.0, 4000.0)[0]
    least = np.maximum((t * t).sum(axis=1) / 9 * 1e-4, 1e-14)
    level = lambda v: np.maximum((v * v * w).sum(axis=1) / 9, least)
    assert abs(whole.high_energy - np.abs(10 * np.log10(level(p) / level(t))).mean()) < 1e-9


def test_streams_hold_many_keys_in_few_groups(spark, monkeypatch):
    monkeypatch.setattr(stateful, "GROUPS", 3)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.range(40 * 30).select((F.col("id") % 40).alias("run_id"), F.floor(F.col("id") / 40).alias("seq"), (F.xxhash64("id") % 3 != 0).alias("ready"), (F.xxhash64("id") % 5 == 0).alias("silent"))
    calls = spark.sparkContext.accumulator(0)

    class Counted(stateful.Ordered):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            return super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(stateful, "Ordered", Counted)
    with monitors.rocksdb_state(spark):
        for lot in (0, 1):
            rows.filter(F.floor((F.col("seq") + F.col("seq") * 31 % 7) / 18) == lot).write.mode("append").parquet(f"{root}/in")
            monitors.run_available(stateful.stream_healthy_gate(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), "run_id", "seq", 8), root)
    got = spark.read.parquet(f"{root}/data").select("run_id", "seq", "enhance")
    want = monitors.healthy_gate(rows.filter(F.col("seq") + F.col("seq") * 31 % 7 < 36), ["run_id"], "seq", F.col("ready"), F.col("silent")).select("run_id", "seq", "enhance")
    assert got.count() > 1000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert calls.value <= 6


def test_a_batch_runs_once_for_both_tables(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            runs.add(len(pdf))
            yield pdf

    schema = "run_id bigint, seq bigint, event_time timestamp, service_ns bigint, missed boolean, rejected boolean, stale boolean, invalid bigint, overflow boolean, streak bigint"
    rows = spark.range(50).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("event_time"), F.col("id").alias("service_ns"), *[F.lit(False).alias(c) for c in ("missed", "rejected", "stale")], F.lit(0).cast("bigint").alias("invalid"), F.lit(False).alias("overflow"), F.lit(0).cast("bigint").alias("streak"))
    sink = monitors.BatchSink(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    monitors.slo_writer(sink, ["run_id"], "1 day")(rows.mapInPandas(counted, schema), 0)
    assert runs.value == 50 and sink.table(spark, "counters").agg(F.sum("hops")).first()[0] == 50


def test_a_long_chain_closes_in_few_rounds(spark, monkeypatch):
    written = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(1) or cut(df))
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    star = [("s0", f"t{i}") for i in range(40)]
    pairs = spark.createDataFrame([*chain, *star, ("lone", None), (None, "other"), ("self", "self"), ("s0", "t1")], "a string, b string").coalesce(1)
    got = {r["id"]: r["component"] for r in graph.pair_components(pairs, "a", "b").collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(61)}, "s0": "s0", **{f"t{i}": "s0" for i in range(40)}, "lone": "lone", "other": "other", "self": "self"}
    assert len(written) <= 40
    edges = spark.createDataFrame([(3, "x"), (2, "x"), (2, "y"), (1, "y"), (9, "z"), (8, None)], "id int, alias string").coalesce(1)
    assert sorted(tuple(r) for r in graph.alias_components(edges).collect()) == [(1, 1), (2, 1), (3, 1), (9, 9)]


def test_spaced_crops_stay_in_their_row(spark):
    rows = spark.createDataFrame([(1, 5, 60, 100), (2, 80, 0, 100), (3, 0, 45, 90)], "row_id bigint, anchor bigint, reserved bigint, length_samples bigint").coalesce(1)
    got = sequence.evenly_spaced_crops(rows, 5, 10, 4)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, anchor, reserved, length in ((1, 5, 60, 100), (2, 80, 0, 100), (3, 0, 45, 90)):
        free = [s for s in range(length - 9) if s != anchor and not reserved - 10 < s < reserved + 6]
        want += [(i, 0, anchor)] + [(i, p, free[(2 * p - 1) * len(free) // 8]) for p in range(1, 5)]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_rows_meet_only_the_spans_of_their_blocks(spark):
    # 300 spans of one source; a row lies beside one or two of them, some spans cross blocks.
    protected = [(7, k * 16000, k * 16000 + (160 if k % 3 else 9000)) for k in range(300)] + [(7, 2000, 2000), (8, 0, 10**6)]
    rows = [(i, 7, 44100 if i % 2 else 48000, i * 137 % 30000, 20 + i * 31 % 300) for i in range(60)] + [(60, 9, 48000, 0, 25), (61, None, 48000, 0, 25), (62, 8, 44100, 10, 30)]
    df = spark.createDataFrame(rows, "row_id bigint, src bigint, sample_rate int, origin bigint, length_samples bigint").coalesce(2)
    p = spark.createDataFrame(protected, "src bigint, lo_tick bigint, hi_tick bigint").coalesce(2)
    got = {r["row_id"]: [s for a, z in r["legal"] for s in range(a, z + 1)] for r in intervals.legal_starts(df, p, "src", 10, block=20000).collect()}
    for row_id, src, rate, origin, size in rows:
        t = 160 if rate == 44100 else 147
        near = [(lo, hi) for q, lo, hi in protected if q == src]
        want = [s for s in range(size - 9) if all((origin + s + 10) * t <= lo or (origin + s) * t >= hi for lo, hi in near)]
        assert got[row_id] == want, row_id


def test_a_lone_illegal_crop_is_placed_without_python(spark, monkeypatch):
    def refused(*_):
        raise RuntimeError("left the JVM")

    monkeypatch.setattr(sequence, "nearest_free", refused)
    specs = spark.createDataFrame([(1, 1, 9), (2, 2, 30), (3, 3, 2), (4, 3, 3)], "spec_id bigint, row_id bigint, start bigint").coalesce(1)
    spans = spark.createDataFrame([(1, 0, 7), (1, 11, 12), (2, 0, 3), (2, 9, 20), (3, 0, 5)], "row_id bigint, lo bigint, hi bigint").coalesce(1)
    got = sorted(tuple(r) for r in sequence.repair_overlaps(specs, spans).collect())
    assert got == [(1, 1, 9, 7, True), (2, 2, 30, 20, True), (3, 3, 2, 2, False), (4, 3, 3, 3, False)]


def test_a_schedule_numbers_only_what_it_draws(spark, monkeypatch):
    seen, whole = [], sampling.running_sum
    monkeypatch.setattr(sampling, "running_sum", lambda df, *rest: seen.append(df.count()) or whole(df, *rest))
    df = spark.range(400).select(F.col("id").alias("row_id"), F.lit("m").alias("corpus"), F.concat(F.lit("t"), F.floor(F.col("id") / 2)).alias("track_id"), F.lit(1.0).alias("sampling_weight"))
    spans = df.select("row_id", F.lit(0).cast("bigint").alias("lo"), F.lit(4).cast("bigint").alias("hi"))
    assert sampling.balanced_schedule(df, spans, {"m": 3}, 2, 5).count() == 6
    assert seen == [12]


def test_a_part_of_metric_rows_has_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(adapters, "PART_ROWS", 200)
    rows = adapters.load(spark, "/root/testdata/sf0.001", "metric_rows")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    spread = adapters.dealt(spark, spark.range(lines), "id")
    assert spread.rdd.getNumPartitions() == lines // 200 + 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and f", {lines // 200 + 1})" in plan


def test_common_metrics_read_their_rows_once(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", 2, "y"), ("b", 3, "y"), ("b", 3, None), (None, 4, "z"), ("b", None, "q"), ("c", 5, None)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = spark.createDataFrame(rows, "corpus string, row_id int, metric string").coalesce(1).mapInPandas(counted, "corpus string, row_id int, metric string")
    got = sorted(map(repr, (tuple(r) for r in selection.common_metrics(df, ["corpus"], "row_id", "metric").collect())))
    assert got == sorted(map(repr, [("a", "x", 2), ("b", "y", 1), ("b", None, 1), (None, "z", 1), ("c", None, 1)]))
    assert seen.value == len(rows)


def test_rows_of_a_stream_are_made_once_for_all_lots(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(30).select((F.col("id") % 2).alias("run_id"), F.col("id").alias("seq")).mapInPandas(counted, "run_id bigint, seq bigint")
    folder = streams.streamed(spark, rows, F.floor(F.col("seq") / 10) * 2, 5, lambda source: source)  # lots 1 and 3 are empty
    assert made.value == 30 and spark.read.parquet(f"{folder}/data").count() == 30
