import json
import random
import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from wavelane.operators import sequence
from wavelane.plans import adapters, streams
from wavelane.sources import files, manifests, pages
from wavelane.streaming import monitors, stateful
from conftest import SF


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_framer_stream_equals_fixed_hops(spark, rocks):
    rng = random.Random(1)
    signal = {k: [rng.random() for _ in range(50 + k)] for k in (1, 2)}
    root, chunk = folder(), {1: 0, 2: 0}
    pos = {1: 0, 2: 0}
    rows = []
    for lot in range(3):
        rows = []
        for k, x in signal.items():
            while pos[k] < len(x) and (lot == 2 or pos[k] < 20 * (lot + 1)):
                n = min(rng.randint(1, 9), len(x) - pos[k])
                rows.append((k, chunk[k], x[pos[k] : pos[k] + n], pos[k] + n == len(x)))
                pos[k] += n
                chunk[k] += 1
        spark.createDataFrame(rows, "track_id bigint, chunk bigint, samples array<double>, final boolean").coalesce(1).write.mode("append").json(f"{root}/in")
        stream = spark.readStream.schema("track_id bigint, chunk bigint, samples array<double>, final boolean").json(f"{root}/in")
        monitors.run_available(stateful.stream_framer(stream, 8), root)
    got = {(r["track_id"], r["hop"]): (list(r["samples"]), r["valid"]) for r in spark.read.parquet(f"{root}/data").collect()}
    for k, x in signal.items():
        hops = [x[i : i + 8] for i in range(0, len(x), 8)]
        assert [got[k, i] for i in range(len(hops))] == [(h + [0.0] * (8 - len(h)), len(h)) for h in hops]
    assert sum(v for _, v in got.values()) == sum(map(len, signal.values()))


def test_bandwidth_stream_equals_batch(spark, rocks):
    rng = random.Random(2)
    rows = [(k, 0, i, rng.choice([0.0, 3000.0, 20000.0]), rng.random() < 0.1) for k in (1, 2) for i in range(40)]
    schema = "track_id bigint, channel bigint, frame bigint, detected_hz double, silent boolean"
    df = spark.createDataFrame(rows, schema)
    root = folder()
    for lot in range(2):
        df.filter(F.floor(F.col("frame") / 20) == lot).coalesce(1).write.mode("append").json(f"{root}/in")
        monitors.run_available(stateful.stream_bandwidth(spark.readStream.schema(schema).json(f"{root}/in"), 0.2, 0.5, 24000.0, 3), root)
    keys = ["track_id", "channel"]
    smooth = sequence.ema(df, keys, "frame", "detected_hz", 0.2, F.col("silent")).join(df, [*keys, "frame"])
    want = sequence.hangover(smooth, keys, "frame", F.col("smoothed") / 24000 < 0.5, F.col("silent"), 3)
    a = sorted((r["track_id"], r["frame"], round(r["smoothed"], 6), r["needs"]) for r in spark.read.parquet(f"{root}/data").collect())
    b = sorted((r["track_id"], r["frame"], round(r["smoothed"], 6), r["active"]) for r in want.collect())
    assert a == b


def test_window_session_and_join_streams_equal_batch(spark):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    stream = streams.event_stream(spark, SF).withWatermark("event_time", "0 seconds")
    batch = adapters.load(spark, SF, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_time"), F.round(F.col("value") * 60000).cast("bigint").alias("service_ns"),
        (F.col("value") / 16 > 8).alias("missed"), (F.col("event_type") == "error").alias("rejected"),
    )
    last = batch.agg(F.max("event_time")).first()[0]
    root = folder()
    monitors.run_available(monitors.activity_sessions(stream, ["run_id"], "4 hours"), root)
    got = spark.read.parquet(f"{root}/data")
    want = monitors.activity_sessions(batch, ["run_id"], "4 hours").filter(F.col("session_end") <= F.lit(last))
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    root = folder()
    results = streams.event_stream(spark, SF).filter(~F.col("rejected")).select("run_id", "seq", (F.col("event_time") + F.expr("INTERVAL 1 SECOND")).alias("result_time")).withWatermark("result_time", "0 seconds")
    monitors.run_available(monitors.presentation_join(stream, results, "5 SECONDS"), root)
    joined = spark.read.parquet(f"{root}/data")
    assert joined.filter("result_time is not null").count() == batch.filter(~F.col("rejected")).count()
    assert joined.join(batch.filter(~F.col("rejected")), ["run_id", "seq"], "left_anti").filter("result_time is not null").isEmpty()
    root = folder()
    monitors.run_available(monitors.progress_counts(stream.select((~F.col("rejected")).alias("ok"))), root, "update", lambda d, i: d.write.mode("append").parquet(f"{root}/out"))
    assert spark.read.parquet(f"{root}/out").groupBy("ok").agg(F.max("receipts").alias("n")).agg(F.sum("n")).first()[0] == batch.count()


def test_publish_is_atomic_versioned_and_checked(spark):
    root = folder()
    df = spark.createDataFrame([(1, "t", "c", "train"), (2, "u", "c", "test")], "row_id int, track_id string, corpus string, split string")
    clean = lambda d: d.filter("row_id < 0")
    target = manifests.publish_dataset(df, root, "c", {"seed": 1}, clean)
    assert spark.read.parquet(f"{target}/rows").count() == 2
    with pytest.raises(FileExistsError):
        manifests.publish_dataset(df, root, "c", {"seed": 1}, clean)
    assert manifests.publish_dataset(df, root, "c", {"seed": 1}, clean, reuse=True) == target
    with pytest.raises(ValueError, match="breaks a rule"):
        manifests.publish_dataset(df, root, "c", {"seed": 2}, lambda d: d.filter("row_id = 2"))
    with pytest.raises(ValueError, match="outside"):
        manifests.publish_dataset(df, root, "d", {"seed": 1}, clean)
    import os
    assert sorted(os.listdir(root)) == [os.path.basename(target)]
    with pytest.raises(ValueError, match="non-finite"):
        manifests.write_report(spark.createDataFrame([(float("nan"),)], "x double"), f"{root}/report")


def test_pcm_container_is_strict(spark):
    root = folder()
    good = struct.pack("<4sIHHQ", b"SXA1", 44100, 2, 0, 3) + struct.pack("<6f", 1, 2, 3, 4, 5, 6)
    cases = {"good": good, "short": good[:10], "magic": b"XXXX" + good[4:], "rate": struct.pack("<4sIHHQ", b"SXA1", 8000, 1, 0, 0), "cut": good[:-4],
             "nan": struct.pack("<4sIHHQ", b"SXA1", 48000, 1, 0, 1) + struct.pack("<f", float("inf"))}
    for name, data in cases.items():
        with open(f"{root}/{name}.sxa", "wb") as handle:
            handle.write(data)
    rows = files.read_pcm(spark, root, chunk=2).collect()
    ok = sorted((r["channel"], r["chunk_id"], list(r["samples"])) for r in rows if r["error"] is None)
    assert ok == [(0, 0, [1.0, 3.0]), (0, 1, [5.0]), (1, 0, [2.0, 4.0]), (1, 1, [6.0])]
    assert len([r for r in rows if r["error"]]) == 5
    assert files.scan_directory(spark, root, ("sxa",)).count() == 6


def test_manifest_lines_and_pages(spark):
    root = folder()
    with open(f"{root}/manifest.jsonl", "w") as handle:
        handle.write(json.dumps({"row_id": 1, "track": "a"}) + "\n\n{broken\n[1, 2]\n" + json.dumps({"row_id": 2}) + "\n")
    rows, bad = manifests.read_manifest(spark, root, "row_id bigint, track string")
    assert sorted(r["row_id"] for r in rows.collect()) == [1, 2] and bad.count() == 2
    assert manifests.scan_history(spark, root, "row_id bigint, track string").filter("row_id is not null").count() == 2
    html = "<dl><dt>Title</dt><dd>Song <b>One</b></dd><script><dd>no</dd></script><dt>Owner</dt><dd> Ann (works 12) </dd></dl>"
    df = spark.createDataFrame([(1, html), (2, html.replace("</dl>", "<dd>Bob</dd></dl>")), (3, "<p>none</p>")], "id bigint, html string")
    out = pages.publisher_fields(pages.page_fields(df, "id", "html"), F.lit("Song One"), "Title", "Owner").orderBy("id").collect()
    assert [(r["rights_owner"], r["reason"]) for r in out] == [("Ann", None), (None, "owner is missing or ambiguous"), (None, "title does not match")]
