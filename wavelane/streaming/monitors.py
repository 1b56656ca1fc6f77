"""Health monitors over hop events: the same functions serve batch tables and streams.

Event time must be a timestamp with time zone (``event_timestamp`` casts). On streams add a
watermark first; windows and sessions then close on their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelane.functions.ordinals import block, null_safe_join, running_extreme, with_halo
from wavelane.operators import sequence
from wavelane.operators.aggregates import count_if

# Latency histogram geometry.
BIN_NS = 25_000
BINS = 128


def event_timestamp(df: DataFrame, column: str = "event_time") -> DataFrame:
    """Zone-less event times as UTC timestamps, which watermarks accept."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def gap_reset(df: DataFrame, keys: list[str], seq: str, warmup: int, idle_us: int | None = None, event_time: str = "event_time") -> DataFrame:
    """Adds ``reset`` (sequence not contiguous, or idle for longer than ``idle_us``) and ``warming`` (within ``warmup`` rows of a reset).

    The first row of a run is a reset. Sequences may be sparse; a block keeps its last possible
    predecessor as a halo row.
    """
    w = Window.partitionBy(*keys, "_block").orderBy(seq)
    follows = F.lag(seq).over(w) == F.col(seq) - 1
    if idle_us is not None:
        follows &= F.unix_micros(event_time) - F.lag(F.unix_micros(event_time)).over(w) <= idle_us
    seen = with_halo(df, seq, 1).withColumn("_p", follows).filter(~F.col("_halo")).drop("_block", "_halo")
    flagged = seen.withColumn("reset", ~F.coalesce(F.col("_p"), F.lit(False))).drop("_p")
    last = running_extreme(flagged, keys, [seq], F.when(F.col("reset"), F.col(seq)), "_r", block(seq), strict=False)
    return last.withColumn("warming", F.col(seq) - F.col("_r") < warmup).drop("_r")


def drop_late(df: DataFrame, keys: list[str], arrival: str, seq: str, allowed: int) -> DataFrame:
    """Adds ``late``: the result arrives when a later sequence beyond the allowance was presented.

    Batch form of a watermark: the presented sequence is the running maximum in arrival order.
    """
    shown = running_extreme(df, keys, [arrival], F.col(seq), "_m", block(arrival))
    return shown.withColumn("late", F.coalesce(F.col(seq) + allowed <= F.col("_m"), F.lit(False))).drop("_m")


def latest_only(df: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str]) -> DataFrame:
    """Newest row per key and the number of discarded older ones."""
    g = df.groupBy(*keys).agg(F.max_by(F.struct(seq, *columns), seq).alias("_r"), (F.count(F.lit(1)) - 1).alias("discarded"))
    return g.select(*keys, "_r.*", "discarded")


def health_counters(df: DataFrame, keys: Sequence[str], width: str, event_time: str = "event_time") -> DataFrame:
    """Per tumbling window: accepted, missed, rejected and total hops, first and last sequence."""
    return df.groupBy(*keys, F.window(event_time, width).alias("_w")).agg(
        F.count(F.lit(1)).alias("hops"), count_if(~F.col("missed") & ~F.col("rejected")).alias("accepted"), count_if(F.col("missed")).alias("misses"),
        count_if(F.col("rejected")).alias("rejected"), F.max("service_ns").alias("max_service_ns"), F.max("seq").alias("last_seq"),
    ).select(*keys, F.col("_w.start").alias("window_start"), "hops", "accepted", "misses", "rejected", "max_service_ns", "last_seq")


def window_streaks(df: DataFrame, keys: list[str], seq: str, width: str, event_time: str = "event_time") -> DataFrame:
    """Longest miss streak that ends inside each window (batch form); runs may begin at any sequence."""
    d = df.withColumn("_gap_src", F.when(~F.col("missed"), F.col(seq)))
    gap = running_extreme(d, keys, [seq], F.col("_gap_src"), "_g", block(seq))
    begun = df.groupBy(*keys).agg((F.min(seq) - 1).alias("_b"))
    gap = null_safe_join(gap, begun, list(keys))
    run = F.when(F.col("missed"), F.col(seq) - F.coalesce("_g", "_b")).otherwise(0)
    return gap.groupBy(*keys, F.window(event_time, width).alias("_w")).agg(F.max(run).alias("max_streak")).select(*keys, F.col("_w.start").alias("window_start"), "max_streak")


def latency_bins(df: DataFrame, keys: Sequence[str], service: str = "service_ns") -> DataFrame:
    """Histogram rows ``keys, bin, hops, max_ns``: 128 bins of 25 us, the last one open."""
    b = F.least(F.lit(BINS - 1), F.floor((F.greatest(F.col(service), F.lit(1)) - 1) / BIN_NS))
    return df.groupBy(*keys, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("hops"), F.max(service).alias("max_ns"))


def histogram_p99(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nearest-rank p99 upper bound: the bin edge, capped by the maximum; the open bin gives the maximum."""
    up = Window.partitionBy(*keys).orderBy("bin")
    all_ = Window.partitionBy(*keys)
    c = bins.withColumn("_c", F.sum("hops").over(up)).withColumn("_n", F.sum("hops").over(all_)).withColumn("_m", F.max("max_ns").over(all_))
    hit = c.filter((F.col("_c") >= F.col("_n") - F.floor(F.col("_n") / 100)))
    first = hit.groupBy(*keys).agg(F.min("bin").alias("bin"), F.max("_n").alias("hops"), F.max("_m").alias("max_ns"))
    edge = F.when(F.col("bin") == BINS - 1, F.col("max_ns")).otherwise(F.least((F.col("bin") + 1).cast("bigint") * BIN_NS, F.col("max_ns")))
    return first.select(*keys, "hops", "max_ns", edge.alias("p99_upper_ns"))


def sanitize(df: DataFrame, keys: list[str], ordinal: str, value: str) -> DataFrame:
    """Clamp to +-1; a non-finite sample holds 0.99 x the last value. Adds ``clean`` and ``invalid``.

    k bad samples in a row give 0.99^k x the last good one, so the held value is closed form.
    """
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    good = F.when(~bad, F.struct(F.col(ordinal).alias("o"), F.least(F.greatest(F.col(value), F.lit(-1.0)), F.lit(1.0)).alias("v")))
    last = running_extreme(df, keys, [ordinal], good, "_l", block(ordinal), strict=False)
    held = F.when(F.col("_l").isNull(), 0.0).otherwise(F.col("_l.v") * F.pow(F.lit(0.99), F.col(ordinal) - F.col("_l.o")))
    return last.withColumn("clean", held).withColumn("invalid", bad).drop("_l")


def healthy_gate(df: DataFrame, keys: list[str], seq: str, ready: Column, silent: Column) -> DataFrame:
    """Adds ``enhance``: this hop and the hop of the sequence before are ready, and the hop is not silent."""
    w = Window.partitionBy(*keys, "_block").orderBy(seq)
    before = F.coalesce(F.lag("_r").over(w) & (F.lag(seq).over(w) == F.col(seq) - 1), F.lit(False))
    out = with_halo(df.withColumn("_r", F.coalesce(ready, F.lit(False))), seq, 1).withColumn("_q", before)
    return out.filter(~F.col("_halo")).withColumn("enhance", F.col("_r") & F.col("_q") & ~F.coalesce(silent, F.lit(False))).drop("_block", "_halo", "_r", "_q")


#: Counters of a window beside its longest miss streak.
COUNTERS = ("hops", "accepted", "misses", "stale", "invalid", "rejected", "overflow")


def miss_streak(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Adds ``streak``: misses in a row up to each hop; runs may begin at any sequence."""
    gap = running_extreme(df, keys, [seq], F.when(~F.col("missed"), F.col(seq)), "_g", block(seq))
    begun = df.groupBy(*keys).agg((F.min(seq) - 1).alias("_b"))
    out = null_safe_join(gap, begun, list(keys))
    return out.withColumn("streak", F.when(F.col("missed"), F.col(seq) - F.coalesce("_g", "_b")).otherwise(0)).drop("_g", "_b")


def full_counters(df: DataFrame, keys: Sequence[str], width: str, event_time: str = "event_time") -> DataFrame:
    """Per window: all counters and ``max_streak``, from ``missed, rejected, stale, overflow``, ``invalid`` samples and ``streak``.

    The rows of two parts of a stream merge with ``merged_counters``.
    """
    return df.groupBy(*keys, F.window(event_time, width).alias("_w")).agg(
        F.count(F.lit(1)).alias("hops"), count_if(~F.col("missed") & ~F.col("rejected")).alias("accepted"), count_if(F.col("missed")).alias("misses"), count_if(F.col("stale")).alias("stale"),
        F.sum("invalid").alias("invalid"), count_if(F.col("rejected")).alias("rejected"), count_if(F.col("overflow")).alias("overflow"), F.max("streak").alias("max_streak"),
    ).select(*keys, F.col("_w.start").alias("window_start"), *COUNTERS, "max_streak")


def merged_counters(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a window from the counters of its parts."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("max_streak").alias("max_streak"))


def merged_bins(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latency histogram rows from those of parts of a stream."""
    return parts.groupBy(*keys, "bin").agg(F.sum("hops").alias("hops"), F.max("max_ns").alias("max_ns"))


def activity_sessions(df: DataFrame, keys: Sequence[str], gap: str, event_time: str = "event_time") -> DataFrame:
    """Contiguous active spans: events closer than ``gap`` share a session."""
    g = df.groupBy(*keys, F.session_window(event_time, gap).alias("_s")).agg(F.count(F.lit(1)).alias("events"))
    return g.select(*keys, F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), "events")


def acquisition_progress(plan: DataFrame, receipts: DataFrame, target: int) -> DataFrame:
    """One row: total, completed, errors, unresolved, finished and target_reached (distinct ids)."""
    state = receipts.groupBy("id").agg(F.bool_or(F.col("ok")).alias("done"), F.bool_or(~F.col("ok")).alias("error"))
    joined = plan.select("id").distinct().join(state, "id", "left")
    done, error = F.coalesce(F.col("done"), F.lit(False)), F.coalesce(F.col("error"), F.lit(False))
    s = joined.agg(F.count(F.lit(1)).alias("total"), count_if(done).alias("completed"), count_if(error & ~done).alias("errors"), count_if(~done).alias("unresolved"))
    return s.withColumn("finished", F.col("completed") + F.col("errors") >= F.col("total")).withColumn("target_reached", F.col("completed") >= target)


def progress_counts(receipts: DataFrame) -> DataFrame:
    """Streaming counts of receipts by outcome (update mode)."""
    return receipts.groupBy("ok").agg(F.count(F.lit(1)).alias("receipts"))


def slo_windows(counters: DataFrame, latency: DataFrame, keys: Sequence[str], rate: int, assess: Callable[..., DataFrame]) -> DataFrame:
    """Policy assessment per window from counters and the latency histogram bound."""
    both = null_safe_join(counters, latency, list(keys))
    stats = (both if "invalid" in both.columns else both.withColumn("invalid", F.lit(0))).withColumn("failed", F.lit(False))
    return assess(stats, F.lit(rate), F.col("p99_upper_ns") / 1000.0, F.col("max_ns") / 1000.0)


def presentation_join(inputs: DataFrame, results: DataFrame, deadline: str) -> DataFrame:
    """Stream-stream left outer join: a hop meets its result only within ``deadline`` of its event.

    Both sides need watermarks. Unmatched hops come out with NULL ``result_time`` once the
    watermark passes: the dry fallback.
    """
    i = inputs.select("run_id", "seq", "event_time").alias("i")
    r = results.select("run_id", F.col("seq").alias("result_seq"), "result_time").alias("r")
    condition = (
        (F.col("i.run_id") == F.col("r.run_id")) & (F.col("i.seq") == F.col("r.result_seq"))
        & (F.col("r.result_time") >= F.col("i.event_time")) & (F.col("r.result_time") <= F.col("i.event_time") + F.expr(f"INTERVAL {deadline}"))
    )
    return i.join(r, condition, "left_outer").select("i.run_id", "i.seq", "i.event_time", "r.result_time")


class BatchSink:
    """Tables in which each micro-batch of one query owns a folder: a batch that is written again replaces itself."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def put(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def slo_writer(sink: BatchSink, keys: Sequence[str], width: str, event_time: str = "event_time") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: the batch's counters and latency histogram per window."""

    def write(hops: DataFrame, batch: int) -> None:
        held = hops.is_cached
        hops.persist()  # else each table would run the batch's state processors again
        try:
            windowed = hops.withColumn("window_start", F.window(event_time, width)["start"])
            sink.put("counters", full_counters(hops, keys, width, event_time), batch)
            sink.put("latency", latency_bins(windowed, [*keys, "window_start"]), batch)
        finally:
            if not held:
                hops.unpersist()

    return write


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State in RocksDB, which stateful processors need, until the block ends."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_available(stream: DataFrame, folder: str, mode: str = "append", writer: Callable[[DataFrame, int], None] | None = None):
    """Run a stream over everything available and stop: parquet sink, or ``foreachBatch``."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if writer is None:
        query = out.format("parquet").option("path", f"{folder}/data").start()
    else:
        query = out.foreachBatch(writer).start()
    query.awaitTermination()
    return query
