"""Binary file scans and the strict PCM container."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the PCM container: magic, then rate, channels, flags, frames (little endian).
MAGIC = b"SXA1"
HEADER = "<4sIHHQ"
HEADER_BYTES = 20
LOSSLESS_EXTENSIONS = ("wav", "flac", "aif", "aiff", "w64", "caf", "rf64")


def scan_directory(spark: SparkSession, root: str, extensions: Sequence[str] = LOSSLESS_EXTENSIONS) -> DataFrame:
    """``path, length, modified`` of all matching files below ``root``; contents are not read."""
    glob = "*.{" + ",".join(x for e in extensions for x in (e, e.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def file_digests(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, sha256, bytes`` of the files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def _decode(content: bytes) -> tuple[int, int, np.ndarray] | str:
    if len(content) < HEADER_BYTES:
        return "truncated header"
    magic, rate, channels, flags, frames = struct.unpack_from(HEADER, content)
    if magic != MAGIC or flags != 0:
        return "invalid magic or flags"
    if rate not in (44100, 48000) or channels not in (1, 2):
        return "unsupported sample rate or channel count"
    if len(content) != HEADER_BYTES + frames * channels * 4:
        return "payload length does not match header"
    audio = np.frombuffer(content, dtype="<f4", offset=HEADER_BYTES).reshape(frames, channels)
    return (rate, channels, audio) if np.isfinite(audio).all() else "non-finite samples"


def decode_pcm(files: DataFrame, chunk: int = 65536) -> DataFrame:
    """``path, content`` to ``path, sample_rate, channel, chunk_id, samples, error``.

    One row per channel and chunk; a rejected file gives one row with ``error``.
    """
    def decode(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                got = _decode(bytes(content))
                if isinstance(got, str):
                    yield pd.DataFrame([(path, None, None, None, None, got)], columns=names)
                    continue
                rate, channels, audio = got
                rows = [(path, rate, c, k, audio[k * chunk : (k + 1) * chunk, c].tolist(), None) for c in range(channels) for k in range(-(-len(audio) // chunk))]
                yield pd.DataFrame(rows, columns=names)

    names = ["path", "sample_rate", "channel", "chunk_id", "samples", "error"]
    return files.select("path", "content").mapInPandas(decode, "path string, sample_rate int, channel int, chunk_id bigint, samples array<float>, error string")


def read_pcm(spark: SparkSession, path: str, chunk: int = 65536) -> DataFrame:
    """Chunk rows of all PCM files below a path."""
    return decode_pcm(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), chunk)


def encode_pcm(df: DataFrame, samples: str, sample_rate: int) -> DataFrame:
    """Adds ``content``: a mono container of each sample array."""
    @F.pandas_udf("binary")
    def pack(series: pd.Series) -> pd.Series:
        return series.map(lambda v: struct.pack(HEADER, MAGIC, sample_rate, 1, 0, len(v)) + np.asarray(v, dtype="<f4").tobytes())

    return df.withColumn("content", pack(samples))
