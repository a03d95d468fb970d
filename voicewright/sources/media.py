"""Media files: inventory, PCM decoding, clip cutting and frame levels."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings of media.
SUFFIXES = ("mp4", "mov", "mkv", "webm", "m4v", "avi", "wav", "flac", "mp3", "m4a", "ogg", "opus")
FLOOR_DB = -100.0


def discover_media(spark: SparkSession, *paths: str, exclude: str | None = None) -> DataFrame:
    """path, name, length, content of media files below ``paths``, each path once, but not below ``exclude``. Raises if there's none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    found = files.filter(ending.isin(*SUFFIXES)).dropDuplicates(["path"])
    if exclude:
        found = found.filter(~F.contains("path", F.lit(exclude.rstrip("/") + "/")))
    if found.select("path").isEmpty():
        raise ValueError("no supported media files were found")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1)).select("path", "name", "length", "content")


def media_inventory(files: DataFrame) -> DataFrame:
    """path, name, length, sha256, video_id (clean stem and eight digits of the digest); the content goes no further."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", ""), "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    sha = F.sha2("content", 256)
    return files.select("path", "name", "length", sha.alias("sha256"), F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("item")), F.lit("-"), F.substring(sha, 1, 8)).alias("video_id"))


def samples_of(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples (-1 to 1) of a PCM WAV file of 8, 16, 24 or 32 bits; raises on other files."""
    with wave.open(io.BytesIO(content)) as w:
        rate, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(1)


def decode_pcm_wav(files: DataFrame) -> DataFrame:
    """path, rate, duration_ms, samples (array of float), error (null where decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rate, x = samples_of(content or b"")
                    row = [[path], [rate], [round(1000 * len(x) / rate)], [x.astype(np.float32)], [None]]
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    row = [[path], [None], [None], [None], [str(e) or type(e).__name__]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.string()))], names=["path", "rate", "duration_ms", "samples", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, rate int, duration_ms long, samples array<float>, error string")


def cut_clips(audio: DataFrame, items: DataFrame) -> DataFrame:
    """Samples of each item (video_id, item_id, start_ms, end_ms), clamped to the recording. Items go to the audio, not audio to items."""
    spans = items.groupBy("video_id").agg(F.collect_list(F.struct("item_id", "start_ms", "end_ms")).alias("items"))
    both = audio.join(spans, "video_id").select("video_id", "rate", "samples", F.explode("items").alias("i"))
    at = lambda ms: F.greatest(F.lit(0), F.least(F.size("samples"), F.bround(ms * F.col("rate") / 1000).cast("int")))
    start, end = at(F.col("i.start_ms")), at(F.col("i.end_ms"))
    return both.select("video_id", "i.item_id", "rate", F.slice("samples", start + 1, end - start).alias("samples"))


def frame_energy(audio: DataFrame, hop_ms: int = 10, key: str = "path") -> DataFrame:
    """key, frame, start_ms, rms_dbfs, peak_dbfs of each hop; silence is at the floor, the last hop may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rate, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if rate is None or not x.is_valid:
                    continue
                x = np.asarray(x.values.to_numpy(), float)
                hop = max(1, rate * hop_ms // 1000)
                n = -(-len(x) // hop)
                at = np.arange(n) * hop
                power = np.add.reduceat(x * x, at) / np.diff(np.append(at, len(x))) if n else np.zeros(0)
                peak = np.maximum.reduceat(np.abs(x), at) if n else np.zeros(0)
                db = lambda v: np.maximum(FLOOR_DB, 20 * np.log10(np.maximum(v, 1e-12)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), pa.array(np.arange(n) * hop_ms), pa.array(db(np.sqrt(power))), pa.array(db(peak))], names=[key, "frame", "start_ms", "rms_dbfs", "peak_dbfs"])

    return audio.select(F.col(key).cast("string").alias(key), "rate", "samples").mapInArrow(run, f"`{key}` string, frame long, start_ms long, rms_dbfs double, peak_dbfs double")
