"""Speech segments from frame levels, quality of clips, and batches by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import scoring
from . import scans
from .intervals import interval_join, merge_intervals
from .quiet import Pauses, quiet_parts


def noise_threshold(frames: DataFrame, key: str, quantile: float = 0.2, margin_db: float = 6.0, low: float = -60.0, high: float = -20.0) -> DataFrame:
    """key, threshold: a quantile of the frame levels plus a margin, within bounds."""
    level = F.percentile("rms_dbfs", F.lit(quantile)) + margin_db
    return frames.groupBy(key).agg(F.least(F.greatest(level, F.lit(low)), F.lit(high)).alias("threshold"))


def speech_runs(frames: DataFrame, key: str, hop_ms: int = 10, min_silence_ms: int = 300, min_speech_ms: int = 250, pad_ms: int = 100, merge_gap_ms: int = 200) -> DataFrame:
    """Stretches of speech (key, start_ms, end_ms, parts): frames at the threshold or above, enclosed silences of up to ``min_silence_ms`` bridged,
    runs shorter than ``min_speech_ms`` dropped, the rest padded within the recording and joined over small gaps.

    ``frames``: key, frame, rms_dbfs. Runs are islands of frame numbers, scanned in slices, so no recording is gathered.
    """
    bridge, at = min_silence_ms // hop_ms, scans.time_levels("frame", (65_536, 2_048))
    loud = frames.join(noise_threshold(frames, key), key).filter("rms_dbfs >= threshold").select(key, "frame")
    runs = scans.neighbours(loud, [key], at, ["frame"], before=["frame"])
    runs = runs.withColumn("_f", F.when(F.col("frame") - F.col("prev_frame") - 1 <= bridge, 0).otherwise(1))
    runs = scans.running(runs, [key], at, ["frame"], {"run": F.col("_f")}, "sum").withColumn("run", F.coalesce("run", F.lit(0)) + F.col("_f"))
    speech = runs.groupBy(key, "run").agg((F.min("frame") * hop_ms).alias("s"), ((F.max("frame") + 1) * hop_ms).alias("e")).filter(F.col("e") - F.col("s") >= min_speech_ms)
    ends = frames.groupBy(key).agg(((F.max("frame") + 1) * hop_ms).alias("limit"))
    padded = speech.join(ends, key).select(key, F.greatest(F.lit(0), F.col("s") - pad_ms).cast("long").alias("start_ms"), F.least("limit", F.col("e") + pad_ms).cast("long").alias("end_ms"))
    return merge_intervals(padded, [key], merge_gap_ms)


def energy_vad(frames: DataFrame, key: str, hop_ms: int = 10, min_silence_ms: int = 300, min_speech_ms: int = 250, pad_ms: int = 100, merge_gap_ms: int = 200, pauses: Pauses = Pauses(), pause_ms: float = 180, penalty_db: float = 1.5) -> DataFrame:
    """Speech segments: key, start_ms, end_ms, part, mean_dbfs, peak_dbfs and is_last (of its recording).

    ``speech_runs``, of which those longer than ``pauses.most_ms`` are cut at sustained pauses (``part`` numbers the pieces of one run). Levels are of
    the frames that a segment touches. ``frames``: key, frame, rms_dbfs and, where there, peak_dbfs.
    """
    runs = speech_runs(frames, key, hop_ms, min_silence_ms, min_speech_ms, pad_ms, merge_gap_ms).select(key, "start_ms", "end_ms")
    own = runs.withColumn("_long", F.col("end_ms") - F.col("start_ms") > pauses.most_ms)
    spans = own.filter("_long").select(F.struct(key, "start_ms").alias("span_id"), F.col(key).alias("video_id"), "start_ms", "end_ms")
    levels = frames.select(F.col(key).alias("video_id"), (F.col("frame") * hop_ms).alias("at_ms"), F.col("rms_dbfs").alias("db"))
    cut = quiet_parts(spans, levels, pauses, pause_ms, penalty_db).select(F.col(f"span_id.{key}").alias(key), "start_ms", "end_ms", "part")
    segments = own.filter("not _long").select(key, "start_ms", "end_ms", F.lit(0).cast("long").alias("part")).unionByName(cut)
    peak = F.col("peak_dbfs") if "peak_dbfs" in frames.columns else F.col("rms_dbfs")
    heard = frames.select(key, (F.col("frame") * hop_ms).alias("start_ms"), ((F.col("frame") + 1) * hop_ms).alias("end_ms"), "rms_dbfs", peak.alias("peak"))
    hits = interval_join(segments, heard, key)
    told = hits.groupBy(F.col(f"l_{key}").alias("_key"), F.col("l_start_ms").alias("_start")).agg(F.round(F.avg("r_rms_dbfs"), 3).alias("mean_dbfs"), F.round(F.max("r_peak"), 3).alias("peak_dbfs"))
    last = segments.groupBy(F.col(key).alias("_of")).agg(F.max("start_ms").alias("_last"))
    out = segments.join(told, (F.col(key) == F.col("_key")) & (F.col("start_ms") == F.col("_start")), "left").join(last, F.col(key) == F.col("_of"))
    return out.select(key, "start_ms", "end_ms", "part", "mean_dbfs", "peak_dbfs", (F.col("start_ms") == F.col("_last")).alias("is_last"))


def audio_quality(clips: DataFrame, key: str = "item_id") -> DataFrame:
    """key, reasons, clipped_ratio, snr_db of clips with ``rate`` and ``samples`` (-1 to 1).

    ``clipping_detected``: over 1 % of samples at full scale, or a run of them over 3 ms. ``low_snr_detected``: for
    clips of a second or more, the 0.9 and 0.2 quantiles of 30 ms levels lie less than 8 dB apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, rate, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = np.asarray(held.values.to_numpy(), float) if held.is_valid else np.zeros(0)
                full = np.abs(x) >= 0.999
                edge = np.flatnonzero(np.diff(np.concatenate([[0], full.astype(int), [0]])))
                longest = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
                ratio = float(full.mean()) if len(x) else 0.0
                hop = max(1, (rate or 1000) * 30 // 1000)
                n = len(x) // hop
                level = 10 * np.log10(np.maximum((x[: n * hop].reshape(n, hop) ** 2).mean(1), 1e-12)) if n else np.zeros(1)
                snr = float(np.quantile(level, 0.9) - np.quantile(level, 0.2))
                reasons = [r for r, bad in (("clipping_detected", ratio > 0.01 or longest > 3 * (rate or 1000) / 1000), ("low_snr_detected", len(x) >= (rate or 1000) and snr < 8)) if bad]
                out.append((name, reasons, ratio, snr))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.string()), pa.float64(), pa.float64()))], names=[key, "reasons", "clipped_ratio", "snr_db"])

    return clips.select(F.col(key).cast("string").alias(key), "rate", "samples").mapInArrow(run, f"`{key}` string, reasons array<string>, clipped_ratio double, snr_db double")


def duration_batches(df: DataFrame, budget: float, seconds: str = "seconds", mode: str = "mode", id_column: str = "item_id", slices: int = 1) -> DataFrame:
    """``batch`` of each row: rows of a mode in order of falling length go to the open batch while it stays within ``budget`` seconds.

    A row longer than the budget is a batch alone, and doesn't close the open one. The order is Spark's sort, and rows are read
    one after the other with the open batch's sum alone kept. A mode is one task; with ``slices`` its lengths are cut into as many ranges,
    each packed by itself, so that a batch at a border may be less full than in one pass.
    """
    rows = df.withColumn("_slice", F.lit(0))
    if slices > 1:
        top = df.groupBy(mode).agg(F.max(seconds).alias("_top"))
        cut = F.least(F.floor(F.col(seconds) / F.greatest("_top", F.lit(1e-9)) * slices), F.lit(slices - 1)).cast("int")
        rows = df.join(F.broadcast(top), mode).withColumn("_slice", cut).drop("_top")  # a row for each mode
    schema = StructType([*df.schema.fields, StructField("batch", StringType())])
    names, kept = [mode, "_slice", seconds], df.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, used = None, 0, 0.0
        for batch in batches:
            out = []
            for m, part, s in zip(*(batch.column(n).to_pylist() for n in names)):
                if (m, part) != now:
                    now, at, used, alone = (m, part), 0, 0.0, 0
                if s > budget:
                    out.append(f"{m}-{part}-alone-{alone}")
                    alone += 1
                    continue
                if used + s > budget:
                    at, used = at + 1, 0.0
                used += s
                out.append(f"{m}-{part}-{at}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, "batch"])

    return rows.repartition(mode, "_slice").sortWithinPartitions(mode, "_slice", F.col(seconds).desc(), id_column).mapInArrow(pack, schema)


def mix_noise(clips: DataFrame, noise: DataFrame, tokens_per_second: float = 25.0, seed: int = 42, low_db: float = 5.0, high_db: float = 15.0, least: float = 0.1, most: float = 0.3) -> DataFrame:
    """``samples`` of each clip with noise on its first part, ``snr_db``, ``noise_id`` and ``clean_from``, the first token behind the noise.

    ``clips``: item_id, rate, samples. ``noise``: noise_id, samples, numbered by id; a clip takes the one that its digest names, from
    a place that it names too, repeated if it's short. The part is ``least`` to ``most`` of the clip, the ratio ``low_db`` to ``high_db``.
    """
    total = noise.count()
    if not total:
        return clips.withColumns({"snr_db": F.lit(None).cast("double"), "noise_id": F.lit(None).cast("string"), "clean_from": F.lit(0)})
    drawn = lambda what: scoring.u64_of(F.concat(F.lit(f"{what}:{seed}:"), F.col("item_id").cast("string"))).cast("double") / float(1 << 64)
    pick = (scoring.u64_of(F.concat(F.lit(f"noise:{seed}:"), F.col("item_id").cast("string"))) % F.lit(total).cast("decimal(20,0)")).cast("long")
    from .pairing import numbered

    side = numbered(noise, F.sha2(F.col("noise_id").cast("string"), 256), "noise_id").select("rn", F.col("noise_id").cast("string").alias("noise_id"), F.col("samples").alias("_noise"))
    rows = clips.withColumns({"_pick": pick, "_part": least + (most - least) * drawn("part"), "snr_db": low_db + (high_db - low_db) * drawn("snr"), "_from": drawn("from")}).join(side, F.col("_pick") == F.col("rn"))
    out = StructType([*clips.schema.fields, StructField("snr_db", DoubleType()), StructField("noise_id", StringType()), StructField("clean_from", IntegerType())])

    kept, named = clips.columns, out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed, clean = [], []
            for rate, x, n, part, snr, begin in zip(*(batch.column(c).to_pylist() for c in ("rate", "samples", "_noise", "_part", "snr_db", "_from"))):
                x, n = np.array(x or [], float), np.array(n or [], float)
                k = int(len(x) * part)
                if k and len(n) and n.any():
                    cut = np.resize(np.roll(n, -int(begin * len(n))), k)
                    scale = np.sqrt((x[:k] ** 2).mean() / max((cut**2).mean(), 1e-12) / 10 ** (snr / 10))
                    x[:k] += scale * cut
                mixed.append(np.clip(x, -1.0, 1.0).tolist())
                clean.append(int(np.ceil(k / max(rate or 1, 1) * tokens_per_second)))
            cols = [pa.array(mixed, pa.list_(pa.float32())).cast(batch.schema.field("samples").type) if c == "samples" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, batch.column("snr_db"), batch.column("noise_id"), pa.array(clean, pa.int32())], names=named)

    return rows.select(*clips.columns, "snr_db", "noise_id", "_noise", "_part", "_from").mapInArrow(run, out)
