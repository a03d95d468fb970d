"""Streaming twins of batch jobs. Run over the same files until available ones are done, each gives its batch rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scoring
from ..operators import weighting


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_run_counters(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and flag counts per tumbling window and kind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high")).select(F.col("window.start").alias("start"), "event_type", "n", "high")


def stream_music_windows(frames: DataFrame, threshold: float, late: str = "1 hour") -> DataFrame:
    """Greatest value in sliding windows of 10 minutes every 5, and whether it reaches ``threshold``."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", "10 minutes", "5 minutes")).agg(F.max("value").alias("most")).select(F.col("window.start").alias("start"), "most", (F.col("most") >= threshold).alias("detected"))


def stream_speech_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Bursts of a user whose events are less than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_weight_manifest(primary: DataFrame, results: DataFrame, late: str = "1 hour", wait: str = "1 day", gamma: float = 3.0, w_min: float = 0.1) -> DataFrame:
    """Rows of the stream ``primary`` (id, text, ts) weighed by their first result (ts, id, status, hypothesis, model_id) within ``wait``.

    Later results of an id are dropped. A row whose result hasn't come when the watermark passes is ``secondary_asr_missing``.
    """
    side = results.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"]).select(F.col("id").alias("s_id"), F.col("status").alias("s_status"), F.col("hypothesis").alias("s_hypothesis"), F.col("model_id").alias("s_model_id"), F.col("ts").alias("s_ts"))
    rows = primary.withWatermark("ts", late).select("id", "text", "ts")
    both = rows.join(side, F.expr(f"id = s_id and s_ts >= ts and s_ts <= ts + interval {wait}"), "left_outer")
    none = {c: F.lit(None).cast("string") for c in ("s_error", "s_reference", "s_audio_sha256", "audio_sha256")}
    both = both.withColumns(none | {"s_canonical": F.lit(None).cast("struct<cer:double>"), "s_reference_given": F.lit(False)})
    both = scoring.computed(both, {"_p": scoring.normalize_for_scoring(F.col("text")), "_s": scoring.normalize_for_scoring(F.col("s_hypothesis"))})
    empty = F.when(F.length("_p") == 0, "empty_normalized_primary")
    return weighting.weigh_joined(both, empty, gamma, w_min, "exclude", False, "status").select("id", "ts", "reason", "disagreement", "pseudo_label_weight", "secondary_model")


GROUPS = "video_id long, speaker string, start_ms long, end_ms long, parts int"
_OPEN = "speaker string, start_ms long, end_ms long, parts int, overlapped boolean"


def stream_group_candidates(candidates: DataFrame, late: str = "1 minute", max_duration_ms: int = 15_000, max_gap_ms: int = 700) -> DataFrame:
    """Groups of consecutive candidates of one speaker, as ``group_candidates`` makes them, each when it's closed.

    ``candidates``: video_id, ts (event time), start_ms, end_ms, speaker, overlapped, in order of time but for ``late``. A group is closed by a
    candidate that can't join it, or when the watermark passes its last end by the gap. Rows behind the watermark are left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        now = list(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append((key[0], *now[:4]))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["start_ms", "end_ms"])
            for start, end, speaker, crossed in zip(rows.start_ms, rows.end_ms, rows.speaker, rows.overlapped):
                if now and now[0] == speaker and not now[4] and not crossed and start - now[2] <= max_gap_ms and end - now[1] <= max_duration_ms:
                    now = [speaker, now[1], int(end), now[3] + 1, bool(crossed)]
                    continue
                if now:
                    out.append((key[0], *now[:4]))
                now = [speaker, int(start), int(end), 1, bool(crossed)]
            state.update(tuple(now))
            behind = max(int(rows.ts.max().timestamp() * 1000) + (now[2] - now[1]) + max_gap_ms, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(behind)
        yield pd.DataFrame(out, columns=["video_id", "speaker", "start_ms", "end_ms", "parts"])

    rows = candidates.withWatermark("ts", late).select("video_id", "ts", "start_ms", "end_ms", "speaker", "overlapped")
    return rows.groupBy("video_id").applyInPandasWithState(step, GROUPS, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a query over what is there, into a table in memory (for tests and small counters), and return its rows."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_into(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a query over what is there, into Parquet files (each row once, by the sink's log), and read them."""
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
