"""Registered queries of the streaming jobs: each is run over the events that are there, to the end, and gives what has been closed by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..streaming import jobs
from .catalog import query

#: What a stream over all events has closed: windows that end at or before the last event less the delay.
_CLOSED = "e as (select event_id, user_id, event_type, value, ts, max(ts) over () as last from events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of the files of a folder; the given table is one file, so it's dealt into a few first."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = scratch.new_path(spark, "event-files")
    batch.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(folder)
    return jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=100)


def _run(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    return jobs.run_into(df, scratch.new_path(spark, name), scratch.new_path(spark, f"{name}-checkpoint"))


@query(f"with {_CLOSED} select time_bucket(interval '1 day', ts::timestamp) as start, event_type, count(*) as n, count(*) filter (value > 50) as high from e group by 1, 2 having start + interval '1 day' <= max(last::timestamp) - interval '1 hour'")
def stream_run_counters(spark, sf_dir):
    return _run(spark, jobs.stream_run_counters(_events(spark, sf_dir)), "run-counters").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""with {_CLOSED}, w as (select time_bucket(interval '5 minutes', ts::timestamp) - interval '5 minutes' * k as start, value, last from e, range(0, 2) t(k))
select start, max(value) as most, max(value) >= 90 as detected from w group by 1 having start + interval '10 minutes' <= max(last::timestamp) - interval '1 hour'""")
def stream_music_windows(spark, sf_dir):
    return _run(spark, jobs.stream_music_windows(_events(spark, sf_dir), 90.0), "music-windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""with {_CLOSED}, g as (select *, case when ts::timestamp - lag(ts::timestamp) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as f from e), s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts::timestamp) as start, max(ts::timestamp) + interval '6 hours' as "end", count(*) as n from s group by user_id, k having max(ts::timestamp) + interval '6 hours' <= max(last::timestamp) - interval '1 hour'""")
def stream_speech_sessions(spark, sf_dir):
    out = _run(spark, jobs.stream_speech_sessions(_events(spark, sf_dir)), "speech-sessions")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
