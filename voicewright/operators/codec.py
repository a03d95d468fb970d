"""Acoustic tokens of training pairs: their checks, masks, shards, and rates of their making."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .pairing import numbered

#: Label of places that aren't supervised.
IGNORED = -100


def validate_codec_rows(channels: int = 8, vocabulary: int = 1024) -> Column:
    """First failing rule of a pair, or null: audio_path, prompt_audio_path, text, prompt_text, audio_sha256, prompt_audio_sha256, duration, prompt_duration (seconds), target_tokens, prompt_tokens (a row for each codebook)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    def matrix(c: str) -> Column:
        frames = F.size(F.get(c, F.lit(0)))
        return (F.size(c) == channels) & (frames > 0) & F.forall(c, lambda row: (F.size(row) == frames) & F.forall(row, lambda v: v.isNotNull() & (v >= 0) & (v < vocabulary)))

    fine = lambda c: F.coalesce(matrix(c), F.lit(False))
    within = lambda c, low, high: F.coalesce(F.col(c).between(low, high), F.lit(False))
    return (
        F.when(blank("audio_path") | blank("prompt_audio_path") | blank("text") | blank("prompt_text"), "needs_explicit_target_and_reference")
        .when(F.col("audio_sha256") == F.col("prompt_audio_sha256"), "target_and_reference_same_audio")
        .when(~within("duration", 0.4, 20.0), "target_duration_out_of_range")
        .when(~within("prompt_duration", 1.0, 10.0), "prompt_duration_out_of_range")
        .when(~fine("target_tokens"), "invalid_target_tokens")
        .when(~fine("prompt_tokens"), "invalid_prompt_tokens")
    )


def _uniform(key: Column) -> Column:
    """In [0, 1), from a digest, so that a row's draw depends on its id and the seed alone."""
    return scoring.u64_of(key).cast("double") / F.lit(float(1 << 64))


def mask_targets(df: DataFrame, mask_id: int, seed: int, low: float = 0.0, high: float = 1.0, drop: float = 0.1, id_column: str = "id", tokens: str = "target_tokens") -> DataFrame:
    """``inputs`` (masked places hold ``mask_id``) and ``labels`` (other places are not supervised) of each row's target tokens, ``ratio`` and ``condition_dropped``.

    Each row draws its ratio in [low, high), each place against it. The prompt is never supervised: it has no labels here.
    """
    name = lambda what: F.concat_ws(":", F.lit(what), F.lit(str(seed)), F.col(id_column).cast("string"))
    rows = df.withColumn("ratio", low + (high - low) * _uniform(name("ratio"))).withColumn("condition_dropped", _uniform(name("drop")) < drop)
    drawn = F.transform(tokens, lambda row, k: F.transform(row, lambda v, i: F.struct(v.alias("v"), (_uniform(F.concat_ws(":", name("mask"), k.cast("string"), i.cast("string"))) < F.col("ratio")).alias("m"))))
    rows = rows.withColumn("_drawn", drawn)
    pick = lambda masked, other: F.transform("_drawn", lambda row: F.transform(row, lambda x: F.when(x["m"], masked(x)).otherwise(other(x))))
    token = lambda x: x["v"].cast("int")
    return rows.withColumn("inputs", pick(lambda x: F.lit(mask_id), token)).withColumn("labels", pick(token, lambda x: F.lit(IGNORED))).drop("_drawn")


def write_token_shards(results: DataFrame, size: int, seed: int = 42, skip_errors: bool = True, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Successes with ``shard`` (``size`` to a shard but for the last, in a seeded order), and failures with their reason (``error_msg``).

    A shard is full of successes, as failures take no place. Without ``skip_errors`` a failure raises when it's read.
    """
    good = results.filter("status = 'success'")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    shards = numbered(good, digest, id_column).withColumn("shard", F.floor(F.col("rn") / size)).drop("rn")
    bad = results.filter(~F.coalesce(F.col("status") == "success", F.lit(False))).select(F.col(id_column), F.col("error_msg").alias("reason"))
    if not skip_errors:
        bad = bad.withColumn("reason", F.raise_error(F.concat_ws(": ", F.col(id_column).cast("string"), "reason")).cast("string"))
    return shards, bad


def rtf_summary(df: DataFrame, keys: list[str], synthesis: str = "synthesis_seconds", audio: str = "audio_seconds") -> DataFrame:
    """Seconds of synthesis and of audio, and their ratio; null where there's no audio."""
    total = df.groupBy(*keys) if keys else df
    out = total.agg(F.sum(synthesis).alias("synthesis_seconds"), F.sum(audio).alias("audio_seconds"))
    return out.withColumn("rtf", F.when(F.col("audio_seconds") > 0, F.col("synthesis_seconds") / F.col("audio_seconds")))
