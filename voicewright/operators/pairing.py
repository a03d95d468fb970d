"""Reference clips of the same recording and speaker, and the sampling and splitting of training rows."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .. import scratch
from ..functions import scoring
from . import scans


def pair_eligibility(min_seconds: float = 0.4, max_seconds: float = 20.0) -> Column:
    """First failing rule of an accepted clip, or null. An accepted clip without recording, or an eligible one without audio path or digest, raises when it's computed."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    stop = lambda why: F.raise_error(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("?")), F.lit(f": {why}"))).cast("string")
    seconds = F.coalesce("duration_ms", F.lit(0)) / 1000
    return (
        F.when(~F.coalesce("accepted", F.lit(False)), "not_accepted_by_video_pipeline")
        .when(~F.coalesce("speaker_pure", F.lit(True)) | F.col("speaker_id").isNull() | F.lower("speaker_id").isin("", "unknown", "overlap"), "invalid_local_speaker")
        .when(~given("video_id"), stop("video_id is required to scope local speaker labels"))
        .when(F.col("final_text").isNull() | (F.length(F.regexp_replace("final_text", r"[\p{Z}\p{P}\p{S}\p{C}]", "")) == 0), "empty_primary_text")
        .when(F.isnan(seconds) | ~seconds.between(min_seconds, max_seconds), "target_duration_out_of_range")
        .when(~given("audio_path") | ~given("audio_sha256"), stop("final audio_path and audio_sha256 are required"))
    )


def pairing_report(paired: DataFrame) -> DataFrame:
    """One row from the result of ``pair_references`` or of ``pair_eligibility`` (column ``reason``): input, paired and excluded rows, counts by reason."""
    counts = paired.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    why = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), n(F.col("reason").isNull()).alias("paired_rows"), n(F.col("reason").isNotNull()).alias("excluded_rows"), why.alias("exclusion_reasons"))


def run_summary(items: DataFrame, keys: list[str], flags: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Counts of rows and flags and sums of values per key, with subtotals from the right and a grand total (null keys)."""
    return items.rollup(*keys).agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in flags.items()), *(F.sum(c).alias(k) for k, c in (sums or {}).items()))


def duration_bands(spec: str) -> list[tuple[float, float | None]]:
    """Half-open bands of seconds from text such as ``5-10,10-``."""
    bands = []
    for part in spec.split(",") if spec.strip() else []:
        m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)?\s*-\s*(\d+(?:\.\d+)?)?\s*", part)
        low, high = (float(m[1] or 0), float(m[2]) if m[2] else None) if m else (0.0, 0.0)
        if high is not None and high <= low:
            raise ValueError(f"invalid duration band: {part!r}")
        bands.append((low, high))
    return bands


def duration_band(seconds: Column, spec: str) -> Column:
    """Number of the first band that holds ``seconds`` (negative ones count as 0), else the number of bands."""
    bands, s = duration_bands(spec), F.greatest(F.lit(0.0), seconds.cast("double"))
    inside = [F.when((s >= low) & (F.lit(True) if high is None else s < high), k) for k, (low, high) in enumerate(bands)]
    return F.coalesce(*inside, F.lit(len(bands)))


def priority_order(df: DataFrame, seconds: Column, spec: str, id_column: str = "item_id") -> DataFrame:
    """Rows by duration band, then id, with ``band``; a range sort, so no task sees all rows."""
    return df.withColumn("band", duration_band(seconds, spec)).orderBy("band", id_column)


def length_filter(df: DataFrame, samples: str, rate: str, min_seconds: float, max_seconds: float) -> DataFrame:
    """Clips whose length in samples over the rate is within the closed bounds; rows without a length or a rate go."""
    return df.filter(F.when(F.col(rate) > 0, (F.col(samples) / F.col(rate)).between(min_seconds, max_seconds)))


#: Slices of picks within the clips of one audio.
_PICKS = (1 << 20, 1 << 12)


def pair_references(clips: DataFrame, seed: int = 42, min_prompt: float = 1.0, max_prompt: float = 10.0, with_text: bool = True) -> DataFrame:
    """One distinct clip of the same recording and speaker for each target: another id, path and audio digest.

    Of the n candidates in id order, the target takes number sha256("seed:id") mod n. Candidates are not
    joined with targets: every clip of a pool has its rank, from counts by id prefix, and a pick becomes a rank by stepping over the
    clips of the target's audio. The i-th of these (from 0), of rank b, is stepped over by picks of b - i and more: one clip is
    compared with its rank, and for an audio with copies, what is to be added is a running count over entries and picks in that order. Neither pools nor copies are gathered.
    Rows come back with ``reason`` (null: paired) and ``prompt_id``, ``prompt_audio_sha256``, ``prompt_text`` (``with_text``). The clips are read and digested once
    and kept in the shared folder with the prompts' ids, while ranks and picks are deleted once these are found; ids must be distinct.

    Clips that name one path but several digests bar each other by path too; only such paths' clips, which a sound
    manifest hasn't, are put together in lists.
    """
    spark, kind = clips.sparkSession, clips.schema["item_id"].dataType
    rows = scratch.stored(clips.withColumn("reason", pair_eligibility()), "clips")
    chosen = scratch.settled(spark, lambda: _prompts(rows.filter("reason is null").withColumn("audio_sha256", scoring.packed(F.col("audio_sha256"))), kind, seed, min_prompt, max_prompt), "chosen")
    chosen = chosen.withColumn("prompt_audio_sha256", scoring.unpacked(F.col("prompt_audio_sha256")))
    if with_text:
        said = rows.select(F.col("item_id").alias("_said"), F.col("final_text").alias("prompt_text"))
        chosen = chosen.join(said, F.col("prompt_id") == F.col("_said"), "left").drop("_said")
    out = rows.join(chosen, F.col("item_id") == F.col("_target"), "left").drop("_target")
    return out.withColumn("reason", F.when(F.col("reason").isNull() & F.col("prompt_id").isNull(), "no_distinct_same_recording_speaker_reference").otherwise(F.col("reason")))


def _prompts(good: DataFrame, kind: DataType, seed: int, min_prompt: float, max_prompt: float) -> DataFrame:
    """_target, prompt_id and prompt_audio_sha256 of the eligible clips ``good`` that have a prompt; their ids are of ``kind``."""
    key = ["video_id", "speaker_id"]
    fit = (F.col("duration_ms") / 1000).between(min_prompt, max_prompt)
    pool = good.filter(fit).select(*key, "item_id", "audio_path", "audio_sha256")
    ranked = scratch.settled(good.sparkSession, lambda: scans.ranked(pool, key, scans.text_levels("item_id"), ["item_id"]), "ranked")

    sizes = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("pool_size"))
    audio = [*key, "audio_sha256"]
    copies = ranked.groupBy(*audio).agg(F.count(F.lit(1)).alias("copies"), F.min("rank").alias("first"))
    mixed = good.groupBy("audio_path").agg(F.min("audio_sha256").alias("_a"), F.max("audio_sha256").alias("_b")).filter("_a <> _b").select("audio_path", F.lit(True).alias("_mixed"))
    target = good.select("item_id", *key, "audio_path", "audio_sha256").join(sizes, key, "left").join(copies, audio, "left").join(mixed, "audio_path", "left")
    target = target.withColumn("n", F.coalesce("pool_size", F.lit(0)) - F.coalesce("copies", F.lit(0)))
    drawn = scoring.digest_mod(F.concat(F.lit(f"{seed}:"), "item_id"), F.when(F.col("n") > 0, F.col("n")))
    target = scratch.stored(target.withColumn("c", drawn), "targets")

    plain = target.filter("_mixed is null and n > 0")
    alone = plain.filter("coalesce(copies, 0) < 2").select("item_id", *key, (F.col("c") + F.coalesce(F.col("c") >= F.col("first"), F.lit(False)).cast("long")).alias("rank"))
    twins = ranked.join(copies.filter("copies > 1").select(*audio), audio, "left_semi").select(*audio, "rank")
    entries = scans.ranked(twins, audio, scans.time_levels("rank", _PICKS), ["rank"], "nth").select(*audio, F.lit(None).cast(kind).alias("item_id"), (F.col("rank") - F.col("nth")).alias("c"), F.lit(1).alias("entry"))
    both = plain.filter("copies > 1").select(*audio, "item_id", "c", F.lit(0).alias("entry")).unionByName(entries)
    # An entry counts for picks of its own place too, so it goes before them.
    counted = scans.running(both, audio, scans.time_levels("c", _PICKS), ["c", F.desc("entry"), "item_id"], {"over": F.col("entry")}, "sum")
    picks = counted.filter("entry = 0").select("item_id", *key, (F.col("c") + F.coalesce("over", F.lit(0))).alias("rank"))
    picks = alone.unionByName(picks).unionByName(_mixed_picks(target, ranked, key, seed))
    known = ranked.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("rank").alias("_rank"), F.col("item_id").alias("prompt_id"), F.col("audio_sha256").alias("prompt_audio_sha256"))
    return picks.join(known, [*(F.col(k) == F.col(f"_{k}") for k in key), F.col("rank") == F.col("_rank")]).select(F.col("item_id").alias("_target"), "prompt_id", "prompt_audio_sha256")


def _mixed_picks(target: DataFrame, ranked: DataFrame, key: list[str], seed: int) -> DataFrame:
    """item_id, ``key`` and rank of the pick of targets whose path has several digests: what is barred by audio or by path is listed."""
    mine = target.filter("_mixed")
    of = lambda c, name: ranked.join(mine.select(*key, c).distinct(), [*key, c], "left_semi").groupBy(*key, c).agg(F.collect_list("rank").alias(name))
    rows = mine.join(of("audio_sha256", "same_audio"), [*key, "audio_sha256"], "left").join(of("audio_path", "same_path"), [*key, "audio_path"], "left")
    none = F.array().cast("array<long>")
    rows = rows.withColumn("barred", F.array_sort(F.array_distinct(F.concat(F.coalesce("same_audio", none), F.coalesce("same_path", none)))))
    left = F.coalesce("pool_size", F.lit(0)) - F.size("barred")
    rows = rows.withColumn("n", left).filter("n > 0").withColumn("pick", scoring.digest_mod(F.concat(F.lit(f"{seed}:"), "item_id"), F.col("n")).cast("long"))
    return rows.select("item_id", *key, F.aggregate("barred", F.col("pick"), lambda at, b: F.when(b <= at, at + 1).otherwise(at)).alias("rank"))


def group_split(df: DataFrame, fraction: float, seed: int, group: Column, source: Column) -> DataFrame:
    """``split`` train or valid for whole groups, by their digest; no shuffle."""
    limit = int(fraction * (1 << 64))
    key = F.concat_ws(":", F.lit("split"), F.lit(str(seed)), source, group)
    return df.withColumn("split", F.when(scoring.u64_of(key) < F.lit(limit).cast("decimal(20,0)"), "valid").otherwise("train"))


def require_both_sides(df: DataFrame) -> None:
    """Raise where a split has left one side without rows."""
    n = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    if not n.get("train") or not n.get("valid"):
        raise ValueError(f"group split gave {n.get('train', 0)} training and {n.get('valid', 0)} validation rows")


def leakage_audit(df: DataFrame, group: str) -> DataFrame:
    """Groups that are on both sides of a split."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("sides")).filter("sides > 1")


def sampling_mass(df: DataFrame, weights: dict[str, float], source: str = "source") -> DataFrame:
    """Each row's share of its corpus: weight over the corpus's rows; corpora without a positive weight are left out.

    Applied again after rows have gone, it gives the mass of the rest, and each corpus keeps its weight.
    """
    kept = {k: v for k, v in weights.items() if v > 0}
    if not kept:
        raise ValueError("no positive-weight sources")
    table = F.create_map(*[F.lit(x) for kv in kept.items() for x in kv])
    rows = df.withColumn("weight", table[F.col(source)]).filter("weight is not null")
    counts = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(counts), source).withColumn("mass", F.col("weight") / F.col("n")).drop("n", "weight")  # a row per corpus named in ``weights``


def dataset_summary(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("records"), (F.sum(F.coalesce("duration_ms", F.lit(0))) / 3_600_000).alias("hours"))


def short_clip_quota(df: DataFrame, low: float = 0.02, target: float = 0.03, high: float = 0.05) -> DataFrame:
    """All standard clips and k short ones (``is_short``) of least digest, so that short ones are about ``target`` of all.

    k is between the counts that give ``low`` and ``high``; none if these cross or there's no standard clip.
    Which digests are the least comes from counts by their prefix; only the clips of one prefix are ordered.
    """
    standard, short = df.agg(F.count_if(~F.col("is_short")), F.count_if("is_short")).first()
    least = math.ceil(low * standard / (1 - low)) if low > 0 else 0
    most = math.floor(high * standard / (1 - high))
    k = min(short, most, max(least, round(target * standard / (1 - target)))) if standard and short and most >= least else 0
    if not k:
        return df.filter("not is_short")
    # The k-th digest is found from counts by prefix: whole prefixes are taken, and only the one at the border is ordered.
    digest = F.sha2(F.col("item_id").cast("string"), 256)
    rows = df.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 4))
    counts = rows.filter("is_short").groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("_sum", F.sum("n").over(Window.orderBy("_part")))  # at most 16 ** 4 rows
    border = upto.filter(F.col("_sum") >= k).orderBy("_part").select("_part", (F.lit(k) - F.col("_sum") + F.col("n")).alias("left")).first()
    inside = rows.filter(F.col("is_short") & (F.col("_part") == border[0])).orderBy("_digest", "item_id").limit(border[1])
    whole = rows.filter(~F.col("is_short") | (F.col("_part") < border[0]))
    return whole.unionByName(inside).select(*df.columns)


def numbered(df: DataFrame, order: Column, tie: str, prefix: int = 3) -> DataFrame:
    """``rn`` from 0 in the order of a hex digest and ``tie``, without a single task for all rows.

    Rows are counted by the digest's first ``prefix`` digits; only those counts are summed in one place.
    """
    rows = df.withColumn("_digest", order).withColumn("_part", F.substring("_digest", 1, prefix))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_digest", tie)) - 1
    return rows.withColumn("_in", inside).join(F.broadcast(base), "_part").withColumn("rn", F.col("_base") + F.col("_in")).drop("_digest", "_part", "_in", "_base")  # at most 16 ** prefix rows


def pack_shards(df: DataFrame, size: int, seed: int = 42, id_column: str = "item_id") -> DataFrame:
    """``shard`` of each row in a seeded order, ``size`` rows to a shard."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    return numbered(df, digest, id_column).withColumn("shard", F.floor(F.col("rn") / size)).drop("rn")


def pack_audited(df: DataFrame, size: int, seed: int = 42, min_seconds: float | None = None, max_seconds: float | None = None, id_column: str = "item_id", path: str = "audio_path", seconds: str = "seconds", error: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that go to their ``shard``, a report of each shard, and the errors (id, path, ``reason``, shard).

    Shards are dealt to all rows first, and what's wrong or too short or long leaves its shard less full: a row without id or path, or with
    a message in the column ``error``, is an error; the length must be from ``min_seconds`` to below ``max_seconds``, a null one being none. The report: shard, processed, filtered,
    errors, seconds; shards that nothing goes to have a line there and no rows.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = df.withColumn("_id", given(id_column))
    reason = F.when((given(id_column) == "") | (given(path) == ""), "missing id or audio_path")
    reason = reason.when(F.col(error).isNotNull(), F.col(error).cast("string")) if error else reason
    length = F.coalesce(F.col(seconds).cast("double"), F.lit(0.0))
    out = (F.lit(min_seconds is not None) & (length < float(min_seconds or 0))) | (F.lit(max_seconds is not None) & (length >= float(max_seconds or 0)))
    rows = scratch.stored(pack_shards(keyed, size, seed, "_id").withColumns({"reason": reason, "_seconds": length, "_out": out}), "packed")
    fine = F.col("reason").isNull() & ~F.col("_out")
    report = rows.groupBy("shard").agg(F.count_if(fine).alias("processed"), F.count_if(F.col("reason").isNull() & F.col("_out")).alias("filtered"), F.count("reason").alias("errors"), F.sum(F.when(fine, F.col("_seconds")).otherwise(0.0)).alias("seconds"))
    return rows.filter(fine).select(*df.columns, "shard"), report, rows.filter("reason is not null").select(id_column, path, "reason", "shard")


def shard_stats(shards: DataFrame) -> DataFrame:
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("samples"), (F.sum("duration_ms") / 1000).alias("seconds"))


def encode_once(df: DataFrame, digest: str, payload: str) -> DataFrame:
    """One row for each distinct digest, with the payload of the least id, to be encoded once and joined back."""
    return df.groupBy(digest).agg(F.min_by(payload, "item_id").alias(payload), F.count(F.lit(1)).alias("uses"))


def with_encoded(pairs: DataFrame, encoded: DataFrame, digest: str = "audio_sha256", claimed: tuple[str, ...] = ("audio_sha256", "prompt_audio_sha256"), columns: tuple[str, ...] = ("tokens", "frames")) -> DataFrame:
    """The encoding of both sides of each pair, joined back by digest (columns behind ``target_`` and ``prompt_``), and ``encode_error``.

    ``encoded``: digest, columns and, where there, actual_sha256, the digest of the bytes that were read.
    """
    out, errors = pairs, []
    for side, key in zip(("target", "prompt"), claimed):
        real = F.col("actual_sha256") if "actual_sha256" in encoded.columns else F.col(digest)
        one = encoded.select(F.col(digest).alias(f"_{side}"), real.alias(f"_{side}_real"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        out = out.join(one, F.col(key) == F.col(f"_{side}"), "left")
        errors += [F.when(F.col(f"_{side}").isNull(), f"{side}_not_encoded"), F.when(F.col(f"_{side}_real") != F.col(key), "audio_bytes_differ_from_digest")]
    errors.append(F.when(F.col(claimed[0]) == F.col(claimed[1]), "target_and_reference_same_audio"))
    return out.withColumn("encode_error", F.coalesce(*errors)).select(*pairs.columns, *(f"{s}_{c}" for s in ("target", "prompt") for c in columns), "encode_error")


def one_success(results: DataFrame) -> DataFrame:
    """Cached recognition rows with exactly one run, and that successful (``runs``: array of status, transcript), with the ``transcript``."""
    return results.filter((F.size("runs") == 1) & (F.get("runs", F.lit(0))["status"] == "ok")).withColumn("transcript", F.get("runs", F.lit(0))["transcript"])


def reusable(pending: DataFrame, cached: DataFrame, keys: list[str], good: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose result in the cache is still valid (all keys equal, and ``good``, by default its status ok), and the rest."""
    kept = cached.filter(F.col("status") == "ok" if good is None else good).select(*keys).distinct()
    return pending.join(kept, keys, "left_semi"), pending.join(kept, keys, "left_anti")


def reuse_asr_results(items: DataFrame, cached: DataFrame, prompt_id: str, prompt_sha256: str) -> tuple[DataFrame, DataFrame]:
    """Cached rows that still hold for ``items`` (id, audio digest, prompt and its digest, one success), and the items that are left to do."""
    kept = one_success(cached).filter((F.col("prompt_id") == prompt_id) & (F.col("prompt_sha256") == prompt_sha256))
    keys = ["item_id", "audio_sha256"]
    return kept.join(items.select(*keys), keys, "left_semi").dropDuplicates(["item_id"]), items.join(kept.select(*keys), keys, "left_anti")


def reuse_quality_results(items: DataFrame, asr: DataFrame, cached: DataFrame, prompt_id: str, prompt_sha256: str) -> tuple[DataFrame, DataFrame]:
    """The same of quality observations, which also hold for one transcript only; items without a recognised transcript have nothing to do.

    All three sides are shuffled by id alone, once, with packed digests; these are compared where ids meet, not taken as further keys, by which the joined rows would be shuffled again.
    """
    digests = ["audio_sha256", "primary_transcript_sha256"]
    each = lambda df, f: df.withColumns({c: f(F.col(c)) for c in digests if c in df.columns})
    said = one_success(asr).select("item_id", F.sha2(F.coalesce("transcript", F.lit("")), 256).alias("primary_transcript_sha256"))
    expected = each(items, scoring.packed).join(each(said, scoring.packed), "item_id")
    kept = each(cached.filter((F.col("status") == "ok") & F.col("quality_assessment").isNotNull() & (F.col("prompt_id") == prompt_id) & (F.col("prompt_sha256") == prompt_sha256)), scoring.packed)
    other = lambda df: df.select(*(F.col(c).alias(f"_{c}") for c in ("item_id", *digests)))
    same = (F.col("item_id") == F.col("_item_id")) & F.array_contains(F.array("_audio_sha256"), F.col("audio_sha256")) & F.array_contains(F.array("_primary_transcript_sha256"), F.col("primary_transcript_sha256"))
    old = kept.join(other(expected), same, "left_semi").dropDuplicates(["item_id"])
    return each(old, scoring.unpacked), each(expected.join(other(kept), same, "left_anti"), scoring.unpacked)


def reuse_recovery_results(items: DataFrame, initial: DataFrame, cached: DataFrame, config_sha256: str) -> tuple[DataFrame, DataFrame]:
    """Repair reports that hold for ``items`` (id, audio digest, settings, same first detection, and a finished status), and the items left to do.

    A recovered report needs the digest of the file that's there (``present_sha256``, null where it's gone) to be the one it tells.
    """
    expected = items.select("item_id", F.col("audio_sha256").alias("original_audio_sha256")).join(initial.select("item_id", F.coalesce("detected", F.lit(False)).alias("initial_detected")), "item_id")
    there = F.coalesce(F.col("present_sha256") == F.col("recovered_audio_sha256"), F.lit(False)) if "present_sha256" in cached.columns else F.lit(True)
    done = F.col("status").isin("not_needed", "rejected") | ((F.col("status") == "recovered") & there)
    kept = cached.filter((F.col("config_sha256") == config_sha256) & done)
    keys = ["item_id", "original_audio_sha256", "initial_detected"]
    return kept.join(expected, keys, "left_semi").dropDuplicates(["item_id"]), items.join(kept.join(expected, keys, "left_semi").select("item_id"), "item_id", "left_anti")


def merge_reused_fresh(reused: DataFrame, fresh: DataFrame, key: str = "item_id") -> DataFrame:
    """Cached rows and new ones; where both have a key, the new one stands."""
    return reused.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def mix_sources(frames: dict[str, DataFrame], id_column: str = "item_id") -> DataFrame:
    """Union of corpora by column name, with ``source``, and ids prefixed by it; columns that one lacks are null there."""
    out: DataFrame | None = None
    for name, df in frames.items():
        df = df.withColumn("source", F.lit(name)).withColumn(id_column, F.concat(F.lit(f"{name}:"), F.col(id_column)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def weight_ablations(df: DataFrame, weight: str, seed: int, id_column: str = "item_id", bin_column: str | None = None) -> DataFrame:
    """``shuffled_weight``: the weights dealt anew over the rows, in a seeded order (within ``bin_column`` where given); and ``mean_weight``.

    Both orders are numbered by hash prefix, so no task sees all rows.
    """
    stratum = F.lit(0) if bin_column is None else F.col(bin_column)
    rows = df.withColumn("_bin", stratum)
    own = F.sha2(F.concat(F.lit("own:"), F.col(id_column).cast("string")), 256)
    new = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)

    def number(order: Column, keep: list[str]) -> DataFrame:
        d = rows.withColumn("_d", order).withColumn("_p", F.substring("_d", 1, 3))
        counts = d.groupBy("_bin", "_p").agg(F.count(F.lit(1)).alias("n"))
        base = counts.withColumn("_b", F.coalesce(F.sum("n").over(Window.partitionBy("_bin").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        inside = F.row_number().over(Window.partitionBy("_bin", "_p").orderBy("_d", id_column))
        return d.withColumn("_in", inside).join(base, ["_bin", "_p"]).withColumn("_rn", F.col("_b") + F.col("_in")).select("_bin", "_rn", *keep)

    dealt = number(new, [weight]).withColumnRenamed(weight, "shuffled_weight")
    out = number(own, df.columns).join(dealt, ["_bin", "_rn"])
    mean = df.agg(F.avg(weight).alias("mean_weight"))
    return out.crossJoin(F.broadcast(mean)).select(*df.columns, "shuffled_weight", "mean_weight")  # one row


def pair_prompts_epoch(df: DataFrame, epoch: int, seed: int = 42, min_prompt: float = 1.0, max_prompt: float = 10.0, unpaired: str = "keep") -> DataFrame:
    """A prompt of the same source and speaker for each record, anew for each epoch: another id, number u64("prompt:seed:epoch:source:id") mod n in ordinal order.

    Columns: source, speaker_id, id, ordinal, prompt_id (an explicit one wins; null where the speaker has no other record) and, where there, duration:
    prompts are of ``min_prompt`` to ``max_prompt`` seconds, or of unknown length. Records without a prompt stay, are dropped, or raise when they're
    read (``unpaired``: keep, drop, fail). Ranks come from counts by slices of ordinals, so a speaker's records are many groups.
    """
    if unpaired not in ("keep", "drop", "fail"):
        raise ValueError("unpaired is keep, drop or fail")
    key = ["source", "speaker_id"]
    rows = scratch.stored(df, "records")
    fit = F.coalesce(F.col("duration").between(min_prompt, max_prompt), F.lit(True)) if "duration" in df.columns else F.lit(True)
    levels = scans.time_levels("ordinal", (1 << 20, 1 << 12))
    ranked = scratch.stored(scans.ranked(rows.filter(fit).select(*key, "id", "ordinal"), key, levels, ["ordinal", "id"]), "ranked")
    sizes = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    named = lambda part, names: part.select(*(F.col(k).alias(f"_on_{k}") for k in key), *(F.col(c).alias(a) for c, a in names.items()))
    same = [F.col(k) == F.col(f"_on_{k}") for k in key]
    own = named(ranked, {"id": "_own", "ordinal": "_at", "rank": "_rank"})
    target = rows.filter("prompt_id is null").join(own, [*same, F.col("id") == F.col("_own"), F.col("ordinal").eqNullSafe(F.col("_at"))], "left").drop("_own", "_at", *(f"_on_{k}" for k in key))
    target = target.join(named(sizes, {"_n": "_n"}), same, "left").drop(*(f"_on_{k}" for k in key))
    left = F.coalesce("_n", F.lit(0)) - F.col("_rank").isNotNull().cast("long")
    drawn = scoring.u64_of(F.concat_ws(":", F.lit("prompt"), F.lit(str(seed)), F.lit(str(epoch)), "source", "id"))
    target = target.withColumn("_pick", F.when(left > 0, (drawn % left.cast("decimal(20,0)")).cast("long")))
    target = target.withColumn("_pick", F.col("_pick") + F.when(F.col("_pick") >= F.col("_rank"), 1).otherwise(0))
    found = target.join(named(ranked, {"rank": "_found_rank", "id": "_found"}), [*same, F.col("_pick") == F.col("_found_rank")], "left").withColumn("prompt_id", F.col("_found"))
    if unpaired == "drop":
        found = found.filter("prompt_id is not null")
    elif unpaired == "fail":
        found = found.withColumn("prompt_id", F.coalesce("prompt_id", F.raise_error(F.concat(F.lit("no distinct same-speaker prompt for "), F.col("id").cast("string"))).cast(df.schema["prompt_id"].dataType)))
    return rows.filter("prompt_id is not null").unionByName(found.select(*df.columns))
