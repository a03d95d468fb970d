"""Losses, gates, bootstrap intervals and audits over result tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked_token_loss(tokens: DataFrame, codebook_weights: dict[int, float], keys: list[str]) -> DataFrame:
    """Per example: mean loss of supervised tokens (label not -100) of each codebook, weighted by the normalised codebook weights; without supervision 0."""
    total = sum(codebook_weights.values())
    if total <= 0 or min(codebook_weights.values()) < 0:
        raise ValueError("codebook weights must be non-negative with a positive sum")
    table = F.create_map(*[F.lit(x) for k, v in codebook_weights.items() for x in (k, v / total)])
    on = F.col("label") != -100
    each = tokens.groupBy(*keys, "codebook").agg((F.sum(F.when(on, F.col("loss")).otherwise(0.0)) / F.greatest(F.count_if(on), F.lit(1))).alias("mean"))
    return each.groupBy(*keys).agg(F.sum(F.col("mean") * table[F.col("codebook")]).alias("loss"))


def gate_metrics(atoms: DataFrame, key: str = "video_id") -> DataFrame:
    """Per key: dominant speaker (most exclusive time, then the greatest label), its ratio, those of other speakers, overlap and unknown, and trailing unknown time.

    ``atoms``: key, start_ms, end_ms, state, speaker (of single atoms).
    """
    ms = F.col("end_ms") - F.col("start_ms")
    own = atoms.filter("state = 'single'").groupBy(key, "speaker").agg(F.sum(ms).alias("ms"))
    top = own.groupBy(key).agg(F.max_by("speaker", F.struct("ms", "speaker")).alias("dominant"), F.max("ms").alias("dominant_ms"), F.sum("ms").alias("single_ms"))
    total = lambda s: F.sum(F.when(F.col("state") == s, ms).otherwise(0)).alias(f"{s}_ms")
    span = atoms.groupBy(key).agg(F.sum(ms).alias("all_ms"), total("overlap"), total("unknown"), F.max(F.when(F.col("state") != "unknown", F.col("end_ms"))).alias("voiced_to"), F.max("end_ms").alias("last"))
    out = span.join(top, key, "left")
    ratio = lambda c: F.round(F.coalesce(c, F.lit(0)) / F.col("all_ms"), 9)
    return out.select(key, "dominant", ratio(F.col("dominant_ms")).alias("dominant_ratio"), ratio(F.col("single_ms") - F.col("dominant_ms")).alias("other_ratio"), ratio(F.col("overlap_ms")).alias("overlap_ratio"), ratio(F.col("unknown_ms")).alias("unknown_ratio"), F.when(F.col("voiced_to").isNull(), F.col("unknown_ms")).otherwise(F.col("last") - F.col("voiced_to")).alias("trailing_unknown_ms"))


def audit_codec_index(index: DataFrame, manifest: DataFrame, key: str, checked: list[str]) -> DataFrame:
    """Ids that don't match between an index and its manifest, with the reason; none if they agree in all ``checked`` columns."""
    a = index.select(F.col(key).alias("a"), F.struct(*checked).alias("x"))
    b = manifest.select(F.col(key).alias("b"), F.struct(*checked).alias("y"))
    many = index.groupBy(key).count().filter("count > 1").select(F.col(key).alias("id"), F.lit("duplicate_id").alias("reason"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    why = F.when(F.col("b").isNull(), "unknown_id").when(F.col("a").isNull(), "missing_id").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(F.coalesce("a", "b").alias("id"), why.alias("reason")).filter("reason is not null").unionByName(many)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Distribution function of the Poisson law of mean one, at 0, 1, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def multiplicities(hashes: int, replicates: int, seed: int) -> np.ndarray:
    """How often a listener or a condition of this hash is drawn in each replicate."""
    rep = np.arange(replicates, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    u = _mixed(rep ^ np.uint64(hashes % (1 << 64))) >> np.uint64(11)
    return np.searchsorted(_POISSON, u.astype(float) / (1 << 53), "right").astype(np.int64)


def crossed_bootstrap_ci(ratings: DataFrame, replicates: int = 10_000, seed: int = 7) -> DataFrame:
    """Mean rating per system with a 95 % interval from resampling listeners and conditions (Poisson multiplicities from hashes).

    ``ratings``: system, listener, condition, score. Ratings are summed to cells of system, listener and condition first.
    Each task adds its cells to one sum per system and replicate, all replicates at once; only these sums are shuffled.
    """
    hashed = lambda c: F.xxhash64(F.lit(c), c)
    cells = ratings.groupBy("system", hashed("listener").alias("l"), hashed("condition").alias("c")).agg(F.sum("score").cast("double").alias("s"), F.count("score").alias("n"))
    kind = cells.schema["system"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        recent: dict[int, np.ndarray] = {}

        def drawn(h: int) -> np.ndarray:
            if h not in recent:
                if len(recent) > 512:
                    recent.clear()
                recent[h] = multiplicities(h, replicates, seed)
            return recent[h]

        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for system, a, b, s, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                w = drawn(a) * drawn(b)
                total = sums.setdefault(system, np.zeros((2, replicates)))
                total[0] += w * (s or 0.0)
                total[1] += w * n
        for system, (top, low) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([system] * replicates, arrow), pa.array(np.arange(replicates)), pa.array(top), pa.array(low)], names=["system", "rep", "s", "n"])

    parts = cells.mapInArrow(run, f"system {kind.simpleString()}, rep long, s double, n double")
    means = parts.groupBy("system", "rep").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0").withColumn("mean", F.col("s") / F.col("n"))
    bounds = means.groupBy("system").agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return ratings.groupBy("system").agg(F.avg("score").alias("mean")).join(bounds, "system").select("system", "mean", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation, and that of average ranks. Values are counted first; ranks come from sums over value counts."""

    def ranks(column: str) -> DataFrame:
        counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        # Sums of counts by range of the value, then within a range: no window over all rows.
        low, high = counts.agg(F.min(column), F.max(column)).first()
        width = ((high - low) or 1) / 512
        part = counts.withColumn("part", F.floor((F.col(column) - F.lit(low)) / width))
        base = part.groupBy("part").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
        inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return part.withColumn("inside", inside).join(F.broadcast(base), "part").select(column, (F.col("before") + F.col("inside") + (F.col("n") + 1) / 2).alias(f"rank_{column}"))  # at most 513 rows are sent

    both = df.join(ranks(a), a).join(ranks(b), b)
    return both.agg(F.corr(a, b).alias("pearson"), F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"), F.count(F.lit(1)).alias("n"))


def compare_recovery(items: DataFrame, before: DataFrame, after: DataFrame, max_probability: float = 0.10, min_reduction: float = 0.05, min_level_db: float = -45.0, max_loss_db: float = 18.0, max_delta_ms: int = 100) -> DataFrame:
    """``items`` with ``reasons`` against the repaired clip, in order and behind those that its own audio check gave, and ``recovered``.

    ``before`` and ``after``: item_id, probability, level_db, duration_ms; ``after`` may have reasons (array), audio_path and
    audio_sha256, which replace the item's where it's recovered. A missing value counts as the reference's defaults do: probability 0,
    level -180 dB (before: the level after), duration 0. An item without a report of both keeps what it has, with ``recovery_evidence_missing``.
    """
    names = ("probability", "level_db", "duration_ms")
    side = lambda df, p, more: df.select("item_id", *(F.col(c).alias(f"_{p}_{c}") for c in (*names, *(m for m in more if m in df.columns))), F.lit(True).alias(f"_{p}"))
    out = items.join(side(before, "b", ()), "item_id", "left").join(side(after, "a", ("reasons", "audio_path", "audio_sha256")), "item_id", "left")
    num = lambda c, default: F.coalesce(F.col(c).cast("double"), default)
    p_after, p_before = num("_a_probability", F.lit(0.0)), num("_b_probability", F.lit(0.0))
    level = num("_a_level_db", F.lit(-180.0))
    rules = F.array(
        F.when(p_after > max_probability, "background_music_residual"),
        F.when(p_before - p_after < min_reduction, "insufficient_music_probability_reduction"),
        F.when(level < min_level_db, "separated_vocals_too_quiet"),
        F.when(num("_b_level_db", level) - level > max_loss_db, "separated_vocals_signal_loss"),
        F.when(F.abs(num("_a_duration_ms", F.lit(0.0)) - num("_b_duration_ms", F.lit(0.0))) > max_delta_ms, "separated_audio_duration_mismatch"),
    )
    own = F.coalesce(F.col("_a_reasons"), F.array().cast("array<string>")) if "reasons" in after.columns else F.array().cast("array<string>")
    found = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.array(F.lit("recovery_evidence_missing"))).otherwise(F.array_distinct(F.concat(own, F.array_compact(rules))))
    out = out.withColumn("_found", found).withColumn("_ok", F.size("_found") == 0)
    swap = {c: F.when(F.col("_ok"), F.col(f"_a_{c}")).otherwise(F.col(c)) for c in ("audio_path", "audio_sha256") if c in items.columns and c in after.columns}
    kept = [F.col(c).alias(f"pre_separation_{c}") for c in swap]
    return out.select(*(swap[c].alias(c) if c in swap else F.col(c) for c in items.columns), *kept, F.col("_found").alias("reasons"), F.col("_ok").alias("recovered"))


def ordered_reasons(*arrays: Column, without: Column | None = None) -> Column:
    """Union of reason arrays in first-seen order, less those of ``without``."""
    every = F.array_distinct(F.concat(*arrays))
    return every if without is None else F.array_except(every, without)
