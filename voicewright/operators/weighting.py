"""Weighted manifests from two independent transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring


def assert_unique(df: DataFrame, key: str = "id", what: str = "rows") -> None:
    """Raise if ``key`` repeats or is null or empty."""
    bad = df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull() | (F.col(key).cast("string") == "")).head()
    if bad:
        raise ValueError(f"{what}: duplicate or empty {key}: {bad[0]}")


def once(df: DataFrame, key: str = "id", what: str = "rows") -> DataFrame:
    """``df`` whose ``key`` raises when it's read where it repeats, or is null or empty.

    Rows are counted in a window by ``key``. A join on it afterwards shuffles again, as the key is another expression then; ``counted`` leaves the key for that.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    told = F.concat(F.lit(f"{what}: duplicate or empty {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    bad = (n > 1) | F.col(key).isNull() | (F.col(key).cast("string") == "")
    return df.withColumn(key, F.when(bad, F.raise_error(told).cast(df.schema[key].dataType)).otherwise(F.col(key)))


def counted(df: DataFrame, key: str, what: str, name: str) -> DataFrame:
    """``df`` with ``name``, a null text that raises when it's read where ``key`` repeats, or is null or empty; a null text key becomes an empty one.

    Rows are counted in a window by ``key``: a join on it afterwards takes over its shuffle and its order, so the check is no pass of its own.
    The key itself must stay as it is for that; an expression of it would be shuffled again.
    """
    rows = df.withColumn(key, F.coalesce(key, F.lit(""))) if df.schema[key].dataType.simpleString() == "string" else df
    text = F.col(key).cast("string")
    bad = (F.count(F.lit(1)).over(Window.partitionBy(key)) > 1) | text.isNull() | (text == "")
    return rows.withColumn(name, F.when(bad, F.raise_error(F.concat(F.lit(f"{what}: duplicate or empty {key}: "), F.coalesce(text, F.lit("null")))).cast("string")))


#: Statuses of a request that succeeded.
SUCCEEDED = ("success", "passed", "complete", "completed")
ASR_COLUMNS = {"id": "string", "status": "string", "error": "string", "hypothesis": "string", "text": "string", "reference": "string", "audio_sha256": "string", "model_id": "string", "canonical": "struct<cer:double>"}


def asr_side(secondary: DataFrame) -> DataFrame:
    """Columns ``s_*`` that the evidence is judged by; what the table lacks is null.

    ``present`` (array of the names that a record has, as ``read_manifest`` gives it) tells a null from a field that isn't there: a null hypothesis isn't
    replaced by the text, and a null reference is one that differs. Without it a null is taken as absent.
    """
    have = lambda c: F.col(c) if c in secondary.columns else F.lit(None)
    there = lambda c: F.array_contains("present", c) if "present" in secondary.columns else F.col(c).isNotNull() if c in secondary.columns else F.lit(False)
    side = secondary.select(*(have(c).cast(kind).alias(f"s_{c}") for c, kind in ASR_COLUMNS.items() if c != "canonical"), have("canonical").cast(ASR_COLUMNS["canonical"]).alias("s_canonical"), F.coalesce(there("hypothesis"), F.lit(False)).alias("_h"), F.coalesce(there("reference"), F.lit(False)).alias("s_reference_given"))
    return side.withColumn("s_hypothesis", F.when(F.col("_h"), F.col("s_hypothesis")).otherwise(F.col("s_text"))).drop("s_text", "_h")


def validate_asr_evidence(require_audio_sha: bool = False, archived: bool = False) -> Column:
    """First failing rule of a joined row, or null: columns ``s_*`` of the secondary, ``text`` and ``audio_sha256`` of the primary.

    ``archived``: results without a status count if they carry their own error rate.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rule = (
        F.when(F.col("s_id").isNull(), "secondary_asr_missing")
        .when(F.col("s_status").isNotNull() & ~F.col("s_status").isin(*SUCCEEDED), "secondary_asr_failed")
        .when(given("s_error"), "secondary_asr_error")
    )
    if archived:
        rule = rule.when(F.col("s_status").isNull() & F.col("s_canonical").isNull(), "archived_asr_requires_canonical_evidence")
    else:
        rule = rule.when(F.col("s_status").isNull(), "secondary_asr_status_missing")
    rule = rule.when(F.col("s_hypothesis").isNull(), "secondary_transcript_missing")
    rule = rule.when(F.col("s_reference_given") & ~F.col("s_reference").eqNullSafe(F.col("text")), "primary_transcript_binding_mismatch")
    both = given("s_audio_sha256") & given("audio_sha256")
    if require_audio_sha:
        rule = rule.when(~both, "audio_sha256_required")
    return rule.when(both & (F.col("s_audio_sha256") != F.col("audio_sha256")), "audio_sha256_mismatch")


def validate_archived_rate(d: Column) -> Column:
    """Reason where the archived error rate isn't the disagreement that was computed anew."""
    cer = F.col("s_canonical.cer")
    near = F.abs(d - cer) <= F.greatest(F.greatest(F.abs(d), F.abs(cer)) * 1e-10, F.lit(1e-12))
    return F.when(F.col("s_canonical").isNotNull(), F.when(cer.isNull(), "invalid_canonical_evidence").when(F.isnan(cer) | ~near, "archived_cer_disagrees_with_recomputed_transcripts"))


def weight_manifest(primary: DataFrame, secondary: DataFrame | None = None, gamma: float = 3.0, w_min: float = 0.1, on_asr_error: str = "fail", require_audio_sha: bool = False, asr_format: str = "status", unique: bool = True) -> DataFrame:
    """``primary`` with ``reason`` (null: accepted), ``disagreement``, ``pseudo_label_weight`` and ``secondary_model``.

    Without ``secondary`` (synthetic pairs) the weight is 1. An empty hypothesis is a full disagreement; a
    missing or failed one is a reason, or raises when it's computed with ``on_asr_error="fail"``. A null primary text
    raises always. Ids that repeat on a side raise when rows are read (``unique``; without it the caller answers for them). Only the join's columns of the secondary are
    shuffled. ``loss_weight``, where present, follows the weight.
    """
    if on_asr_error not in ("fail", "exclude") or asr_format not in ("status", "archived"):
        raise ValueError("on_asr_error is fail or exclude, asr_format status or archived")
    rows = primary.withColumn("audio_sha256", scoring.packed(F.col("audio_sha256"))) if "audio_sha256" in primary.columns else primary.withColumn("audio_sha256", F.lit(None).cast("binary"))
    rows = counted(rows, "id", "primary", "_once") if unique else rows.withColumn("_once", F.lit(None).cast("string"))
    # The id is read here, so that it's checked where only reasons are wanted.
    empty = F.coalesce("_once", F.when(F.col("text").isNull(), F.raise_error(F.concat(F.col("id").cast("string"), F.lit(": primary transcript must be a string")))).when(F.length("_p") == 0, "empty_normalized_primary"))
    if secondary is not None:
        side = asr_side(secondary)
        side = side.withColumn("s_audio_sha256", scoring.packed(F.col("s_audio_sha256")))
        # Every row of the secondary is checked, met or not: the check is computed below the join.
        side = counted(side, "s_id", "secondary", "s_once") if unique else side.withColumn("s_once", F.lit(None).cast("string"))
        # Not even a cast from text to text, which would shuffle the rows again.
        key = rows.id if rows.schema["id"].dataType.simpleString() == "string" else rows.id.cast("string")
        rows = rows.join(side, key == side.s_id, "left").withColumn("s_audio_sha256", scoring.unpacked(F.col("s_audio_sha256")))
        empty = F.coalesce("s_once", empty)
    rows = rows.withColumns({"audio_sha256": scoring.unpacked(F.col("audio_sha256")), "id": F.when(F.col("_once").isNull(), F.col("id"))})
    if secondary is None:
        rows = scoring.computed(rows, {"_p": scoring.normalize_for_scoring(F.col("text"))})
        out = rows.withColumn("reason", empty).withColumns({"disagreement": F.lit(None).cast("double"), "secondary_model": F.lit(None).cast("string"), "pseudo_label_weight": F.when(F.col("reason").isNull(), 1.0)})
    else:
        rows = scoring.computed(rows, {"_p": scoring.normalize_for_scoring(F.col("text")), "_s": scoring.normalize_for_scoring(F.col("s_hypothesis"))})
        out = weigh_joined(rows, empty, gamma, w_min, on_asr_error, require_audio_sha, asr_format)
    if "loss_weight" in primary.columns:
        out = out.withColumn("loss_weight", F.coalesce("pseudo_label_weight", "loss_weight"))
    return out.select(*primary.columns, "reason", "disagreement", "pseudo_label_weight", "secondary_model")


def weigh_joined(rows: DataFrame, empty: Column, gamma: float, w_min: float, on_asr_error: str, require_audio_sha: bool, asr_format: str) -> DataFrame:
    """Reason, disagreement, weight and model of rows that hold both sides: text of the primary, ``s_*`` of the secondary, and both normalised texts, ``_p`` and ``_s``."""
    first = F.coalesce(empty, validate_asr_evidence(require_audio_sha, asr_format == "archived"))
    rows = rows.withColumn("reason", first)
    rows = scoring.computed(rows, {"_d": F.when(F.col("reason").isNull(), scoring.disagreement(F.col("_p"), F.col("_s")))}).withColumn("disagreement", F.col("_d"))
    reason = F.coalesce("reason", validate_archived_rate(F.col("disagreement")))
    if on_asr_error == "fail":
        stop = F.raise_error(F.concat_ws(": ", F.col("id").cast("string"), reason)).cast("string")
        reason = F.when(reason.isNull() | (reason == "empty_normalized_primary"), reason).otherwise(stop)
    rows = rows.withColumn("reason", reason).withColumn("disagreement", F.when(F.col("reason").isNull(), F.col("disagreement")))
    fine = F.col("reason").isNull()
    return rows.withColumns({"pseudo_label_weight": F.when(fine, scoring.reliability_weight(F.col("disagreement"), gamma, w_min)), "secondary_model": F.when(fine, F.coalesce("s_model_id", F.lit("unspecified")))})


def reliability(stage: str = "R", gamma: float = 3.0, w_min: float = 0.1) -> Column:
    """What is told of an accepted row's weight: struct of stage, weight, normalization, primary_text_unchanged and, for stage R, the rest."""
    fields = [F.lit(stage).alias("stage"), F.col("pseudo_label_weight").alias("weight"), F.lit("NFC_drop_whitespace_PSC_codepoints").alias("normalization"), F.lit(True).alias("primary_text_unchanged")]
    if stage == "R":
        fields += [F.col("disagreement"), F.lit(gamma).alias("gamma"), F.lit(w_min).alias("w_min"), F.col("secondary_model")]
    return F.struct(*fields)


def unused_secondary(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    return secondary.join(primary.select("id"), "id", "left_anti")


def weight_report(weighted: DataFrame, w_min: float = 0.1, unused: DataFrame | None = None) -> DataFrame:
    """One row: counts and weight statistics of a weighted manifest (population deviation), counts by reason and by model, and of ``unused`` results."""
    w = F.col("pseudo_label_weight")
    # A row has a reason or a model, so each group is one of these; all figures come from one pass over the rows.
    each = weighted.groupBy("reason", "secondary_model").agg(
        F.count(F.lit(1)).alias("n"), F.count(w).alias("k"), F.sum(w).alias("s"), F.sum(w * w).alias("q"), F.min(w).alias("low"), F.max(w).alias("high"), F.count_if(w == w_min).alias("floor"), F.count_if(w == 1).alias("one"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(c, "n")))))
    mean = F.sum("s") / F.sum("k")
    out = each.agg(
        total("n").alias("input_rows"), total("k").alias("accepted_rows"), total(F.when(F.col("reason").isNotNull(), F.col("n"))).alias("excluded_rows"), mean.alias("mean"),
        F.sqrt(F.greatest(F.sum("q") / F.sum("k") - mean * mean, F.lit(0.0))).alias("population_std"), F.min("low").alias("min"), F.max("high").alias("max"), total("floor").alias("at_floor"), total("one").alias("at_one"),
        by("reason").alias("exclusion_reasons"), by("secondary_model").alias("secondary_models"),
    )
    if unused is None:
        return out.withColumn("unused_secondary_rows", F.lit(0).cast("long"))
    return out.crossJoin(unused.agg(F.count(F.lit(1)).alias("unused_secondary_rows")))  # a row each


def reason_counts(df: DataFrame) -> DataFrame:
    return df.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def verify_manifest(weighted: DataFrame, stage: str = "R", gamma: float = 3.0, w_min: float = 0.1, accepted: int | None = None) -> DataFrame:
    """id and reason of rows that break a published manifest: another stage, a weight that its disagreement doesn't give, an alias that differs;
    with ``accepted`` also a row without id if the count differs.

    ``weighted``: id, pseudo_label_weight, reliability (struct of stage and disagreement) and, where there, loss_weight.
    """
    expected = F.lit(1.0) if stage == "S" else scoring.reliability_weight(F.col("reliability.disagreement"), gamma, w_min)
    near = F.abs(F.col("pseudo_label_weight") - expected) <= F.greatest(F.greatest(F.abs("pseudo_label_weight"), F.abs(expected)) * 1e-12, F.lit(1e-12))
    rule = F.when(~F.col("reliability.stage").eqNullSafe(F.lit(stage)), "manifest_mixes_stages").when(~F.coalesce(near, F.lit(False)), "weight_violates_formula")
    if "loss_weight" in weighted.columns:
        rule = rule.when(F.col("loss_weight").isNotNull() & (F.col("loss_weight") != F.col("pseudo_label_weight")), "conflicting_weight_aliases")
    bad = weighted.select("id", rule.alias("reason")).filter("reason is not null")
    if accepted is None:
        return bad
    count = weighted.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != accepted)
    return bad.unionByName(count.select(F.lit(None).cast(weighted.schema["id"].dataType).alias("id"), F.lit("manifest_count_mismatch").alias("reason")))


def weighted_example_mean(df: DataFrame, keys: list[str], weight: str, loss: str) -> DataFrame:
    """Sum of weight times loss over the number of examples, not over the weights."""
    return df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(loss)) / F.count(F.lit(1))).alias("weighted_mean"), F.count(F.lit(1)).alias("examples"))


def disagreement_calibration(df: DataFrame, d: str = "disagreement", error: str = "label_cer", step: float = 0.1) -> DataFrame:
    """Mean label error by bucket of disagreement, and the bucket's share of wrong labels (``wrong``)."""
    wrong = F.avg((F.col(error) > 0).cast("double"))
    return df.groupBy(F.least(F.floor(F.col(d) / step), F.lit(10)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error"), F.avg(d).alias("mean_d"), wrong.alias("wrong"))


def agreement_of_wrong(df: DataFrame, d: str = "disagreement", error: str = "label_cer") -> DataFrame:
    """One row: Pearson's correlation of disagreement and label error, and the share of rows whose transcripts are identical but wrong."""
    same = ((F.col(d) == 0) & (F.col(error) > 0)).cast("double")
    return df.agg(F.corr(d, error).alias("pearson"), F.avg(same).alias("identical_but_wrong"), F.count(F.lit(1)).alias("n"))
