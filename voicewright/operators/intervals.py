"""Interval joins, unions and labels on recording timelines. Intervals are half-open, in whole milliseconds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import scans

SPAN_MS = 30_000


def interval_join(left: DataFrame, right: DataFrame, key: str = "video_id", span: int = SPAN_MS, how: str = "inner") -> DataFrame:
    """Pairs that overlap within ``key``. Columns: ``l_*``, ``r_*`` and ``overlap`` (milliseconds).

    Both sides are dealt by key and time span, so a long recording is many groups; a pair is taken only in
    the first span that both have, which needs no distinct.
    """
    def spread(df: DataFrame, p: str) -> DataFrame:
        df = df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns)).filter(f"{p}_end_ms > {p}_start_ms")
        return df.withColumn(f"{p}_first", F.floor(F.col(f"{p}_start_ms") / span)).withColumn("span", F.explode(F.sequence(f"{p}_first", F.floor((F.col(f"{p}_end_ms") - 1) / span))))

    a, b = spread(left, "l"), spread(right, "r")
    both = a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (a.span == b.span) & (F.col("l_start_ms") < F.col("r_end_ms")) & (F.col("r_start_ms") < F.col("l_end_ms")))
    both = both.filter(a.span == F.greatest("l_first", "r_first"))
    ms = F.least("l_end_ms", "r_end_ms") - F.greatest("l_start_ms", "r_start_ms")
    return both.withColumn("overlap", ms).drop("span", "l_first", "r_first")


def islands(df: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """``island`` number within ``keys``: a new one begins where the gap to all earlier ends exceeds ``gap_ms``.

    A key's rows are scanned by time slices, so a hot recording is many groups.
    """
    at = scans.time_levels("start_ms")
    rows = scans.running(df, keys, at, ["start_ms", "end_ms"], {"_reach": F.col("end_ms")})
    rows = rows.withColumn("_fresh", F.when(F.col("_reach").isNull() | (F.col("start_ms") - F.col("_reach") > gap_ms), 1).otherwise(0))
    # Of equal intervals the one that begins an island comes first.
    rows = scans.running(rows, keys, at, ["start_ms", "end_ms", F.desc("_fresh")], {"island": F.col("_fresh")}, "sum")
    return rows.withColumn("island", (F.coalesce("island", F.lit(0)) + F.col("_fresh")).cast("long")).drop("_reach", "_fresh")


def merge_intervals(df: DataFrame, keys: list[str], gap_ms: int = 0) -> DataFrame:
    """Union of the intervals of each key, joined over gaps up to ``gap_ms``."""
    return islands(df, keys, gap_ms).groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("parts")).drop("island")


def overlap_ms(items: DataFrame, others: DataFrame) -> DataFrame:
    """Milliseconds of each item that the others cover, each counted for itself, and the ratio (6 digits, half to even)."""
    hits = interval_join(items.select("id", "video_id", "start_ms", "end_ms"), others.select("video_id", "start_ms", "end_ms"))
    total = hits.groupBy(F.col("l_id").alias("id")).agg(F.sum("overlap").alias("overlap_ms"))
    out = items.join(total, "id", "left").withColumn("overlap_ms", F.coalesce("overlap_ms", F.lit(0)).cast("long"))
    return out.withColumn("overlap_ratio", F.bround(F.col("overlap_ms") / (F.col("end_ms") - F.col("start_ms")), 6))


#: Labels of turns without a speaker, and of turns of several.
UNKNOWN_LABELS = ("", "UNKNOWN", "UNK", "UNASSIGNED", "NONE", "NULL")
OVERLAP_LABELS = ("OVERLAP", "OVL")


def label_speakers(candidates: DataFrame, turns: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """Speaker with most overlap for each candidate (ties by label), the least confidence of the speaker's turns, and a crosstalk flag.

    ``turns``: video_id, start_ms, end_ms, speaker and, where there, confidence (0 to 1), confidence_source, state, speaker_ids (a turn of several
    speakers counts whole for each of them, whatever its state), overlap and overlap_detected. Turns
    without a speaker or of state unknown or unassigned name nobody. No evidence: ``unknown`` with confidence 0. The flag is set
    where the runner-up has at least max(100 ms, 15 % of the winner's), a turn of state overlap or flagged so meets the candidate, or
    ``overlaps`` (intervals of crosstalk) cover more than max(20 ms, 2 % of it).
    """
    own = candidates.select("id", "video_id", "start_ms", "end_ms")
    have = lambda c, kind: F.col(c).cast(kind) if c in turns.columns else F.lit(None).cast(kind)
    state = F.lower(F.trim(F.coalesce(have("state", "string"), F.lit(""))))
    name = F.trim(F.coalesce(F.col("speaker"), F.lit("unknown"))) if "speaker" in turns.columns else F.lit("unknown")
    one = F.when((name != "") & (name != "unknown") & ~state.isin("unknown", "unassigned"), F.array(name)).otherwise(F.array().cast("array<string>"))
    several = have("speaker_ids", "array<string>")
    who = F.when(several.isNotNull(), F.filter(F.transform(several, lambda x: F.trim(x)), lambda x: x != "")).otherwise(one)
    sure = have("confidence", "double")
    sure = F.when(~F.isnan(sure) & (F.abs(sure) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)))
    source = F.coalesce(F.nullif(F.trim(have("confidence_source", "string")), F.lit("")), F.when(sure.isNotNull(), "turn_confidence").otherwise("unavailable"))
    flagged = F.coalesce(have("overlap", "boolean"), F.lit(False)) | F.coalesce(have("overlap_detected", "boolean"), F.lit(False))
    said = turns.select("video_id", "start_ms", "end_ms", F.explode_outer(who).alias("speaker"), sure.alias("sure"), source.alias("source"), ((state == "overlap") | flagged).alias("crossed"))
    hits = interval_join(own, said)
    sources = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("r_sure").isNotNull(), F.struct("r_start_ms", "r_end_ms", "r_source")))), lambda x: x["r_source"]))
    each = hits.groupBy(F.col("l_id").alias("id"), F.col("r_speaker").alias("speaker")).agg(F.sum("overlap").alias("ms"), F.min("r_sure").alias("sure"), sources.alias("sources"), F.max("r_crossed").alias("crossed"))
    second = F.array_sort(F.collect_list(F.when(F.col("speaker").isNotNull(), F.struct((-F.col("ms")).alias("ms"), "speaker", "sure", "sources"))))
    ranked = each.groupBy("id").agg(second.alias("r"), F.max("crossed").alias("crossed"))  # the speakers of a candidate
    out = candidates.join(ranked, "id", "left")
    if overlaps is None:
        out = out.withColumn("acoustic_overlap_ms", F.lit(0).cast("long"))
    else:
        covered = interval_join(own, overlaps.select("video_id", "start_ms", "end_ms")).groupBy(F.col("l_id").alias("id")).agg(F.sum("overlap").alias("acoustic_overlap_ms"))
        out = out.join(covered, "id", "left").withColumn("acoustic_overlap_ms", F.coalesce("acoustic_overlap_ms", F.lit(0).cast("long")))
    top = lambda k: F.try_element_at("r", F.lit(k))
    length, win, next_ms = F.col("end_ms") - F.col("start_ms"), -top(1)["ms"], -top(2)["ms"]
    crosstalk = F.coalesce(next_ms >= F.greatest(F.lit(100), F.bround(win * 0.15)), F.lit(False)) | F.coalesce("crossed", F.lit(False)) | (F.col("acoustic_overlap_ms") > F.greatest(F.lit(20), F.bround(length * 0.02)))
    none, silent = top(1).isNull(), F.size(top(1)["sources"]) == 0
    return out.select(
        *candidates.columns, F.coalesce(top(1)["speaker"], F.lit("unknown")).alias("speaker_id"), F.when(none, 0.0).otherwise(top(1)["sure"]).alias("speaker_confidence"),
        F.when(none, "no_speaker_evidence").when(silent, "unavailable_in_acoustic_turns").otherwise(F.array_join(top(1)["sources"], "+")).alias("speaker_confidence_source"),
        F.coalesce(win, F.lit(0)).alias("speaker_ms"), crosstalk.alias("overlap_detected"), "acoustic_overlap_ms", F.bround(F.when(length > 0, F.col("acoustic_overlap_ms") / length).otherwise(0.0), 6).alias("acoustic_overlap_ratio"),
    )


def stable_speaker_ids(df: DataFrame) -> DataFrame:
    """``video_spkNN`` in the order of first appearance; ``unknown`` stays."""
    first = df.filter("speaker_id <> 'unknown'").groupBy("video_id", "speaker_id").agg(F.min(F.struct("start_ms", "id")).alias("at"))
    number = first.withColumn("no", F.row_number().over(Window.partitionBy("video_id").orderBy("at"))).drop("at")
    named = df.join(number, ["video_id", "speaker_id"], "left")
    return named.withColumn("stable_id", F.when(F.col("no").isNull(), F.col("speaker_id")).otherwise(F.format_string("%s_spk%02d", F.col("video_id").cast("string"), "no"))).drop("no")


def overlap_flags(turns: DataFrame) -> DataFrame:
    """``overlapped``: a turn of another speaker of the recording overlaps this one."""
    side = turns.select("id", "video_id", "speaker", "start_ms", "end_ms")
    hit = interval_join(side, side).filter("l_speaker <> r_speaker").select(F.col("l_id").alias("id")).distinct()
    return turns.join(hit.withColumn("overlapped", F.lit(True)), "id", "left").withColumn("overlapped", F.coalesce("overlapped", F.lit(False)))


def flag_review_intervals(clips: DataFrame, review: DataFrame, least_ms: int = 500, least_ratio: float = 0.5, review_all: bool = False) -> DataFrame:
    """``needs_review``: one review interval covers min(least_ms, duration) and ``least_ratio`` of the clip; with ``review_all`` every clip does."""
    hits = interval_join(clips.select("id", "video_id", "start_ms", "end_ms"), review.select("video_id", "start_ms", "end_ms"))
    length = F.col("l_end_ms") - F.col("l_start_ms")
    bad = hits.filter((F.col("overlap") >= F.least(F.lit(least_ms), length)) & (F.col("overlap") / length >= least_ratio))
    found = bad.groupBy(F.col("l_id").alias("id")).agg(F.count(F.lit(1)).alias("matches"))
    return clips.join(found, "id", "left").withColumn("matches", F.coalesce("matches", F.lit(0))).withColumn("needs_review", F.lit(True) if review_all else F.col("matches") > 0)


def safe_padding(clips: DataFrame, turns: DataFrame, left_ms: int = 200, right_ms: int = 200) -> DataFrame:
    """Export bounds: the clip widened on both sides, but not over a turn of another or no speaker."""
    wide = clips.select("id", "video_id", F.greatest(F.lit(0), F.col("start_ms") - left_ms).alias("start_ms"), (F.col("end_ms") + right_ms).alias("end_ms"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "speaker")
    hits = interval_join(wide, turns.select("video_id", "start_ms", "end_ms", "speaker")).filter("not (r_speaker <=> l_speaker) or r_speaker = 'unknown'")
    low = F.max(F.when(F.col("r_start_ms") < F.col("l_s"), F.least("l_s", "r_end_ms")))
    high = F.min(F.when(F.col("r_end_ms") > F.col("l_e"), F.greatest("l_e", "r_start_ms")))
    cut = hits.groupBy(F.col("l_id").alias("id")).agg(low.alias("low"), high.alias("high"))
    out = clips.join(cut, "id", "left")
    start, end = F.greatest(F.lit(0), F.col("start_ms") - left_ms), F.col("end_ms") + right_ms
    return out.withColumn("export_start_ms", F.greatest(start, F.coalesce("low", start))).withColumn("export_end_ms", F.least(end, F.coalesce("high", end))).drop("low", "high")


def group_candidates(df: DataFrame, max_duration_ms: int = 15_000, max_gap_ms: int = 700) -> DataFrame:
    """``group_id`` of consecutive candidates of one speaker: gaps up to ``max_gap_ms``, span from the group's start up to ``max_duration_ms``, none overlapped.

    ``group_id`` is the recording with the id of the group's first candidate. Recordings are first cut where no span matters
    (speaker, gap, overlap), by a scan in time slices. The span rule is greedy, so rows of such a stretch of
    unbroken speech are read in time order, one after the other, with the open group alone kept.
    """
    order = ["start_ms", "end_ms", "id"]
    at = scans.time_levels("start_ms")
    rows = scans.neighbours(df, ["video_id"], at, order, before=["end_ms", "speaker", "overlapped"])
    fresh = F.col("prev_end_ms").isNull() | ~F.col("speaker").eqNullSafe(F.col("prev_speaker")) | F.coalesce("prev_overlapped", F.lit(False)) | F.coalesce("overlapped", F.lit(False)) | (F.col("start_ms") - F.col("prev_end_ms") > max_gap_ms)
    rows = rows.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int")).drop("prev_end_ms", "prev_speaker", "prev_overlapped")
    rows = scans.running(rows, ["video_id"], at, order, {"_stretch": F.col("_fresh")}, "sum").withColumn("_stretch", F.coalesce("_stretch", F.lit(0)) + F.col("_fresh"))
    names = ["video_id", "_stretch", *order]
    schema = StructType([*df.schema.fields, StructField("group_id", StringType())])

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, begin, first = None, 0, None
        for batch in batches:
            out = []
            for v, stretch, s, e, i in zip(*(batch.column(n).to_pylist() for n in names)):
                if first is None or of != (v, stretch) or e - begin > max_duration_ms:
                    of, begin, first = (v, stretch), s, f"{v}-{i}"
                out.append(first)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:-1]), pa.array(out, pa.string())], names=schema.names)

    return rows.drop("_fresh").repartition("video_id", "_stretch").sortWithinPartitions(*names).mapInArrow(greedy, schema)


def window_expand(df: DataFrame, window_ms: int = 10_000, hop_ms: int = 5_000) -> DataFrame:
    """Fixed windows of each clip, and a last one flush with its end; a short clip is one window."""
    n = F.col("end_ms") - F.col("start_ms")
    starts = F.when(n <= window_ms, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), n - window_ms, F.lit(hop_ms).cast("long")), F.array(n - window_ms))))
    out = df.withColumn("_w", F.explode(starts))
    return out.withColumn("window_start", F.col("start_ms") + F.col("_w")).withColumn("window_end", F.least(F.col("end_ms"), F.col("start_ms") + F.col("_w") + window_ms)).drop("_w")


def atoms(df: DataFrame) -> DataFrame:
    """Cut each recording at every border; state of each piece by its distinct active speakers: single, overlap or unknown."""
    edges = df.select("video_id", F.explode(F.array("start_ms", "end_ms")).alias("start_ms")).distinct()
    pieces = scans.neighbours(edges, ["video_id"], scans.time_levels("start_ms"), ["start_ms"], behind=["start_ms"])
    pieces = pieces.withColumnRenamed("next_start_ms", "end_ms").filter("end_ms is not null")
    pieces = pieces.withColumn("id", F.concat_ws("-", "video_id", "start_ms"))
    hits = interval_join(pieces, df.select("video_id", "start_ms", "end_ms", "speaker"))
    who = hits.groupBy(F.col("l_id").alias("id")).agg(F.array_sort(F.collect_set("r_speaker")).alias("speakers"))
    out = pieces.join(who, "id", "left").withColumn("speakers", F.coalesce("speakers", F.array().cast("array<string>")))
    return out.withColumn("state", F.when(F.size("speakers") == 0, "unknown").when(F.size("speakers") == 1, "single").otherwise("overlap"))


def _tolerant_atoms(own: DataFrame, hits: DataFrame, tolerance_ms: float) -> DataFrame:
    """Pieces of each interval between boundaries that are clustered where they lie within ``tolerance_ms`` of the one before: recording, segment_id, start_ms, end_ms, state, speakers.

    A cluster's mean stands for it, but the interval's own start and end stay. The speakers of a piece are those of the turns that hold its midpoint. Bounds are doubles until they're rounded.
    """
    epsilon = 1e-6
    clipped = hits.select(F.col("l_id").alias("segment_id"), F.greatest("l_start_ms", "r_start_ms").cast("double").alias("a"), F.least("l_end_ms", "r_end_ms").cast("double").alias("b"), F.col("r_start_ms").alias("from"), F.col("r_end_ms").alias("to"), F.col("r_speaker").alias("speaker"))
    bounds = own.select(F.col("id").alias("segment_id"), F.col("start_ms").cast("double").alias("s"), F.col("end_ms").cast("double").alias("e"))
    every = bounds.select("segment_id", F.explode(F.array("s", "e")).alias("at")).unionByName(clipped.select("segment_id", F.explode(F.array("a", "b")).alias("at")))
    by = Window.partitionBy("segment_id").orderBy("at")  # the boundaries within one interval
    fresh = F.when(F.col("at") - F.lag("at").over(by) <= tolerance_ms + epsilon, 0).otherwise(1)
    run = every.withColumn("_f", fresh).withColumn("_run", F.sum("_f").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    cluster = run.groupBy("segment_id", "_run").agg(F.avg("at").alias("mean"), F.min("at").alias("low"), F.max("at").alias("high")).join(bounds, "segment_id")
    place = F.when(F.abs(F.col("low") - F.col("s")) <= epsilon, F.col("s")).when(F.abs(F.col("high") - F.col("e")) <= epsilon, F.col("e")).otherwise(F.col("mean"))
    points = cluster.select("segment_id", place.alias("at")).unionByName(bounds.select("segment_id", F.explode(F.array("s", "e")).alias("at"))).distinct()
    pieces = points.withColumn("next", F.lead("at").over(by)).filter(F.col("next") - F.col("at") > epsilon).withColumn("mid", (F.col("at") + F.col("next")) / 2)
    inside = clipped.select(F.col("segment_id").alias("_of"), "from", "to", "speaker")
    active = pieces.join(inside, (F.col("segment_id") == F.col("_of")) & (F.col("from") <= F.col("mid") + epsilon) & (F.col("to") > F.col("mid") + epsilon), "left")
    named = active.groupBy("segment_id", "at", "next").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))
    named = named.join(own.select(F.col("id").alias("_id"), F.col("video_id").alias("recording")), F.col("segment_id") == F.col("_id"))
    state = F.when(F.size("speakers") == 0, "unknown").when(F.size("speakers") == 1, "single").otherwise("overlap")
    return named.select("recording", "segment_id", F.bround("at").cast("long").alias("start_ms"), F.bround("next").cast("long").alias("end_ms"), state.alias("state"), "speakers")


def fuse_timelines(speech: DataFrame, turns: DataFrame, tolerance_ms: float = 0) -> DataFrame:
    """Each speech interval (id, video_id, start_ms, end_ms) cut at the borders of the speakers' turns in it: single, overlap or unknown pieces.

    Columns: segment_id (the interval's), video_id, start_ms, end_ms, state, speakers, piece (number in the recording, by time) and
    is_last. A stretch without a turn is unknown. Borders that lie within ``tolerance_ms`` of the one before are one.
    """
    own = speech.select("id", "video_id", "start_ms", "end_ms")
    hits = interval_join(own, turns.select("video_id", "start_ms", "end_ms", "speaker"))
    if tolerance_ms > 0:
        return _numbered(_tolerant_atoms(own, hits, tolerance_ms))
    inside = hits.select(F.struct("l_video_id", "l_id").alias("video_id"), F.greatest("l_start_ms", "r_start_ms").alias("start_ms"), F.least("l_end_ms", "r_end_ms").alias("end_ms"), F.col("r_speaker").alias("speaker"))
    bounds = own.select(F.struct(F.col("video_id").alias("l_video_id"), F.col("id").alias("l_id")).alias("video_id"), "start_ms", "end_ms", F.lit(None).cast("string").alias("speaker"))
    key = lambda df: df.withColumn("video_id", F.to_json("video_id"))
    cut = atoms(key(bounds.unionByName(inside)))
    named = cut.join(key(bounds.select("video_id", F.col("video_id.l_video_id").alias("recording"), F.col("video_id.l_id").alias("segment_id"))), "video_id")
    return _numbered(named.drop("video_id"))


def _numbered(named: DataFrame) -> DataFrame:
    """Pieces of all intervals with their number in the recording, and whether they're its last."""
    order = ["start_ms", "end_ms", "segment_id"]
    placed = scans.ranked(named, ["recording"], scans.time_levels("start_ms"), order, "_rank")
    last = placed.groupBy(F.col("recording").alias("_of")).agg(F.max("_rank").alias("_last"))
    placed = placed.join(last, F.col("recording").eqNullSafe(F.col("_of")))
    return placed.select("segment_id", F.col("recording").alias("video_id"), "start_ms", "end_ms", "state", "speakers", (F.col("_rank") + 1).cast("int").alias("piece"), (F.col("_rank") == F.col("_last")).alias("is_last"))


def merge_atoms(pieces: DataFrame, gap_ms: int = 0) -> DataFrame:
    """Join neighbours of equal state and speakers."""
    at = scans.time_levels("start_ms")
    df = scans.neighbours(pieces.withColumn("tag", F.concat_ws("|", "state", F.array_join("speakers", "+"))), ["video_id"], at, ["start_ms"], before=["tag", "end_ms"])
    df = df.withColumn("_f", F.coalesce((F.col("prev_tag") != F.col("tag")) | (F.col("start_ms") - F.col("prev_end_ms") > gap_ms), F.lit(True)).cast("int"))
    df = scans.running(df, ["video_id"], at, ["start_ms"], {"run": F.col("_f")}, "sum").withColumn("run", F.coalesce("run", F.lit(0)) + F.col("_f"))
    return df.groupBy("video_id", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("state").alias("state"), F.first("tag").alias("tag")).drop("run")


def timeline_durations(pieces: DataFrame) -> DataFrame:
    length = F.col("end_ms") - F.col("start_ms")
    total = lambda s: F.sum(F.when(F.col("state") == s, length).otherwise(0)).alias(f"{s}_ms")
    return pieces.groupBy("video_id").agg(total("single"), total("overlap"), total("unknown"), F.count(F.lit(1)).alias("atoms"))


def derive_exclusive(df: DataFrame) -> DataFrame:
    """Each piece of a recording to the active speaker with most total time, ties by label."""
    support = df.groupBy("video_id", F.col("speaker").alias("who")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"))
    pieces = atoms(df).filter("state <> 'unknown'").withColumn("who", F.explode("speakers"))
    best = pieces.join(support, ["video_id", "who"]).groupBy("video_id", "start_ms", "end_ms").agg(F.min_by("who", F.struct(-F.col("total"), F.col("who"))).alias("speaker"))
    return merge_atoms(best.withColumn("state", F.lit("single")).withColumn("speakers", F.array("speaker"))).select("video_id", "start_ms", "end_ms", F.substring_index("tag", "|", -1).alias("speaker"))


def cap_durations(df: DataFrame, most_ms: int = 15_000) -> DataFrame:
    """Cut clips longer than ``most_ms`` into the least number of balanced parts; ``part`` from 0. Parts keep all columns, but their text, which no longer
    is that of the part: it's emptied, and ``unaligned_source_text`` has it.
    """
    n = F.ceil((F.col("end_ms") - F.col("start_ms")) / most_ms).cast("long")
    length = F.col("end_ms") - F.col("start_ms")
    cut = lambda k: F.col("start_ms") + F.bround(length * k / F.greatest(n, F.lit(1))).cast("long")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda k: F.struct(cut(k).alias("s"), cut(k + 1).alias("e")))
    out = df.select("*", F.posexplode(parts).alias("part", "_p")).withColumn("_n", F.greatest(n, F.lit(1)))
    return _capped(df, out.withColumns({"start_ms": F.col("_p.s"), "end_ms": F.col("_p.e")}).drop("_p"))


def cap_at_pauses(df: DataFrame, frames: DataFrame, most_ms: int = 15_000, search_ms: int = 1_500, min_piece_ms: int = 1_000, id_column: str = "id") -> DataFrame:
    """``cap_durations`` with each cut moved to a sustained pause near its balanced place, no part shorter than ``min_piece_ms`` or longer than ``most_ms``; ``cut_method`` of the cut at a part's end.

    ``df``: video_id, start_ms, end_ms and a distinct ``id_column``. ``frames``: video_id, at_ms, db. Where a clip's length leaves no room for both bounds, the
    upper one stands. Only clips that are too long meet frames.
    """
    from .quiet import Caps, quiet_parts

    if not 0 < min_piece_ms <= most_ms or search_ms < 0:
        raise ValueError("a piece is from 1 ms to most_ms, the search not negative")
    long = F.col("end_ms") - F.col("start_ms") > most_ms
    cut = quiet_parts(df.filter(long).select(F.col(id_column).alias("span_id"), "video_id", "start_ms", "end_ms"), frames, Caps(most_ms, search_ms, min_piece_ms))
    cut = cut.select(F.col("span_id").alias("_id"), F.col("part").cast("int").alias("part"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("method").alias("cut_method"))
    n = F.ceil((F.col("end_ms") - F.col("start_ms")) / most_ms)
    parts = df.filter(long).withColumn("_n", n).join(cut, F.col(id_column) == F.col("_id")).withColumns({"start_ms": F.col("_s"), "end_ms": F.col("_e")}).drop("_id", "_s", "_e")
    whole = df.filter(F.coalesce(~long, F.lit(True))).withColumns({"_n": F.lit(1).cast("long"), "part": F.lit(0), "cut_method": F.lit("")})
    return _capped(df, whole.unionByName(parts))


def _capped(df: DataFrame, parts: DataFrame) -> DataFrame:
    if "text" in df.columns:
        parts = parts.withColumn("unaligned_source_text", F.when(F.col("_n") > 1, F.col("text"))).withColumn("text", F.when(F.col("_n") > 1, "").otherwise(F.col("text")))
    return parts.drop("_n")


def coalesce_boundaries(df: DataFrame, tolerance_ms: int) -> DataFrame:
    """Chain-cluster the boundaries (video_id, at_ms) that lie within ``tolerance_ms`` of the one before; a cluster's mean stands for it, but the first and last boundary stay, both if one cluster has both."""
    at = scans.time_levels("at_ms")
    rows = scans.neighbours(df.select("video_id", "at_ms").distinct(), ["video_id"], at, ["at_ms"], before=["at_ms"])
    rows = rows.withColumn("_f", F.when(F.col("at_ms") - F.col("prev_at_ms") <= tolerance_ms, 0).otherwise(1))
    rows = scans.running(rows, ["video_id"], at, ["at_ms"], {"cluster": F.col("_f")}, "sum").withColumn("cluster", F.coalesce("cluster", F.lit(0)) + F.col("_f"))
    edges = rows.groupBy("video_id").agg(F.min("at_ms").alias("first"), F.max("at_ms").alias("last"))
    mean = rows.groupBy("video_id", "cluster").agg(F.avg("at_ms").alias("mean"), F.min("at_ms").alias("low"), F.max("at_ms").alias("high"), F.count(F.lit(1)).alias("n"))
    is_first, is_last = F.col("low") == F.col("first"), F.col("high") == F.col("last")
    one = F.when(is_first, F.col("first").cast("double")).when(is_last, F.col("last").cast("double")).otherwise(F.col("mean"))
    more = F.when(is_first & is_last & (F.col("first") < F.col("last")), F.col("last").cast("double"))
    return mean.join(edges, "video_id").select("video_id", F.explode(F.array_compact(F.array(one, more))).alias("at_ms"), "n")


def _cleaned(pieces: DataFrame, boundary_ms: int, gap_ms: int) -> DataFrame:
    """Merged pieces with ``tag2``, what they become, and ``action``."""
    df = scans.neighbours(merge_atoms(pieces), ["video_id"], scans.time_levels("start_ms"), ["start_ms"], ["tag"], ["tag"])
    left, right = F.col("prev_tag"), F.col("next_tag")
    length, unknown = F.col("end_ms") - F.col("start_ms"), F.col("state") == "unknown"
    single = lambda t: t.startswith("single")
    gap = unknown & (left == right) & single(left) & (length <= gap_ms)
    edge = unknown & (length <= boundary_ms) & ((left.isNull() & single(right)) | (right.isNull() & single(left)))
    df = df.withColumn("action", F.when(gap, "absorb_same_speaker_gap").when(edge, "absorb_unknown_boundary"))
    return df.withColumn("tag2", F.when(F.col("action").isNotNull(), F.coalesce(left, right)).otherwise(F.col("tag")))


def clean_timeline(pieces: DataFrame, boundary_ms: int = 200, gap_ms: int = 200, merge_ms: int = 0) -> DataFrame:
    """Absorb unknown pieces of up to ``gap_ms`` between equal single speakers, and of up to ``boundary_ms`` at an end of the recording, into their neighbour; overlap is never touched.

    ``pieces``: contiguous rows of ``atoms``. Neighbours of equal state and speakers are joined before, and after over gaps of up to ``merge_ms``.
    """
    df = _cleaned(pieces, boundary_ms, gap_ms)
    df = df.withColumn("state", F.substring_index("tag2", "|", 1)).withColumn("speakers", F.filter(F.split(F.substring_index("tag2", "|", -1), r"\+"), lambda s: s != ""))
    return merge_atoms(df.select("video_id", "start_ms", "end_ms", "state", "speakers"), merge_ms)


def cleanup_actions(pieces: DataFrame, boundary_ms: int = 200, gap_ms: int = 200) -> DataFrame:
    """What ``clean_timeline`` absorbs: video_id, action, start_ms, end_ms, speaker."""
    return _cleaned(pieces, boundary_ms, gap_ms).filter("action is not null").select("video_id", "action", "start_ms", "end_ms", F.substring_index("tag2", "|", -1).alias("speaker"))


def normalize_timeline_payload(payload: DataFrame) -> DataFrame:
    """``regular_turns`` and ``exclusive_turns`` (arrays of struct) of sidecars in all their shapes, and ``timeline_error``.

    Regular turns are regular_turns, else regular_timeline, else turns or segments with the overlap intervals behind them; exclusive
    ones are exclusive_turns, assignment_turns or assignment_timeline, else turns or segments.
    """
    first = lambda *names: F.coalesce(*(F.col(n) for n in names if n in payload.columns), F.lit(None))
    base = first("turns", "segments")
    more = first("overlap_intervals")
    regular = F.coalesce(first("regular_turns", "regular_timeline"), F.when(base.isNotNull(), F.when(more.isNotNull(), F.concat(base, more)).otherwise(base)) if "overlap_intervals" in payload.columns else base)
    exclusive = F.coalesce(first("exclusive_turns", "assignment_turns", "assignment_timeline"), base)
    error = F.when(regular.isNull(), "regular_turns_missing").when(exclusive.isNull(), "exclusive_turns_missing")
    rest = [c for c in payload.columns if c not in ("regular_turns", "exclusive_turns")]
    return payload.select(*rest, regular.alias("regular_turns"), exclusive.alias("exclusive_turns"), error.alias("timeline_error"))


def prepare_timelines(regular: DataFrame, exclusive: DataFrame, boundary_ms: int = 200, gap_ms: int = 200, merge_ms: int = 10) -> DataFrame:
    """Cleaned timelines of each recording: rows of ``timeline`` assignment (from the exclusive turns), regular and overlap (regular pieces of several speakers).

    ``assignment_valid``: no assignment piece of the recording has several speakers.
    """
    clean = lambda df: clean_timeline(atoms(df), boundary_ms, gap_ms, merge_ms)
    assignment, whole = clean(exclusive).withColumn("timeline", F.lit("assignment")), clean(regular)
    every = assignment.unionByName(whole.withColumn("timeline", F.lit("regular"))).unionByName(whole.filter("state = 'overlap'").withColumn("timeline", F.lit("overlap")))
    bad = assignment.filter("state = 'overlap'").select("video_id").distinct().withColumn("_bad", F.lit(True))
    out = every.join(bad, "video_id", "left")
    return out.select("video_id", "timeline", "start_ms", "end_ms", "state", F.substring_index("tag", "|", -1).alias("speakers"), F.col("_bad").isNull().alias("assignment_valid"))


#: Limits of the single-speaker gate.
GATE = {
    "min_duration_ms": 200, "min_speaker_ms": 200, "boundary_collar_ms": 50, "min_dominant_ratio": 0.90, "max_other_speaker_ms": 100, "max_other_speaker_ratio": 0.02, "max_overlap_ratio": 0.02,
    "max_unknown_ratio": 0.08, "max_distinct_speakers": 1, "tail_min_speaker_ms": 300, "tail_min_dominant_ratio": 0.92, "tail_max_other_speaker_ms": 100, "tail_max_other_speaker_ratio": 0.02,
    "tail_max_overlap_ratio": 0.0, "tail_max_unknown_ratio": 0.08, "tail_max_trailing_unknown_ms": 200, "tail_require_last_voice_dominant": True,
}
_EPSILON = 1e-9


def mark_tails(candidates: DataFrame) -> DataFrame:
    """``is_tail``: of each recording the candidate that says so, else the last by end, start and id. Raises when read where two say so."""
    told = F.coalesce(F.col("is_tail"), F.lit(False)) if "is_tail" in candidates.columns else F.lit(False)
    rows = candidates.withColumn("_told", told)
    last = rows.groupBy("video_id").agg(F.count_if("_told").alias("_n"), F.max_by("id", F.struct("_told", "end_ms", "start_ms", "id")).alias("_last"))
    is_tail = F.when(F.col("_n") > 1, F.raise_error(F.lit("at most one candidate of a recording may be its tail"))).otherwise(F.col("id") == F.col("_last"))
    return rows.join(last, "video_id").withColumn("is_tail", is_tail).drop("_told", "_n", "_last")


def speaker_gate(candidates: DataFrame, turns: DataFrame, limits: dict | None = None) -> DataFrame:
    """``candidates`` (id, video_id, start_ms, end_ms) with ``is_tail`` and ``gate``: passed, reasons and what they're drawn from.

    A candidate is judged on its span less a collar at both ends, which never leaves less than the evidence that it needs. The
    tail of a recording has stricter limits. ``turns``: video_id, start_ms, end_ms, speaker and, where there, state.
    Time is counted in half milliseconds, so that halved collars stay whole.
    """
    g = GATE | (limits or {})
    c = mark_tails(candidates)
    by_tail = lambda name: F.when(F.col("is_tail"), F.lit(g[f"tail_{name}"])).otherwise(F.lit(g[name]))
    length = F.col("end_ms") - F.col("start_ms")
    need = F.greatest(by_tail("min_speaker_ms"), F.least(length, F.lit(1)))
    collar = F.least(F.lit(2 * g["boundary_collar_ms"]), F.greatest(F.lit(0), length - need))
    spans = c.select(F.col("id").alias("cid"), "video_id", (2 * F.col("start_ms") + collar).alias("start_ms"), (2 * F.col("end_ms") - collar).alias("end_ms"))

    label = F.trim(F.coalesce(F.col("speaker"), F.lit("")))
    state = F.lower(F.trim(F.coalesce(F.col("state").cast("string") if "state" in turns.columns else F.lit(""), F.lit(""))))
    forced = (state == "overlap") | F.upper(label).isin(*OVERLAP_LABELS)
    who = F.when(~F.upper(label).isin(*UNKNOWN_LABELS, *OVERLAP_LABELS) & ~state.isin("unknown", "unassigned"), label)
    said = turns.select("video_id", (2 * F.col("start_ms")).alias("start_ms"), (2 * F.col("end_ms")).alias("end_ms"), who.alias("speaker"), forced.alias("forced"))

    # Each candidate is a timeline of its own: its evaluated span, cut at the borders of the turns in it.
    hits = interval_join(spans, said, span=2 * SPAN_MS)
    inside = hits.select(F.col("l_cid").alias("cid"), F.greatest("l_start_ms", "r_start_ms").alias("s"), F.least("l_end_ms", "r_end_ms").alias("e"), F.col("r_speaker").alias("speaker"), F.col("r_forced").alias("forced"))
    own = spans.select("cid", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.lit(None).cast("string").alias("speaker"), F.lit(False).alias("forced"))
    per = own.unionByName(inside).groupBy("cid").agg(F.collect_list(F.struct("s", "e", "speaker", "forced")).alias("turns"))  # the turns within one clip
    borders = F.array_sort(F.array_distinct(F.flatten(F.transform("turns", lambda t: F.array(t["s"], t["e"])))))
    cut = per.select("cid", "turns", borders.alias("b"))
    active = lambda x, y: F.filter("turns", lambda t: (t["s"] < y) & (t["e"] > x))
    piece = F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda i: F.struct((F.col("b")[i] - F.col("b")[i - 1]).alias("n"), F.array_sort(F.array_distinct(F.array_compact(F.transform(active(F.col("b")[i - 1], F.col("b")[i]), lambda t: t["speaker"])))).alias("who"), F.exists(active(F.col("b")[i - 1], F.col("b")[i]), lambda t: t["forced"]).alias("forced")))
    named = cut.select("cid", F.transform(piece, lambda q: F.struct(q["n"].alias("n"), q["who"].alias("who"), F.when(q["forced"] | (F.size(q["who"]) > 1), "overlap").when(F.size(q["who"]) == 1, "single").otherwise("unknown").alias("state"))).alias("p"))

    total = lambda keep: F.aggregate(F.filter("p", keep), F.lit(0).cast("long"), lambda acc, q: acc + q["n"])
    seen = F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda q: q["who"]))))
    m = named.withColumn("distinct_speakers", seen).withColumn("exclusive", F.transform("distinct_speakers", lambda w: F.struct(total(lambda q: (q["state"] == "single") & (F.get(q["who"], F.lit(0)) == w)).alias("n"), w.alias("speaker"))))
    m = m.withColumn("top", F.array_max(F.filter("exclusive", lambda x: x["n"] > 0))).withColumn("all", total(lambda q: F.lit(True)))
    last_known = F.aggregate("p", F.lit(0).cast("long"), lambda acc, q: F.when(q["state"] == "unknown", acc + q["n"]).otherwise(F.lit(0).cast("long")))
    voiced = F.try_element_at(F.filter("p", lambda q: q["state"] != "unknown"), F.lit(-1))
    m = m.select("cid", "distinct_speakers", "exclusive", "top", "all", total(lambda q: q["state"] == "overlap").alias("overlap"), total(lambda q: q["state"] == "unknown").alias("unknown"), total(lambda q: q["state"] == "single").alias("single"), last_known.alias("trailing"), voiced.alias("voiced"))

    r = c.join(m, c["id"] == m["cid"]).drop("cid")
    top_n = F.coalesce(F.col("top.n"), F.lit(0))
    other = F.col("single") - top_n
    ratio = lambda x: x / F.col("all")
    over = lambda n: (n / 2 > by_tail("max_other_speaker_ms") + _EPSILON) & (ratio(n) > by_tail("max_other_speaker_ratio") + _EPSILON)
    r = r.withColumn("significant", F.transform(F.filter("exclusive", lambda x: ~x["speaker"].eqNullSafe(F.col("top.speaker")) & over(x["n"])), lambda x: x["speaker"]))
    tolerated = F.filter("distinct_speakers", lambda w: ~w.eqNullSafe(F.col("top.speaker")) & ~F.array_contains("significant", w))
    prefix = lambda name: F.when(F.col("is_tail"), f"tail_{name}").otherwise(name)
    sole = (F.col("voiced.state") == "single") & (F.size("voiced.who") == 1)
    last_fine = F.coalesce(sole & (F.get("voiced.who", F.lit(0)).eqNullSafe(F.col("top.speaker")) | F.array_contains(tolerated, F.get("voiced.who", F.lit(0)))), F.lit(False))
    limit = lambda name: by_tail(name)
    rules = F.array(
        F.when(length + _EPSILON < g["min_duration_ms"], "duration_too_short"),
        F.when(F.col("top").isNull(), prefix("no_explicit_speaker")).when(top_n / 2 + _EPSILON < limit("min_speaker_ms"), prefix("speaker_evidence_too_short")),
        F.when(F.col("top").isNotNull().cast("int") + F.size("significant") > g["max_distinct_speakers"], "multiple_speakers"),
        F.when(ratio(top_n) + _EPSILON < limit("min_dominant_ratio"), prefix("dominant_coverage_below_min")),
        F.when(over(other), prefix("other_speaker_ratio_exceeded")),
        F.when(ratio(F.col("overlap")) > limit("max_overlap_ratio") + _EPSILON, prefix("overlap_ratio_exceeded")),
        F.when(ratio(F.col("unknown")) > limit("max_unknown_ratio") + _EPSILON, prefix("unknown_ratio_exceeded")),
        F.when(F.col("is_tail") & (F.col("trailing") / 2 > g["tail_max_trailing_unknown_ms"] + _EPSILON), "tail_trailing_unknown_exceeded"),
        F.when(F.col("is_tail") & F.lit(g["tail_require_last_voice_dominant"]) & ~last_fine, "tail_last_voice_not_dominant"),
    )
    reasons = F.array_compact(rules)
    gate = F.struct(
        (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"), F.col("top.speaker").alias("dominant_speaker"), "distinct_speakers", F.col("significant").alias("significant_other_speakers"), tolerated.alias("tolerated_other_speakers"),
        F.bround(ratio(top_n), 6).alias("dominant_ratio"), (top_n / 2).alias("dominant_speaker_ms"), F.bround(ratio(other), 6).alias("other_speaker_ratio"), F.bround(ratio(F.col("overlap")), 6).alias("overlap_ratio"), F.bround(ratio(F.col("unknown")), 6).alias("unknown_ratio"),
        (F.col("trailing") / 2).alias("trailing_unknown_ms"), F.col("voiced.state").alias("last_voice_state"), F.col("voiced.who").alias("last_voice_speakers"), (collar / 2).alias("boundary_collar_ms"),
    )
    return r.select(*candidates.drop("is_tail").columns, "is_tail", gate.alias("gate"))
