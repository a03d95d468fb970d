"""Scans in slices give what one window by key gives, on even and hot keys; timelines on a hot recording."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voicewright.operators import intervals, scans


def rows(rng, n, hot):
    out = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", None])
        start = rng.randrange(0, 9_000_000) if key == "hot" else rng.randrange(0, 200_000)
        out.append((i, key, start, start + rng.choice([0, 100, 4_000, 70_000]), rng.choice(["x", "y"])))
    return out


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_running_equals_window(spark, hot):
    df = spark.createDataFrame(rows(random.Random(1), 600, hot), "id long, k string, start_ms long, end_ms long, speaker string")
    w = Window.partitionBy("k").orderBy("start_ms", "id")
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select("id", F.max("end_ms").over(before).alias("a"), F.sum("end_ms").over(before).alias("b"), F.min("end_ms").over(behind).alias("c"), F.lag("speaker").over(w).alias("d"), F.lead("id").over(w).alias("e"), (F.row_number().over(w) - 1).alias("f"))
    levels, order = scans.time_levels("start_ms"), ["start_ms", "id"]
    got = scans.running(df, ["k"], levels, order, {"a": F.col("end_ms")})
    got = scans.running(got, ["k"], levels, order, {"b": F.col("end_ms")}, "sum")
    got = scans.running(got, ["k"], levels, order, {"c": F.col("end_ms")}, "min", after=True)
    got = scans.neighbours(got, ["k"], levels, order, ["speaker"], ["id"])
    got = scans.ranked(got, ["k"], levels, order, "f").select("id", "a", F.nullif("b", F.lit(0)).alias("b"), "c", F.col("prev_speaker").alias("d"), F.col("next_id").alias("e"), "f")
    key = lambda df: sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())
    assert key(got) == key(want.withColumn("b", F.nullif("b", F.lit(0))))


def test_islands_and_groups_of_a_hot_recording(spark):
    data = [(i, k or "none", s, e, w) for i, k, s, e, w in rows(random.Random(2), 500, 0.9)]
    df = spark.createDataFrame(data, "id long, video_id string, start_ms long, end_ms long, speaker string")
    merged = {}
    for k in {r[1] for r in data}:
        reach, now = None, None
        for _, _, s, e, _ in sorted((r for r in data if r[1] == k), key=lambda r: (r[2], r[3])):
            if reach is None or s - reach > 700:
                now = [k, s, e, 0]
                merged[k, s] = now
            reach = max(e, reach or e)
            now[2], now[3] = reach, now[3] + 1
    assert sorted(map(tuple, merged.values())) == sorted((r.video_id, r.start_ms, r.end_ms, r.parts) for r in intervals.merge_intervals(df, ["video_id"], 700).collect())

    flagged = df.withColumn("overlapped", F.col("id") % 11 == 0)
    want, state = {}, None
    for i, k, s, e, w in sorted(data, key=lambda r: (r[1], r[2], r[3], r[0])):
        crossed = i % 11 == 0
        if state is None or state[0] != k or state[4] != w or state[3] or crossed or s - state[2] > 700 or e - state[1] > 15_000:
            state, first = [k, s, e, crossed, w], i
        state[2], state[3] = e, crossed
        want[i] = f"{k}-{first}"
    assert {r.id: r.group_id for r in intervals.group_candidates(flagged).collect()} == want


def test_turns_of_several_speakers(spark):
    clips = spark.createDataFrame([(1, "v", 0, 1000), (2, "v", 2000, 3000)], "id long, video_id string, start_ms long, end_ms long")
    turns = spark.createDataFrame(
        [("v", 0, 700, "A", None, False, "unknown"), ("v", 0, 500, None, [" B ", "A", ""], False, "unknown"), ("v", 2000, 2900, "C", None, True, None), ("v", 2000, 2100, "ignored", [], False, None)],
        "video_id string, start_ms long, end_ms long, speaker string, speaker_ids array<string>, overlap boolean, state string",
    )
    got = {r.id: (r.speaker_id, r.speaker_ms, r.overlap_detected) for r in intervals.label_speakers(clips, turns).collect()}
    assert got == {1: ("A", 500, True), 2: ("C", 900, True)}
    plain = {r.id: r.overlap_detected for r in intervals.label_speakers(clips, turns.drop("overlap")).collect()}
    assert plain == {1: True, 2: False}


def test_pairing_with_hot_pools_and_copies(spark):
    """Picks are those of the plain rule, with a pool of 90 % of the clips, an audio with hundreds of copies, and a path that names several digests."""
    import hashlib

    from voicewright.operators import pairing

    rng = random.Random(5)
    clips = []
    for i in range(500):
        audio = "hot" if rng.random() < 0.4 else f"a{rng.randrange(60)}" if rng.random() < 0.5 else f"one{i}"
        path = f"p{i % 3}" if i < 9 else f"path{i}"
        clips.append((f"id-{rng.randrange(10**6):06d}-{i}", "v" if rng.random() < 0.9 else f"w{i % 5}", rng.choice(["s", "s", "t"]), path, audio, "said", rng.choice([300, 900, 2_000, 9_000, 12_000]), True, True))
    df = spark.createDataFrame(clips, "item_id string, video_id string, speaker_id string, audio_path string, audio_sha256 string, final_text string, duration_ms long, accepted boolean, speaker_pure boolean").repartition(5)
    got = {r.item_id: (r.reason, r.prompt_id, r.prompt_text) for r in pairing.pair_references(df).collect()}
    for c in clips:
        if c[6] < 400:
            assert got[c[0]][0] == "target_duration_out_of_range"
            continue
        pool = sorted(o[0] for o in clips if o[1:3] == c[1:3] and 1_000 <= o[6] <= 10_000 and o[0] != c[0] and o[3] != c[3] and o[4] != c[4])
        pick = pool[int(hashlib.sha256(f"42:{c[0]}".encode()).hexdigest(), 16) % len(pool)] if pool else None
        assert got[c[0]] == (None if pool else "no_distinct_same_recording_speaker_reference", pick, "said" if pool else None), c

    records = spark.createDataFrame([("src", "a", "x", 0, None, 2.0), ("src", "a", "y", 1, None, None), ("src", "a", "z", 2, "own", 0.5), ("src", "b", "u", 3, None, 3.0)], "source string, speaker_id string, id string, ordinal long, prompt_id string, duration double")
    kept = {r.id: r.prompt_id for r in pairing.pair_prompts_epoch(records, 0).collect()}
    assert kept == {"x": "y", "y": "x", "z": "own", "u": None}
    assert {r.id for r in pairing.pair_prompts_epoch(records, 0, unpaired="drop").collect()} == {"x", "y", "z"}
    with pytest.raises(Exception, match="no distinct same-speaker prompt for u"):
        pairing.pair_prompts_epoch(records, 0, unpaired="fail").collect()
