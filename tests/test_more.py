"""Quiet cuts, draws, the caller's models, publishing, uniqueness within joins, present fields."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from voicewright.operators import audio, hooks, intervals, quiet, sampling, weighting
from voicewright.sources import manifest


def plain_cuts(start, end, frames, rule, pause=180, penalty=1.5):
    """The rules by loops over all frames."""
    def level(pos, lo, hi):
        near = [10 ** (d / 10) for p, d in frames if abs(p - pos) <= pause / 2 and lo <= p <= hi]
        return 10 * math.log10(max(sum(near) / len(near), 1e-12))

    cuts = [start]
    if isinstance(rule, quiet.Pauses):
        while end - cuts[-1] > rule.most_ms:
            c = cuts[-1]
            target = c + rule.target_ms
            lo, hi = max(c + rule.least_ms, target - rule.search_ms), min(c + rule.most_ms, end - rule.least_ms, target + rule.search_ms)
            found = [(round(level(p, -1, 10**12) + penalty * abs(p - target) / rule.search_ms, 9), abs(p - target), p) for p, _ in frames if lo <= p <= hi]
            cuts.append(min(found)[2] if found else min(target, end - rule.least_ms))
    else:
        n = max(1, math.ceil((end - start) / rule.most_ms))
        for i in range(1, n):
            lo, hi = max(cuts[-1] + rule.least_ms, end - (n - i) * rule.most_ms), min(cuts[-1] + rule.most_ms, end - (n - i) * rule.least_ms)
            target = min(hi, max(lo, start + round((end - start) * i / n)))
            a, b = max(lo, target - rule.search_ms), min(hi, target + rule.search_ms)
            found = [(round(level(p, a, b) + penalty * abs(p - target) / max(1, b - a), 9), abs(p - target), p) for p, _ in frames if a <= p <= b] if b > a else []
            cuts.append(min(hi, max(lo, min(found)[2] if found else target)))
    return list(zip(cuts, [*cuts[1:], end]))


@pytest.mark.parametrize("rule", [quiet.Pauses(1_200, 3_000, 300, 200), quiet.Caps(1_500, 300, 200), quiet.Caps(1_000, 0, 900)])
def test_quiet_parts(spark, rule):
    rng = random.Random(7)
    frames = {v: [(10 * i, rng.choice([-70, -50, -30, -20]) + rng.random()) for i in range(n)] for v, n in (("v", 2_000), ("w", 900), ("gap", 300))}
    spans = [("a", "v", 30, 19_990), ("b", "w", 0, 2_000), ("c", "w", 505, 9_000), ("d", "none", 0, 7_300), ("e", "v", 5_000, 5_000), ("f", "gap", 100, 12_000)]
    got = {}
    df = quiet.quiet_parts(spark.createDataFrame(spans, "span_id string, video_id string, start_ms long, end_ms long").repartition(3), spark.createDataFrame([(v, p, d) for v, f in frames.items() for p, d in f], "video_id string, at_ms long, db double"), rule)
    for r in df.orderBy("span_id", "part").collect():
        got.setdefault(r.span_id, []).append((r.start_ms, r.end_ms))
    for i, v, s, e in spans:
        assert got[i] == plain_cuts(s, e, frames.get(v, []), rule), (i, rule)


def test_cap_at_pauses_bounds_and_text(spark):
    clips = spark.createDataFrame([(1, "v", 0, 31_000, "all of it"), (2, "v", 500, 9_000, "short")], "id long, video_id string, start_ms long, end_ms long, text string")
    frames = spark.createDataFrame([("v", 10 * i, -20.0 if abs(i - 1100) > 12 and abs(i - 2050) > 12 else -80.0) for i in range(3_100)], "video_id string, at_ms long, db double")
    rows = intervals.cap_at_pauses(clips, frames).orderBy("id", "part").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.text, r.unaligned_source_text) for r in rows] == [(1, 0, 10_970, "", "all of it"), (1, 10_970, 20_530, "", "all of it"), (1, 20_530, 31_000, "", "all of it"), (2, 500, 9_000, "short", None)]
    assert [r.cut_method for r in rows] == ["sustained_pause", "sustained_pause", "", ""]
    even = intervals.cap_durations(clips).orderBy("id", "part").collect()
    assert [r.text for r in even] == ["", "", "", "short"] and even[0].unaligned_source_text == "all of it"


def test_energy_vad_splits_long_speech(spark):
    level = lambda i: -60.0 if i < 50 or i >= 4_000 else -80.0 if abs(i - 1_250) < 15 or abs(i - 2_500) < 15 else -10.0
    frames = spark.createDataFrame([("p", i, level(i), level(i) + 3) for i in range(4_100)], "path string, frame long, rms_dbfs double, peak_dbfs double")
    rows = audio.energy_vad(frames, "path").orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.part, r.is_last) for r in rows] == [(400, 12_450, 0, False), (12_450, 40_100, 1, True)]
    assert all(r.peak_dbfs == -7.0 and -25 < r.mean_dbfs < -9 for r in rows)


def test_sampling_by_mass(spark):
    rows = spark.createDataFrame([(f"{s}{i}", s) for s, n in (("a", 5), ("b", 50), ("c", 1)) for i in range(n)], "item_id string, source string")
    every = sampling.sample_by_mass(rows, {"a": 2.0, "b": 1.0, "c": 1.0, "empty": 9.0, "zero": 0.0}, 3_998, 1, replicas=4).collect()
    assert sorted(r.draw for r in every) == list(range(4_000))
    share = {s: sum(r.source == s for r in every) / 4_000 for s in "abc"}
    assert abs(share["a"] - 0.5) < 0.03 and abs(share["b"] - 0.25) < 0.03 and abs(share["c"] - 0.25) < 0.03
    for item in {r.item_id for r in every if r.source == "a"}:
        assert abs(sum(r.item_id == item for r in every) / 2_000 - 0.2) < 0.04
    ranks = [sampling.sample_by_mass(rows, {"a": 2.0, "b": 1.0, "c": 1.0, "empty": 9.0}, 3_998, 1, replicas=4, rank=k).collect() for k in range(4)]
    assert sorted((r.draw, r.item_id) for part in ranks for r in part) == sorted((r.draw, r.item_id) for r in every) and {r.draw % 4 for r in ranks[2]} == {2}
    assert sampling.sample_by_mass(rows, {"a": 1.0}, 50, 1, epoch=1).collect() != sampling.sample_by_mass(rows, {"a": 1.0}, 50, 1).collect()
    with pytest.raises(ValueError):
        sampling.sample_by_mass(rows, {"a": 0.0}, 5, 1)
    assert sum(r.times for r in sampling.weighted_sample(rows, {"a": 70, "c": 3, "empty": 5, "b": 0}, 1).collect()) == 73


def test_models_errors_are_rows(spark):
    def load():
        def model(rows):
            if any(r["text"] is None for r in rows):
                raise ValueError("no text")
            return [{"transcript": r["text"], "uncertain_spans": [r["text"][:1]] if r["text"] else None} if r["text"] != "odd" else {"transcript": 5} if len(rows) else None for r in rows]

        return model

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, "b" * 500, "odd", "", "c"])], "id long, text string").coalesce(1)
    got = {r.id: r for r in hooks.with_model(df, load, ("text",), "transcript string, uncertain_spans array<string>", "fake", batch_bytes=300, keys={"model_id": "m", "prompt_sha256": "p"}).collect()}
    assert [got[i].status for i in range(6)] == ["ok", "error", "ok", "error", "ok", "ok"]
    assert got[1].error == "ValueError: no text" and got[3].transcript is None and got[2].transcript == "b" * 500 and got[5].model_id == "m" and got[5].prompt_sha256 == "p"
    assert hooks.with_model(df.limit(0), load, ("text",), "transcript string", "fake2").count() == 0
    with pytest.raises(ValueError):
        hooks.with_model(df, load, ("text",), "text string", "fake3")
    heard = hooks.hook(df.select("id", F.lit("f.wav").alias("audio_path"), F.lit("said").alias("transcript")), "assess", lambda: lambda rows: [{"assessment": {"complete": True}} for _ in rows], "judge-1")
    assert heard.first().assessment == {"complete": True} and heard.first().model_id == "judge-1"


def test_publish_all_or_nothing(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text('{"id": "a"}\n{"id": "b"}\n')
    rows = spark.read.json(str(source))
    tables = {"train": rows.filter("id = 'a'"), "excluded": rows.filter("id = 'b'")}
    manifest.publish(tables, str(tmp_path / "out" / "one"), [str(source)], "train")
    assert [r.id for r in spark.read.json(str(tmp_path / "out" / "one" / "train")).collect()] == ["a"]
    with pytest.raises(FileExistsError):
        manifest.publish(tables, str(tmp_path / "out" / "one"), [str(source)])
    with pytest.raises(ValueError, match="no eligible"):
        manifest.publish({"train": rows.limit(0), "excluded": rows}, str(tmp_path / "out" / "two"), [str(source)], "train")
    before = manifest.snapshot(spark, [str(source)])
    source.write_text('{"id": "a"}\n{"id": "c"}\n')
    with pytest.raises(ValueError, match="changed"):
        manifest.publish(tables, str(tmp_path / "out" / "three"), [str(source)], "train", before)
    with pytest.raises(Exception):
        manifest.publish({"train": rows.select(F.raise_error(F.lit("midway")).alias("id"))}, str(tmp_path / "out" / "four"), [str(source)])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["one"]


def test_unique_within_the_join(spark):
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    side = lambda *ids: spark.createDataFrame([(i, "success", "x", "m") for i in ids], "id string, status string, hypothesis string, model_id string")
    assert weighting.weight_manifest(one, side("a", "b")).count() == 2
    for p, s in ((one.unionByName(one.limit(1)), side("a", "b")), (one, side("a", "b", "b")), (one, side("a", "b", "z", "z")), (one.unionByName(spark.createDataFrame([(None, "t")], one.schema)), side("a", "b"))):
        with pytest.raises(Exception, match="duplicate or empty"):
            weighting.weight_manifest(p, s, on_asr_error="exclude").select("reason").collect()
    assert weighting.weight_manifest(one.unionByName(one.limit(1)), side("a", "b"), unique=False).count() == 3


def test_present_fields(spark, tmp_path):
    path = tmp_path / "asr.jsonl"
    lines = [{"id": "a", "status": "success", "hypothesis": None, "text": "x"}, {"id": "b", "status": "success", "text": "y"}, {"id": "c", "status": "success", "text": "z", "reference": None}]
    path.write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    secondary = manifest.read_present(spark, str(path), "id string, status string, hypothesis string, text string, reference string")
    primary = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, text string")
    got = {r.id: r.reason for r in weighting.weight_manifest(primary, secondary, on_asr_error="exclude").collect()}
    assert got == {"a": "secondary_transcript_missing", "b": None, "c": "primary_transcript_binding_mismatch"}
    path.write_text("[1]\n")
    with pytest.raises(Exception):
        manifest.read_present(spark, str(path), "id string").collect()


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s", 1.0), ("a", "t", 1.0), ("b", "s", None), ("b", "s", 99.0)], "id string, source string, duration double")
    assert manifest.filter_source_records(rows, unique="id", source="source").count() == 3
    with pytest.raises(Exception, match="duplicate record id"):
        manifest.filter_source_records(rows, unique="id").collect()
    assert manifest.require_sources(rows, ["s", "t"]) == {"s": 3, "t": 1}
    with pytest.raises(ValueError, match="none"):
        manifest.require_sources(rows, ["s", "none"])
    for i in (0, 1):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / "m.json").write_text(json.dumps({"id": f"x{i}"}))
    both = manifest.merge_run_outputs(spark, [str(tmp_path / "r1"), str(tmp_path / "r0")], "id string")
    assert [(r.run, r.id) for r in both.orderBy("run").collect()] == [(0, "x1"), (1, "x0")]
    lines = tmp_path / "t.jsonl"
    lines.write_text('{"id": "a", "text": "t", "speed": 1.5}\nnot json\n\n{"id": "b"}\n')
    assert [(r.id, r.speed, r.ref_audio) for r in manifest.read_manifest_lenient(spark, str(lines)).orderBy("id").collect()] == [("a", 1.5, None), ("b", None, None)]
    (tmp_path / "l0.jsonl").write_text('{"id": "q"}\n')
    (tmp_path / "shards.lst").write_text("# audio labels\na0.tar l0.jsonl 1 2.5\n")
    got = manifest.read_shard_records(spark, str(tmp_path / "shards.lst"), "id string").collect()
    assert [r.id for r in got] == ["q"] and got[0].labels.endswith("l0.jsonl")
