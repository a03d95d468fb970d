"""Facts of single operators, files and streams on small inputs."""

import io
import json
import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicewright.functions import scoring, text
from voicewright.operators import evaluation, intervals, items, pairing, weighting
from voicewright.sources import manifest, media
from voicewright.streaming import jobs

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scoring(spark):
    row = one(spark, scoring.normalize_for_scoring(F.lit(" A é\tကိ၊​1+$")).alias("n"), scoring.disagreement(F.lit("ab"), F.lit("abcccc")).alias("d"), *(scoring.reliability_weight(F.lit(d), g).alias(f"w{i}") for i, (d, g) in enumerate([(0.2, 3.0), (0.5, 3.0), (0.6, 3.0), (2.0, 3.0), (0.5, 1.0)])))
    assert row.n == "Aéကိ1" and row.d == 2
    assert np.allclose(row[2:], [0.512, 0.125, 0.1, 0.1, 0.5])
    with pytest.raises(ValueError):
        scoring.reliability_weight(F.lit(0.5), w_min=0.0)
    import hashlib

    got = spark.createDataFrame([(f"42:{i}", 7 + i) for i in range(50)], "k string, n long").select("k", "n", scoring.digest_mod(F.col("k"), F.col("n")).alias("m"), scoring.u64_of(F.col("k")).alias("u")).collect()
    assert all(r.m == int.from_bytes(hashlib.sha256(r.k.encode()).digest(), "big") % r.n and int(r.u) == int.from_bytes(hashlib.sha256(r.k.encode()).digest()[:8], "big") for r in got)


def test_composed_characters_need_no_composing(spark):
    import unicodedata

    inside = lambda c: any(a <= c <= b for a, b in scoring.COMPOSED)
    seconds = set()
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if parts and not parts[0].startswith("<"):
            seconds |= {int(x, 16) for x in parts[1:]}
    safe = [c for c in range(0x110000) if inside(c)]
    assert not [c for c in safe if c in seconds or unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c)]
    said = ["é", "e\u0301", "가", "\u1100\u1161", "Å", "\u212b", None, "", "क\u093c", "a\u0323\u0302", "漢字かな"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").select("i", scoring.nfc(F.col("x")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [None if x is None else unicodedata.normalize("NFC", x) for x in said]


PRIMARY = "id string, text string, audio_sha256 string, loss_weight double"
RESULT = "id string, status string, error string, hypothesis string, reference string, audio_sha256 string, model_id string, canonical struct<cer:double>"


def test_weight_manifest(spark):
    p = spark.createDataFrame([("a", "abcd!", "1", 9.0), ("b", "Aé", "2", 9.0), ("c", "!?", "3", 9.0), ("d", "x", "4", 9.0), ("e", "y", "5", 9.0)], PRIMARY)
    s = spark.createDataFrame([("a", "success", "ab", None, "m"), ("b", "passed", "", "2", None), ("d", "ok", "x", None, "m"), ("z", "success", "x", None, "m")], "id string, status string, hypothesis string, audio_sha256 string, model_id string")
    out = weighting.weight_manifest(p, s, on_asr_error="exclude")
    got = {r.id: r for r in out.collect()}
    assert (got["a"].disagreement, got["a"].pseudo_label_weight, got["a"].loss_weight) == (0.5, 0.125, 0.125)
    assert (got["b"].disagreement, got["b"].pseudo_label_weight, got["b"].secondary_model) == (1.0, 0.1, "unspecified")
    assert [got[k].reason for k in "cde"] == ["empty_normalized_primary", "secondary_asr_failed", "secondary_asr_missing"]
    assert {r.pseudo_label_weight for r in weighting.weight_manifest(p).filter("reason is null").collect()} == {1.0}
    with pytest.raises(Exception, match="secondary_asr_failed"):
        weighting.weight_manifest(p.filter("id = 'd'"), s).collect()
    with pytest.raises(Exception, match="must be a string"):
        weighting.weight_manifest(spark.createDataFrame([("n", None, "1", 1.0)], PRIMARY)).collect()
    for left, right in ((p.unionByName(p), s), (p, s.unionByName(s))):
        with pytest.raises(Exception, match="duplicate"):
            weighting.weight_manifest(left, right, on_asr_error="exclude").collect()
    kept = out.filter("reason is null").withColumn("reliability", weighting.reliability())
    assert weighting.verify_manifest(kept, accepted=2).count() == 0
    assert [r.reason for r in weighting.verify_manifest(kept, stage="S").collect()] == ["manifest_mixes_stages"] * 2
    assert [r.reason for r in weighting.verify_manifest(kept.withColumn("loss_weight", F.lit(1.0)), accepted=3).collect()].count("conflicting_weight_aliases") == 2
    report = weighting.weight_report(out, unused=weighting.unused_secondary(p, s)).first()
    assert (report.input_rows, report.accepted_rows, report.unused_secondary_rows) == (5, 2, 1) and report.secondary_models == {"m": 1, "unspecified": 1}


def test_asr_evidence_rules_in_order(spark):
    rows = {
        "secondary_asr_failed": ("bad", "e", None, None, None, None), "secondary_asr_error": ("success", "e", None, None, None, None), "secondary_asr_status_missing": (None, None, "ab", None, None, None),
        "secondary_transcript_missing": ("complete", None, None, None, None, None), "primary_transcript_binding_mismatch": ("completed", None, "ab", "other", None, None),
        "audio_sha256_required": ("success", "", "ab", "ab", None, None), "audio_sha256_mismatch": ("success", None, "ab", "ab", "2", None), None: ("success", None, "ab", "ab", "1", (0.0,)),
        "archived_cer_disagrees_with_recomputed_transcripts": ("success", None, "ab", None, "1", (0.1,)), "invalid_canonical_evidence": ("success", None, "ab", None, "1", (None,)),
    }
    p = spark.createDataFrame([(str(i), "ab", "1", 1.0) for i in range(len(rows))], PRIMARY)
    s = spark.createDataFrame([(str(i), *r[:5], "m", r[5]) for i, r in enumerate(rows.values())], RESULT)
    got = {int(r.id): r.reason for r in weighting.weight_manifest(p, s, on_asr_error="exclude", require_audio_sha=True).collect()}
    assert [got[i] for i in range(len(rows))] == list(rows)
    archived = spark.createDataFrame([("0", None, None, "ab", None, None, "m", (0.0,)), ("1", None, None, "ab", None, None, "m", None)], RESULT)
    got = {r.id: r.reason for r in weighting.weight_manifest(p.filter("id < '2'"), archived, on_asr_error="exclude", asr_format="archived").collect()}
    assert got == {"0": None, "1": "archived_asr_requires_canonical_evidence"}


def test_pairing_takes_a_distinct_clip_whatever_the_order(spark):
    import hashlib

    rows = [(f"i{k}", "v1" if k < 8 else "v2", "s", f"p{k % 6}", f"sha{k % 7}", "text", 2000 + k, True, True) for k in range(10)]
    kind = "item_id string, video_id string, speaker_id string, audio_path string, audio_sha256 string, final_text string, duration_ms long, accepted boolean, speaker_pure boolean"
    want = {}
    for r in rows:
        pool = sorted((x for x in rows if x[1] == r[1] and x[0] != r[0] and x[3] != r[3] and x[4] != r[4]), key=lambda x: x[0])
        want[r[0]] = pool[int.from_bytes(hashlib.sha256(f"42:{r[0]}".encode()).digest(), "big") % len(pool)][0] if pool else None
    for df in (spark.createDataFrame(rows, kind), spark.createDataFrame(rows[::-1], kind).repartition(5)):
        assert {r.item_id: r.prompt_id for r in pairing.pair_references(df).collect()} == want
    alone = pairing.pair_references(spark.createDataFrame(rows[:1], kind)).first()
    assert alone.reason == "no_distinct_same_recording_speaker_reference"


def test_short_clip_quota(spark):
    df = spark.range(117).select(F.col("id").cast("string").alias("item_id"), (F.col("id") >= 97).alias("is_short"))
    assert pairing.short_clip_quota(df).groupBy("is_short").count().orderBy("is_short").collect()[1][1] == 3


def test_group_candidates_keeps_the_span_rule(spark):
    rows = [(i, 1, "a", 4000 * i, 4000 * i + 3900, False) for i in range(8)] + [(8, 1, "b", 32_000, 33_000, False), (9, 1, "b", 33_100, 34_000, True), (10, 2, "a", 0, 20_000, False)]
    df = spark.createDataFrame(rows, "id long, video_id long, speaker string, start_ms long, end_ms long, overlapped boolean")
    got = {}
    for r in intervals.group_candidates(df).collect():
        got.setdefault(r.group_id, []).append(r.id)
    assert sorted(sorted(v) for v in got.values()) == [[0, 1, 2], [3, 4, 5], [6, 7], [8], [9], [10]]


def test_interval_join_is_the_plain_join(spark):
    s = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("video_id"), (F.col("id") * 7919 % 200_000).alias("start_ms")).withColumn("end_ms", F.col("start_ms") + F.col("id") * 331 % 90_000)
    a = s.toPandas()
    want = sum(((a.video_id == r.video_id) & (a.start_ms < r.end_ms) & (r.start_ms < a.end_ms) & (a.end_ms > a.start_ms)).sum() for r in a.itertuples() if r.end_ms > r.start_ms)
    assert intervals.interval_join(s, s).count() == want


def test_text(spark):
    t = F.lit
    row = one(spark, text.max_token_run(t("a b b B c")).alias("run"), text.max_fourgram(t("abcdabcd abcd")).alias("gram"), text.safe_id(t("--a b/é.wav")).alias("safe"), text.merge_text(F.array(t("ab"), t("cd"), t("?"), t("e"))).alias("merged"), text.extract_llm_json(t('```json\n{"a": 1}\n```')).alias("json"), text.add_punctuation(t("好")).alias("dot"), text.clean_text(t("# Hi **x**​ 😀 y")).alias("clean"), text.transcript_guard(t("abcd" * 100), t(1.0)).alias("guard"), text.safe_id(t("///")).alias("none"))
    assert row.asDict() == {"run": 3, "gram": 3, "safe": "a-b-.wav", "merged": "ab cd?e", "json": '{"a": 1}', "dot": "好。", "clean": "Hi **x** y", "guard": ["transcript_too_long_for_audio", "pathological_repetition"], "none": "item"}


def test_finalize_routes(spark):
    names = ["speech_complete", "natural_short_response", "english_natural_code_switch", "english_audio_text_consistent", *items.VETOES]
    cases = {"auto_accept": {}, "boundary_repair": {"speech_complete": False}, "excluded_from_dataset": {"clipping": True}, "auto_accept_with_warning": {"english_natural_code_switch": False}, "mixed": {"english_natural_code_switch": False}, "apart": {"english_audio_text_consistent": False}}
    said = {"auto_accept_with_warning": "မြန်မာ မင်္ဂလာ စကား hi"}
    rows = spark.createDataFrame([(k, 3000, []) for k in (*cases, "retry", "two")], "item_id string, duration_ms long, blocking array<string>")
    run = lambda k: [("ok", said.get(k, "hello there"))]
    asr = spark.createDataFrame([(k, run(k)) for k in cases] + [("two", run("two") * 2)], "item_id string, runs array<struct<status:string,transcript:string>>")
    good = {n: n not in items.VETOES for n in names}
    quality = spark.createDataFrame([(k, "ok", tuple({**good, **v}[n] for n in names)) for k, v in cases.items()], f"item_id string, status string, assessment struct<{','.join(n + ':boolean' for n in names)}>")
    got = {r.item_id: r for r in items.finalize_items(rows, asr, quality, text_limits={"max_latin": 1.0}).collect()}
    for k in ("auto_accept", "boundary_repair", "excluded_from_dataset", "auto_accept_with_warning"):
        assert got[k].route == k and got[k].accepted == k.startswith("auto")
    assert got["auto_accept_with_warning"].warnings == ["english_code_switch_review"] and got["auto_accept"].final_text == "hello there"
    assert got["mixed"].reasons == ["unnatural_english"] and got["apart"].reasons == ["english_audio_text_mismatch"]
    assert got["retry"].reasons == ["gemini_asr_not_run"] and got["two"].reasons == ["gemini_asr_failed"] and got["two"].route == "asr_retry"
    strict = {r.item_id: r.reasons for r in items.finalize_items(rows, asr, quality).collect()}
    assert strict["auto_accept"] == ["excessive_english"]


def test_label_speakers_rules(spark):
    c = spark.createDataFrame([(1, "v", 0, 1000), (2, "v", 5000, 6000), (3, "v", 9000, 9500)], "id long, video_id string, start_ms long, end_ms long")
    t = spark.createDataFrame(
        [("v", 0, 400, "a", 0.9, "x", None), ("v", 400, 1000, "unknown", 0.1, None, None), ("v", 0, 50, "b", 2.0, None, None), ("v", 300, 400, "a", 0.5, "y", None), ("v", 5000, 5400, "b", None, None, None), ("v", 5400, 6000, "c", 0.8, None, "unassigned"), ("v", 9000, 9100, "", 0.5, None, "overlap")],
        "video_id string, start_ms long, end_ms long, speaker string, confidence double, confidence_source string, state string",
    )
    over = spark.createDataFrame([("v", 5000, 5021)], "video_id string, start_ms long, end_ms long")
    got = {r.id: r for r in intervals.label_speakers(c, t, over).collect()}
    assert (got[1].speaker_id, got[1].speaker_ms, got[1].speaker_confidence, got[1].speaker_confidence_source, got[1].overlap_detected) == ("a", 500, 0.5, "x+y", False)
    assert (got[2].speaker_id, got[2].speaker_confidence, got[2].speaker_confidence_source, got[2].acoustic_overlap_ms, got[2].overlap_detected) == ("b", None, "unavailable_in_acoustic_turns", 21, True)
    assert (got[3].speaker_id, got[3].speaker_confidence, got[3].speaker_confidence_source, got[3].overlap_detected) == ("unknown", 0.0, "no_speaker_evidence", True)
    less = {r.id: r.overlap_detected for r in intervals.label_speakers(c, t, over.withColumn("end_ms", F.lit(5020))).collect()}
    assert less[2] is False


def test_boundaries_and_timelines(spark):
    b = spark.createDataFrame([("v", x) for x in (0, 5, 9)] + [("w", x) for x in (0, 50, 54, 100)], "video_id string, at_ms long")
    got = sorted((r.video_id, r.at_ms) for r in intervals.coalesce_boundaries(b, 10).collect())
    assert got == [("v", 0.0), ("v", 9.0), ("w", 0.0), ("w", 52.0), ("w", 100.0)]
    turns = spark.createDataFrame([("v", 0, 1000, "a"), ("v", 1150, 2000, "a"), ("v", 1900, 2500, "b"), ("v", 3000, 4000, "b")], "video_id string, start_ms long, end_ms long, speaker string")
    clean = [(r.start_ms, r.end_ms, r.tag) for r in intervals.clean_timeline(intervals.atoms(turns)).orderBy("start_ms").collect()]
    assert clean == [(0, 1900, "single|a"), (1900, 2000, "overlap|a+b"), (2000, 2500, "single|b"), (2500, 3000, "unknown|"), (3000, 4000, "single|b")]
    assert [tuple(r) for r in intervals.cleanup_actions(intervals.atoms(turns)).collect()] == [("v", "absorb_same_speaker_gap", 1000, 1150, "a")]
    alone = [(r.start_ms, r.end_ms, r.speaker) for r in intervals.derive_exclusive(turns).orderBy("start_ms").collect()]
    assert alone == [(0, 1000, "a"), (1150, 2000, "a"), (2000, 2500, "b"), (3000, 4000, "b")]
    both = intervals.prepare_timelines(turns, intervals.derive_exclusive(turns))
    assert {r.timeline: r.n for r in both.groupBy("timeline").agg(F.count("*").alias("n")).collect()} == {"assignment": 4, "regular": 5, "overlap": 1}
    assert {r.assignment_valid for r in both.collect()} == {True} and {r.assignment_valid for r in intervals.prepare_timelines(turns, turns).collect()} == {False}
    speech = spark.createDataFrame([(7, "v", 900, 1200), (8, "v", 2600, 2700)], "id long, video_id string, start_ms long, end_ms long")
    fused = [(r.segment_id, r.start_ms, r.end_ms, r.state, r.speakers, r.is_last) for r in intervals.fuse_timelines(speech, turns).orderBy("piece").collect()]
    assert fused == [(7, 900, 1000, "single", ["a"], False), (7, 1000, 1150, "unknown", [], False), (7, 1150, 1200, "single", ["a"], False), (8, 2600, 2700, "unknown", [], True)]


def test_speaker_gate_limits(spark):
    """Another speaker of 100 ms, or of 2 % of the span, is tolerated; more of both isn't. The last clip has stricter limits."""
    c = spark.createDataFrame([(1, "v", 0, 5100), (2, "v", 10_000, 15_100), (3, "w", 0, 1000), (4, "w", 2000, 2250), (5, "x", 0, 400)], "id long, video_id string, start_ms long, end_ms long")
    t = spark.createDataFrame([("v", 0, 4000, "a", None), ("v", 4000, 4100, "b", None), ("v", 4100, 5100, "a", None), ("v", 10_000, 14_000, "a", None), ("v", 14_000, 14_101, "b", None), ("v", 14_101, 15_100, "a", None), ("w", 0, 700, "a", None), ("w", 2000, 2250, "a", None), ("x", 0, 400, "UNK", None)], "video_id string, start_ms long, end_ms long, speaker string, state string")
    got = {r.id: r for r in intervals.speaker_gate(c, t).collect()}
    assert got[1].gate.passed and got[1].gate.tolerated_other_speakers == ["b"] and not got[1].is_tail and got[1].gate.boundary_collar_ms == 50
    assert got[2].is_tail and got[2].gate.reasons == ["multiple_speakers", "tail_other_speaker_ratio_exceeded"]
    assert got[3].gate.reasons == ["dominant_coverage_below_min", "unknown_ratio_exceeded"] and got[3].gate.trailing_unknown_ms == 250
    assert got[4].is_tail and got[4].gate.reasons == ["tail_speaker_evidence_too_short"] and got[4].gate.boundary_collar_ms == 0
    assert got[5].gate.reasons == ["tail_no_explicit_speaker", "tail_dominant_coverage_below_min", "tail_unknown_ratio_exceeded", "tail_trailing_unknown_exceeded", "tail_last_voice_not_dominant"]
    wide = {r.id: r.gate.reasons for r in intervals.speaker_gate(c, t, {"tail_max_other_speaker_ms": 101}).collect()}
    assert wide[2] == []
    with pytest.raises(Exception, match="at most one candidate"):
        intervals.speaker_gate(c.withColumn("is_tail", F.lit(True)), t).collect()


def test_items_families(spark):
    rows = [(1, "v", "g1", 0, 800, "a", False, " hi ", 0.9), (2, "v", "g1", 900, 1600, "a", False, "you", 0.5), (3, "v", "g2", 5000, 5300, "unknown", False, "", None), (4, "v", "g3", 9000, 9600, "b", True, "x", 0.9)]
    df = spark.createDataFrame(rows, "id long, video_id string, group_id string, start_ms long, end_ms long, speaker string, overlapped boolean, text string, confidence double")
    got = {r.group_id: r for r in items.build_items(df).collect()}
    assert (got["g1"].item_id, got["g1"].firstpass_text, got["g1"].speaker_confidence, got["g1"].quality_flags, got["g1"].duration_valid, got["g1"].asr_eligible) == ("v_item_000001", "hi you", 0.5, ["low_speaker_confidence"], True, False)
    assert got["g2"].quality_flags == ["empty_firstpass_text", "unknown_speaker", "too_short"] and got["g2"].asr_ineligible_reasons == ["unknown_speaker", "below_asr_min_duration"]
    assert got["g3"].short_answer and got["g3"].asr_duration_valid and got["g3"].speaker_quality_flags == ["overlap_detected"]
    again = items.refresh_eligibility(items.build_items(df).withColumn("gate_reasons", F.when(F.col("group_id") == "g3", F.array(F.lit("tail_overlap_ratio_exceeded"))).otherwise(F.array().cast("array<string>"))))
    now = {r.group_id: r for r in again.collect()}
    assert now["g3"].speaker_quality_flags == ["overlap_detected", "speaker_gate_failed", "broadcast_crosstalk_detected"] and now["g2"].quality_flags == ["empty_firstpass_text", "unknown_speaker", "too_short"]
    assert {r.group_id for r in items.select_asr_attempts(again, True).collect()} == {"g1", "g3"} and items.select_asr_attempts(again).count() == 0
    heard = items.apply_audio_flags(again.withColumn("f", F.array(F.lit("clipping_detected"))), "f")
    assert {(r.audio_valid, r.audio_quality_flags[0]) for r in heard.collect()} == {(False, "clipping_detected")}


def test_records(spark):
    assert manifest.ALIASES["text"][0] == "spoken_text" and manifest.ALIASES["speaker_id"][0] == "local_speaker_id"
    rows = spark.createDataFrame([("a.wav", None, " told ", "said", "v", "u1", "2.5"), ("", " ", "", "x", "v", None, None), (None, "b.wav", "t", None, None, "", "x")], "audio_path string, wav_path string, spoken_text string, text string, voice string, utt_id string, duration string")
    got = manifest.normalize_record(rows).collect()
    assert [(r.audio_path, r.text, r.id, r.duration, r.reason) for r in got] == [("a.wav", "told", "u1", 2.5, None), (None, "x", None, None, "missing_audio_path"), ("b.wav", "t", None, None, "missing_speaker_id")]
    w = spark.createDataFrame([(0.5, None), (0.7, None), (None, 1.5)], "pseudo_label_weight double, loss_weight double")
    assert [r.weight_error for r in manifest.check_weight_conflict(w, 0.5).collect()] == [None, "source_weight_conflict", "source_weight_conflict"]
    assert [(r.loss_weight, r.weight_error) for r in manifest.check_weight_conflict(w).collect()] == [(0.5, None), (0.7, None), (1.5, "weight_out_of_range")]
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    same = lambda df: manifest.manifest_checksum(df).first().checksum
    assert same(a) == same(a.orderBy(F.col("k").desc()).repartition(3)) != same(a.distinct()) and same(a) != same(a.fillna(""))
    assert pairing.duration_bands("5-10, 10-") == [(5.0, 10.0), (10.0, None)] and pairing.duration_bands(" ") == []
    for wrong in ("10-5", "x"):
        with pytest.raises(ValueError, match="band"):
            pairing.duration_bands(wrong)
    clip = spark.createDataFrame([("i", True, True, "s", None, "t", 2000, "p", "h")], "item_id string, accepted boolean, speaker_pure boolean, speaker_id string, video_id string, final_text string, duration_ms long, audio_path string, audio_sha256 string")
    with pytest.raises(Exception, match="video_id is required"):
        clip.select(pairing.pair_eligibility()).collect()
    with pytest.raises(Exception, match="audio_path and audio_sha256"):
        clip.select(*[c for c in clip.columns if c not in ("video_id", "audio_path")], F.lit("v").alias("video_id"), F.lit("").alias("audio_path")).select(pairing.pair_eligibility()).collect()


def test_recovery_reasons(spark):
    it = spark.createDataFrame([(k, "old", "h") for k in "abcd"], "item_id string, audio_path string, audio_sha256 string")
    before = spark.createDataFrame([(k, 0.5, -20.0, 1000) for k in "abc"], "item_id string, probability double, level_db double, duration_ms long")
    after = spark.createDataFrame([("a", 0.05, -25.0, 1100, [], "new", "n"), ("b", 0.46, -50.0, 1101, ["clipping_detected"], "new", "n"), ("c", 0.05, -38.1, 1000, [], "new", "n")], "item_id string, probability double, level_db double, duration_ms long, reasons array<string>, audio_path string, audio_sha256 string")
    got = {r.item_id: r for r in evaluation.compare_recovery(it, before, after).collect()}
    assert got["a"].recovered and (got["a"].audio_path, got["a"].pre_separation_audio_path) == ("new", "old")
    assert got["b"].reasons == ["clipping_detected", "background_music_residual", "insufficient_music_probability_reduction", "separated_vocals_too_quiet", "separated_vocals_signal_loss", "separated_audio_duration_mismatch"] and got["b"].audio_path == "old"
    assert got["c"].reasons == ["separated_vocals_signal_loss"] and got["d"].reasons == ["recovery_evidence_missing"]


def test_bootstrap_is_the_plain_one(spark):
    rng = np.random.default_rng(1)
    rows = [("s", f"l{i % 7}", f"c{i % 11}", float(rng.integers(1, 6))) for i in range(300)]
    df = spark.createDataFrame(rows, "system string, listener string, condition string, score double").repartition(3)
    hashes = {c: {r[0]: r[1] for r in df.select(c, F.xxhash64(F.lit(c), c)).distinct().collect()} for c in ("listener", "condition")}
    draw = {c: {k: evaluation.multiplicities(h, 400, 7) for k, h in v.items()} for c, v in hashes.items()}
    w = np.array([draw["listener"][a] * draw["condition"][b] for _, a, b, _ in rows])
    some = w.sum(0) > 0
    means = (w * np.array([r[3] for r in rows])[:, None]).sum(0)[some] / w.sum(0)[some]
    got = evaluation.crossed_bootstrap_ci(df, 400).first()
    assert np.allclose((got.low, got.high), np.quantile(means, [0.025, 0.975])) and got.low < got["mean"] < got.high
    many = np.concatenate([evaluation.multiplicities(h, 2000, 3) for h in range(50)])
    assert abs(many.mean() - 1) < 0.02 and abs(many.var() - 1) < 0.05


def test_codec_and_noise(spark):
    from voicewright.operators import audio, codec

    df = spark.createDataFrame([(str(i), [[1, 2, 3], [4, 5, 6]]) for i in range(200)], "id string, target_tokens array<array<int>>")
    out = codec.mask_targets(df, 99, 5).collect()
    for r in out:
        for t, i, x in zip(sum(r.target_tokens, []), sum(r.inputs, []), sum(r.labels, [])):
            assert (i, x) in ((t, -100), (99, t))
    assert 0.4 < np.mean([i == 99 for r in out for i in sum(r.inputs, [])]) < 0.6 and 5 < sum(r.condition_dropped for r in out) < 40
    assert [r.inputs for r in codec.mask_targets(df.repartition(7), 99, 5).orderBy(F.col("id").cast("int")).collect()] == [r.inputs for r in sorted(out, key=lambda r: int(r.id))]
    done = df.select("id", F.when(F.col("id") < "5", "success").otherwise("error").alias("status"), F.lit("why").alias("error_msg"))
    shards, bad = codec.write_token_shards(done, 10)
    assert sorted(r["count"] for r in shards.groupBy("shard").count().collect())[1:] == [10] * (shards.count() // 10) and shards.count() + bad.count() == 200
    with pytest.raises(Exception, match="why"):
        codec.write_token_shards(done, 10, skip_errors=False)[1].collect()
    clips = spark.createDataFrame([("a", 100, [0.1] * 1000), ("b", 100, [])], "item_id string, rate int, samples array<float>")
    noise = spark.createDataFrame([(1, [0.5, -0.5] * 50)], "noise_id long, samples array<float>")
    got = {r.item_id: r for r in audio.mix_noise(clips, noise).collect()}
    k = int(np.flatnonzero(np.abs(np.array(got["a"].samples) - 0.1) > 1e-4).max()) + 1
    assert 100 <= k <= 300 and got["a"].clean_from == int(np.ceil(k / 100 * 25)) and 5 <= got["a"].snr_db <= 15 and got["b"].samples == []
    added = np.array(got["a"].samples[:k]) - 0.1
    assert abs(10 * np.log10(0.01 / (added**2).mean()) - got["a"].snr_db) < 0.1


def wav(samples, width=2, rate=1000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((channels, width, rate, 0, "NONE", ""))
        scale = (1 << (8 * width - 1)) - 1
        v = (np.asarray(samples) * scale).astype(np.int64)
        if width == 1:
            w.writeframes((v + 128).astype(np.uint8).tobytes())
        elif width == 3:
            w.writeframes(b"".join(int(x).to_bytes(3, "little", signed=True) for x in v))
        else:
            w.writeframes(v.astype({2: "<i2", 4: "<i4"}[width]).tobytes())
    return out.getvalue()


def test_media(spark, tmp_path):
    x = np.concatenate([np.zeros(500), np.full(500, 0.5)])
    for width in (1, 2, 3, 4):
        (tmp_path / f"w{width}.WAV").write_bytes(wav(x, width))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "note.txt").write_text("no")
    files = media.discover_media(spark, str(tmp_path))
    inv = media.media_inventory(files).collect()
    assert len(inv) == 5 and all(r.video_id.endswith(r.sha256[:8]) for r in inv)
    audio = media.decode_pcm_wav(files)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in audio.collect()}
    assert rows["bad.wav"].error and all(rows[f"w{w}.WAV"].duration_ms == 1000 and np.allclose(rows[f"w{w}.WAV"].samples, x, atol=0.01) for w in (1, 2, 3, 4))
    frames = media.frame_energy(audio).filter("path like '%w2%'").orderBy("frame").collect()
    assert len(frames) == 100 and frames[0].rms_dbfs == -100 and abs(frames[-1].rms_dbfs + 6.02) < 0.01
    good = audio.filter("error is null").withColumn("video_id", F.col("path"))
    clip = media.cut_clips(good, good.select("video_id", F.lit("c").alias("item_id"), F.lit(400).alias("start_ms"), F.lit(5000).alias("end_ms")))
    assert all(len(r.samples) == 600 for r in clip.collect())


def test_manifests(spark, tmp_path):
    path = str(tmp_path / "m.jsonl")
    open(path, "w").write(json.dumps({"id": "a", "text": "x"}) + "\n\n" + json.dumps({"target_id": "b"}) + "\n[1\n")
    kind = "id string, target_id string, text string"
    with pytest.raises(Exception):
        manifest.read_manifest(spark, path, kind).collect()
    assert [r.row_id for r in manifest.resolve_row_id(manifest.read_manifest(spark, path, kind, strict=False)).orderBy("row_id").collect()] == ["a", "b"]
    assert [r.value for r in manifest.bad_lines(spark, path, kind).collect()] == ["[1"]
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"])], "id string, r array<string>")
    manifest.route_manifests(rows, str(tmp_path / "routes"), F.col("r"))
    assert spark.read.json(str(tmp_path / "routes")).groupBy("route").count().orderBy("route").collect()[1][1] == 2
    manifest.write_manifest(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        manifest.write_manifest(rows, str(tmp_path / "out"))
    lst = tmp_path / "data.lst"
    lst.write_text("# shards\na.tar a.jsonl 10 1.5\nb.tar b.jsonl\n")
    assert [tuple(r) for r in manifest.read_shard_list(spark, str(lst)).collect()] == [("a.tar", "a.jsonl", 10, 1.5), ("b.tar", "b.jsonl", None, None)]
    lst.write_text("alone\n")
    with pytest.raises(Exception, match="needs audio"):
        manifest.read_shard_list(spark, str(lst)).collect()


def test_streams_equal_their_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # A late row of its own user lets the watermark pass all others.
    last = batch.limit(1).withColumns({"ts": F.col("ts") + F.expr("interval 400 days"), "user_id": F.lit(-1).cast(batch.schema["user_id"].dataType)})
    every = batch.unionByName(last)
    for low, high in (("2023-01-01", "2024-01-09"), ("2024-01-09", "2024-01-16"), ("2024-01-16", "2024-01-24"), ("2024-01-24", "2030-01-01")):
        every.filter(f"ts >= '{low}' and ts < '{high}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    for k, job in enumerate((jobs.stream_run_counters, jobs.stream_speech_sessions, lambda d: jobs.stream_music_windows(d, 100.0))):
        stream = jobs.read_stream(spark, str(tmp_path / "events"), every.schema, 1)
        got = {tuple(map(str, r)) for r in jobs.run_available(job(stream), f"job{k}", str(tmp_path / f"cp{k}"), "append").collect()}
        want = {tuple(map(str, r)) for r in job(every).collect()}
        missing = want - got
        # Only what the late row itself opened is still open.
        assert got <= want and len(missing) == (2 if k == 2 else 1), (k, len(missing))


def test_stream_of_groups_is_its_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").cast("long").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("speaker"), (F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000).alias("start_ms"))
    rows = rows.withColumns({"end_ms": F.col("start_ms") + 60_000, "overlapped": F.col("id") % 11 == 0})
    end = rows.limit(1).withColumns({"ts": F.col("ts") + F.expr("interval 400 days"), "start_ms": F.col("start_ms") + 400 * 86_400_000, "end_ms": F.col("end_ms") + 400 * 86_400_000, "video_id": F.lit(-1).cast("long")})
    later = end.withColumns({"ts": F.col("ts") + F.expr("interval 9 days"), "video_id": F.lit(-2).cast("long")})
    for k, part in enumerate((rows.filter("ts < '2024-01-15'"), rows.filter("ts >= '2024-01-15'"), end, later)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    stream = jobs.read_stream(spark, str(tmp_path / "c"), rows.schema, 1)
    limits = {"max_duration_ms": 40 * 3_600_000, "max_gap_ms": 20 * 3_600_000}
    got = jobs.run_available(jobs.stream_group_candidates(stream, "1 minute", **limits), "groups", str(tmp_path / "cp"))
    want = intervals.group_candidates(rows, **limits).groupBy("video_id", "group_id").agg(F.min("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").cast("int").alias("parts")).drop("group_id")
    assert {tuple(r) for r in got.filter("video_id >= 0").select(*want.columns).collect()} == {tuple(r) for r in want.collect()}


def test_stream_of_weights(spark, tmp_path):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    p = [("a", "abcd", day(1)), ("b", "xy", day(1)), ("c", "zz", day(2)), ("end", "q", day(20))]
    r = [("a", "success", "abcx", "m", day(1)), ("a", "success", "zzzz", "m", day(1)), ("c", "failed", "zz", "m", day(2)), ("end", "success", "q", "m", day(20))]
    spark.createDataFrame(p, "id string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "p"))
    kind = "id string, status string, hypothesis string, model_id string, ts string"
    for k, part in enumerate((r[:1], r[1:])):
        spark.createDataFrame(part, kind).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    read = lambda n: jobs.read_stream(spark, str(tmp_path / n), spark.read.parquet(str(tmp_path / n)).schema, 1)
    got = {x.id: (x.reason, x.pseudo_label_weight) for x in jobs.run_available(jobs.stream_weight_manifest(read("p"), read("r")), "weights", str(tmp_path / "cpw")).collect()}
    assert got["a"][0] is None and abs(got["a"][1] - 0.75**3) < 1e-12 and got["b"] == ("secondary_asr_missing", None) and got["c"] == ("secondary_asr_failed", None)


def test_entry_without_text_package(tmp_path):
    """With the text operators, their tests and the pipeline really gone, the rest imports, and has its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'weight_manifest' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op1_')]; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")})
    assert said.returncode == 0 and int(said.stdout) > 100, said.stderr


def test_audio(spark):
    from voicewright.operators import audio

    rng = np.random.default_rng(0)
    level = np.full(400, -70.0) + rng.random(400)
    level[50:120] = -15
    level[135:170] = -15  # within the bridged silence
    level[300:310] = -15  # too short
    frames = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(level)], "path string, frame long, rms_dbfs double")
    got = [(r.start_ms, r.end_ms) for r in audio.energy_vad(frames, "path").collect()]
    assert got == [(400, 1800)]
    loud, flat = [1.0] * 1200, np.where(np.arange(1500) % 2, 0.015, -0.015).tolist()
    talk = (np.where(np.arange(1500) // 300 % 2, 0.5, 0.001) * np.where(np.arange(1500) % 2, 1, -1)).tolist()
    clips = spark.createDataFrame([("loud", 1000, loud), ("flat", 1000, flat), ("talk", 1000, talk), ("none", 1000, [])], "item_id string, rate int, samples array<float>")
    found = {r.item_id: r.reasons for r in audio.audio_quality(clips).collect()}
    assert found == {"loud": ["clipping_detected", "low_snr_detected"], "flat": ["low_snr_detected"], "talk": [], "none": []}
    rows = spark.createDataFrame([(str(i), "ref" if i % 2 else "none", float(s)) for i, s in enumerate([1, 2, 30, 9, 9, 4, 4, 3, 12])], "item_id string, mode string, seconds double")
    batches = {}
    for r in audio.duration_batches(rows, 12.0).collect():
        batches.setdefault(r.batch, []).append(r.seconds)
    # none: 30 | 12 | 9, 4 don't fit together: 9 | 4, 1; ref: 9 | 4, 3, 2
    assert sorted(map(sorted, batches.values())) == [[1.0, 4.0], [2.0, 3.0, 4.0], [9.0], [9.0], [12.0], [30.0]]
    sliced = {}
    for r in audio.duration_batches(rows, 12.0, slices=4).collect():
        sliced.setdefault(r.batch, []).append(r.seconds)
    assert sorted(sum(sliced.values(), [])) == sorted(sum(batches.values(), [])) and all(sum(b) <= 12 or len(b) == 1 for b in sliced.values())


def test_chunks_and_languages(spark):
    t = F.lit
    row = one(spark, text.chunk_text(t('Dr. Low said "no." Then he left. And so on and on it went!'), 30).alias("c"), text.chunk_text(t("a. bb. " + "c" * 30 + ". d."), 10, 5).alias("m"), text.map_language(t(" German "), {"german": "de"}).alias("l"), text.map_language(t("x"), {"german": "de"}, "en").alias("f"), text.chunk_text(t(None).cast("string")).alias("n"), text.chunk_text(t("")).alias("e"))
    assert row.c == ['Dr. Low said "no."', "Then he left.", "And so on and on it went!"] and row.l == "de" and row.f == "en" and row.n is None and row.e == []
    assert row.m == ["a. bb.", "c" * 30 + ". d."]
    names = one(spark, text.locale_of_language(t("ZH_Sichuan")).alias("a"), text.locale_of_language(t("Russian")).alias("b"), text.locale_of_language(t("x")).alias("c"), text.language_of_locale(t("th-TH")).alias("d"))
    assert tuple(names) == ("zh-CN", "ru-RU", None, "Thai")
    n = one(spark, text.split_paragraph(t("one, two. " * 20 + "1.5 end")).alias("p"), text.split_paragraph(t("没有"), "zh").alias("q"), text.split_paragraph(t('What?!" she said.'), "en").alias("r"), text.split_paragraph(t("x" * 20_000 + "."), "en").alias("s"))
    assert "".join(n.p) == "one, two. " * 20 + "1.5 end" and all(60 < len(x) <= 100 for x in n.p[:-1]) and n.q == ["没有"] and n.r == ['What?" she said.'] and len(n.s[0]) == 20_001
    q = one(spark, text.text_quality(t("na na na na na")).alias("a"), text.text_quality(t("")).alias("b"), *(text.detect_locale(t(x)).alias(f"l{i}") for i, x in enumerate(["Der Hund und die Katze", "これは", "ok", "Привет", "straße", "¿qué?", "hello！"])))
    assert q.a == ["repetitive_text", "excessive_english"] and q.b == ["empty_text"]
    assert [q[f"l{i}"] for i in range(7)] == ["de-DE", "ja-JP", "zh-CN", "zh-CN", "de-DE", "es-MX", "zh-CN"]


def test_text_values(spark):
    t = F.lit
    bad = one(spark, text.abnormal_chars(t("ကa \u200b\u200e€+ж\ufffd\t")).alias("x")).x
    assert [(r.character, r.reason) for r in bad] == [("\u200e", "unexpected_format_character"), ("€", "unexpected_symbol"), ("ж", "unexpected_letter_script"), ("\ufffd", "invalid_unicode_category")]
    ends = one(spark, *(text.add_punctuation(t(x)).alias(f"e{i}") for i, x in enumerate(["好 a", "x)", "y、", ' z" ', "", "汉b"])))
    assert list(ends) == ["好 a。", "x)", "y、", 'z"', "", "汉b。"]
    need = one(spark, *(text.needs_normalization(t(x)).alias(f"n{i}") for i, x in enumerate(["plain words", "5", "a=b", "NASA", "x. y", "longer. y", "°", "", "a|b"])))
    assert list(need) == [False, True, True, True, True, False, True, False, False]
    weights = {"a": 1.0, " ": 0.2, "中": 3.0, "か": 2.2, "한": 2.5, "ไ": 1.5, "က": 1.8, "א": 1.5, "ب": 1.5, "አ": 3.0, "ꀀ": 3.0, "7": 3.5, "!": 0.5, "+": 0.5, "\u0301": 0.0, "\u0640": 0.0, "ж": 1.0, "Ꭰ": 1.0, "अ": 1.8, "\U00020001": 3.0, "\n": 1.0}
    got = one(spark, *(text.speaking_weight(t(c)).alias(f"w{i}") for i, c in enumerate(weights)))
    assert np.allclose(list(got), list(weights.values()))
    took = one(spark, text.estimate_duration(t("a" * 600), t("a" * 10), t(1.0)).alias("a"), text.estimate_duration(t("a" * 10), t("a" * 10), t(1.0)).alias("b"), text.estimate_duration(t("a"), t(""), t(1.0)).alias("c"))
    assert abs(took.a - 60) < 1e-9 and abs(took.b - 50 * (1 / 50) ** (1 / 3)) < 1e-9 and took.c == 0.0
    spaced = one(spark, text.clean_tn_spaces(t("今天 天气 AI 好 9 x y")).alias("a"), text.clean_spoken_output(t("a…b · c~d €5%, ，x ,")).alias("b"))
    assert spaced.a == "今天天气AI好9 x y" and spaced.b == "a...b c,d 5,,x"
    stats = one(spark, text.script_stats(t("かaé中한жبअไγ1")).alias("s")).s.asDict()
    assert stats == {"han": 1, "kana": 1, "latin": 2, "hangul": 1, "cyrillic": 1, "arabic": 1, "devanagari": 1, "thai": 1, "greek": 1}
    kinds = one(spark, *(text.extract_llm_json(t(x)).alias(f"j{i}") for i, x in enumerate(['{"a": 1}', '```JSON\n{"a": [1]}\n```', 'So: {"a": {"b": 2}} ok', "[1]", "{broken", "none"])))
    assert list(kinds) == ['{"a": 1}', '{"a": [1]}', '{"a": {"b": 2}}', None, None, None]
    chat = one(spark, text.compose_semantic_edit_request(t(" slow "), t(2)).alias("a"), text.compose_acoustic_edit_request(t("x"), t(1)).alias("b"), text.compose_voice_design_request(t("warm"), t("hi")).alias("c"))
    assert "<|sosp|><|video_pad|><|video_pad|><|eosp|>\nIdentify the content of the audio. slow /no_think" in chat.a and chat.a.endswith("<think>\n\n</think>\n\n<|sot|>")
    assert chat.b.endswith("</think>\n\n<|sosp|>") and chat.c.endswith("<|sot|>") and "hi /no_think<|im_end|>" in chat.c


def test_emoji_and_fourgrams(spark):
    import random

    import regex

    points = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000]
    mine = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in text.EMOJI) + "]")
    assert [c for c in points if bool(mine.match(c)) and not regex.match(r"\p{Emoji_Presentation}", c)] == []
    missed = [c for c in points if regex.match(r"\p{Emoji_Presentation}", c) and not mine.match(c)]
    assert len(missed) < 40  # newer versions of Unicode add a few
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé中😀") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["ab" * 4000, "", "abc"]
    want = [max([sum(c[i : i + 4] == g for i in range(len(c) - 3)) for g in {c[i : i + 4] for i in range(len(c) - 3)}] or [0]) if len(c) < 1000 else 4000 - 1 for c in (regex.sub(r"[^\p{L}\p{M}\p{N}]", "", x) for x in texts)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", text.max_fourgram(F.col("x")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == want
