"""What jobs leave on disk, and what they move, is bounded by what they need."""

import hashlib

import pytest
from pyspark.sql import functions as F

from voicewright import scratch
from voicewright.functions import scoring
from voicewright.operators import pairing, sampling, weighting


def test_draws_store_sizes_alone(spark, monkeypatch):
    stored = scratch.stored
    sizes = []
    monkeypatch.setattr(scratch, "stored", lambda df, name="rows": (out := stored(df, name), sizes.append(out.count()))[0])
    df = spark.range(10_000).select(F.concat(F.lit("i"), "id").alias("item_id"), F.lit("a").alias("source"))
    got = sorted((r.draw, r.item_id) for r in sampling.sample_by_mass(df, {"a": 1.0}, 300, 7).collect())
    order = sorted((f"i{i}" for i in range(10_000)), key=lambda x: hashlib.sha256(f"a:{x}".encode()).hexdigest())
    pick = lambda k: int(hashlib.sha256(f"row:7:0:{k}".encode()).hexdigest()[:16], 16) % 10_000
    assert got == [(k, order[pick(k)]) for k in range(300)]
    times = {r.item_id: r.times for r in sampling.weighted_sample(df, {"a": 20_000}, 7).collect()}
    assert sum(times.values()) == 20_000 and len(times) > 8_000
    assert max(sizes) <= 16**3


def test_manifest_shuffles_each_side_once(spark):
    ids = spark.range(50).select(F.concat(F.lit("i"), "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("audio_sha256"))
    p = ids.withColumn("text", F.concat(F.lit("some words "), "id"))
    s = ids.select("id", "audio_sha256", F.lit("success").alias("status"), F.lit("some words i1").alias("hypothesis"), F.lit("m").alias("model_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = weighting.weight_manifest(p, s)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        got = {r.id: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got["i1"].disagreement == 0 and got["i1"].audio_sha256 == p.filter("id = 'i1'").first().audio_sha256 and got["i2"].disagreement > 0
    for bad in (s.unionByName(s.filter("id = 'i1'")), s.unionByName(s.limit(1).withColumn("id", F.lit(None).cast("string"))), s.unionByName(s.limit(1).withColumn("id", F.lit("apart"))).unionByName(s.limit(1).withColumn("id", F.lit("apart")))):
        with pytest.raises(Exception, match="secondary: duplicate or empty"):
            weighting.weight_manifest(p, bad).select("reason").collect()


def test_packed_digests_come_back(spark):
    texts = ["", "a" * 64, "A" * 64, "0" * 64, "0" * 63, "é" * 32, "\0" * 32, None, "ab" * 31 + "g0", "x" * 31]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("p", scoring.packed(F.col("t"))).withColumn("u", scoring.unpacked(F.col("p"))).collect()
    assert all(r.t == r.u for r in rows) and len({bytes(r.p) for r in rows if r.p is not None}) == len(texts) - 1


def test_tables_on_the_way_and_shuffles_are_deleted(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "new_path", lambda s, name, n=iter(range(99)): scratch._written.setdefault(s.sparkContext.applicationId, []).append(p := f"{tmp_path}/{name}-{next(n)}") or p)
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    clips = spark.range(400).select(F.concat(F.lit("i"), "id").alias("item_id"), F.lit("v").alias("video_id"), F.lit("s").alias("speaker_id"), F.concat(F.lit("p"), "id").alias("audio_path"), F.sha2((F.col("id") % 300).cast("string"), 256).alias("audio_sha256"), F.lit("text").alias("final_text"), F.lit(2000).alias("duration_ms"), F.lit(True).alias("accepted"), F.lit(True).alias("speaker_pure"))
    before = files()
    out = pairing.pair_references(clips)
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["chosen", "clips"]
    assert files() <= before
    rows = {r.item_id: r for r in out.collect()}
    assert len(rows) == 400 and all(r.prompt_id and r.prompt_audio_sha256 == rows[r.prompt_id].audio_sha256 != r.audio_sha256 and r.prompt_text == "text" for r in rows.values())


def test_quality_cache_is_shuffled_by_id_alone(spark):
    sha = lambda c: F.sha2(c.cast("string"), 256)
    ids = spark.range(40).select(F.concat(F.lit("i"), "id").alias("item_id"), sha(F.col("id")).alias("audio_sha256"), "id")
    asr = ids.filter("id < 30").select("item_id", F.array(F.struct(F.lit("ok").alias("status"), F.concat(F.lit("t"), "id").alias("transcript"))).alias("runs"))
    other = F.when(F.col("id") == 3, "x").otherwise(F.col("audio_sha256"))
    cached = ids.select("item_id", other.alias("audio_sha256"), sha(F.concat(F.lit("t"), F.when(F.col("id") == 4, 9).otherwise(F.col("id")))).alias("primary_transcript_sha256"), F.lit("ok").alias("status"), F.struct(F.lit(True).alias("fine")).alias("quality_assessment"), F.lit("q").alias("prompt_id"), F.lit("s").alias("prompt_sha256"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old, new = pairing.reuse_quality_results(ids.drop("id"), asr, cached, "q", "s")
        for df in (old, new):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 3, plan
        assert {r.item_id for r in new.collect()} == {"i3", "i4"} and new.columns == ["item_id", "audio_sha256", "primary_transcript_sha256"]
        got = {r.item_id: r for r in old.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(got) == {f"i{i}" for i in range(30)} - {"i3", "i4"} and all(len(r.audio_sha256) == 64 for r in got.values())
