"""Recordings read by ranges: digests, layouts, blocks, resampling and clips equal what plain code makes of the whole file."""

import hashlib
import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicewright.sources import blocks, media


def wav(frames: np.ndarray, rate: int, width: int) -> bytes:
    """``frames``: frames x channels, from -1 to 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(frames.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        top = (1 << (8 * width - 1)) - 1
        v = np.round(frames * top).astype(np.int64)
        if width == 1:
            w.writeframes((v + 128).astype(np.uint8).tobytes())
        else:
            w.writeframes(v.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    return out.getvalue()


def files_in(tmp_path):
    rng = np.random.default_rng(3)
    held = {}
    for name, n, rate, channels, width in (("a.wav", 5_000, 1_000, 1, 2), ("b.wav", 7_777, 16_000, 2, 3), ("c.wav", 0, 8_000, 1, 1), ("d.wav", 1, 8_000, 1, 4), ("e.wav", 4_099, 11_025, 1, 1)):
        held[name] = rng.uniform(-1, 1, (n, channels)), rate, width
        (tmp_path / name).write_bytes(wav(*held[name]))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVEfmt ")
    (tmp_path / "empty.wav").write_bytes(b"")
    return held


def test_layouts_blocks_and_energy(spark, tmp_path):
    held = files_in(tmp_path)
    files = spark.createDataFrame([(f"file:{p}",) for p in tmp_path.iterdir()], "path string")
    told = {r.path.rsplit("/", 1)[-1]: r for r in blocks.layouts(files).collect()}
    assert told["bad.wav"].error and told["empty.wav"].error
    digests = {r.path.rsplit("/", 1)[-1]: r for r in blocks.file_digests(files).collect()}
    for p in tmp_path.iterdir():
        assert digests[p.name].sha256 == hashlib.sha256(p.read_bytes()).hexdigest() and digests[p.name].bytes == p.stat().st_size
    layout = blocks.layouts(files)
    for rate in (None, 8_000, 44_100, 1_000):
        got = {}
        for r in blocks.decode_blocks(layout, rate, block_frames=512).orderBy("block").collect():
            name = r.path.rsplit("/", 1)[-1]
            assert r.start == len(got.setdefault(name, []))
            got[name] += r.samples
        for name, (frames, own, width) in held.items():
            assert told[name].frames == len(frames) and told[name].rate == own and told[name].channels == frames.shape[1]
            _, x = media.samples_of((tmp_path / name).read_bytes())
            to = rate or own
            if len(x):
                at = np.arange((len(x) - 1) * to // own + 1) * own / to
                assert np.allclose(got[name], np.interp(at, np.arange(len(x)), x), atol=1e-6), (name, rate)
            else:
                assert name not in got
    whole = media.frame_energy(media.decode_pcm_wav(media.discover_media(spark, str(tmp_path)))).select(F.regexp_replace("path", "^file:/*", "file:/").alias("path"), "frame", F.round("rms_dbfs", 3).alias("r"), F.round("peak_dbfs", 3).alias("p"))
    parts = blocks.block_energy(blocks.decode_blocks(layout, block_frames=333)).select("path", "frame", F.round("rms_dbfs", 3).alias("r"), F.round("peak_dbfs", 3).alias("p"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(parts) == key(whole)


def test_clips_are_plain_cuts(spark, tmp_path):
    files_in(tmp_path)
    layout = blocks.layouts(media.discover_media(spark, str(tmp_path)))
    rows = []
    for r in layout.filter("error is null").collect():
        name = r.path.rsplit("/", 1)[-1]
        rows += [(r.path, f"{name}:{i}/x", s, e) for i, (s, e) in enumerate([(0, 200), (-50, 130), (100, 10**7), (90, 20), (333, 334), (250, 251)])]
    rows.append(("file:/none.wav", "gone", 0, 10))
    items = spark.createDataFrame(rows, "path string, item_id string, start_ms long, end_ms long")
    out = str(tmp_path / "clips")
    got = {r.item_id: r for r in blocks.export_clips(blocks.clip_pieces(layout, items, block_frames=100), out).collect()}
    assert len(got) == len(rows) - 1
    for path, item, s, e in rows[:-1]:
        with wave.open("/" + path[5:].lstrip("/")) as w:
            rate, n = w.getframerate(), w.getnframes()
            s, e = max(0, s), max(max(0, s), e)
            a, b = min(n, round(s * rate / 1000)), min(n, round(e * rate / 1000))
            w.setpos(a)
            part = w.readframes(b - a)
            plain = io.BytesIO()
            with wave.open(plain, "wb") as c:
                c.setparams(w.getparams())
                c.writeframes(part)
        r = got[item]
        made = open(r.audio_path, "rb").read()
        assert made == plain.getvalue() and r.audio_sha256 == hashlib.sha256(made).hexdigest() and r.bytes == len(made) and (r.clip_start_ms, r.clip_end_ms) == (s, e), item
    assert not [p for p in (tmp_path / "clips").iterdir() if p.name.startswith("_")]


def test_file_of_over_two_gigabytes(spark, tmp_path):
    """A sparse file: its samples are silence but for the last second."""
    rate, frames = 48_000, 1_100_000_000
    path = tmp_path / "long.wav"
    tail = np.full(rate, 0.25)
    with open(path, "wb") as f:
        f.write(blocks.wav_head(rate, 1, 2, 2 * frames))
        f.truncate(44 + 2 * (frames - rate))
        f.seek(0, 2)
        f.write(np.round(tail * 32767).astype("<i2").tobytes())
    layout = blocks.layouts(spark.createDataFrame([(f"file:{path}",)], "path string"))
    assert layout.first().frames == frames and path.stat().st_size > 2 << 30
    end = frames * 1000 // rate
    items = layout.select("path", F.lit("tail").alias("item_id"), F.lit(end - 1500).alias("start_ms"), F.lit(end).alias("end_ms"))
    clip = blocks.export_clips(blocks.clip_pieces(layout, items), str(tmp_path / "out")).first()
    x = media.samples_of(open(clip.audio_path, "rb").read())[1]
    assert abs(len(x) - 1.5 * rate) <= rate // 1000 + 1 and abs(x[-1] - 0.25) < 1e-3 and x[0] == 0
    last = blocks.decode_blocks(layout.withColumn("begin", F.col("begin") + 2 * (frames - 2 * rate)).withColumn("frames", F.lit(2 * rate).cast("long")), 8_000)
    y = np.concatenate([np.array(r.samples) for r in last.orderBy("block").collect()])
    assert len(y) == 16_000 and abs(y[-1] - 0.25) < 1e-3 and y[0] == 0


def test_plain_layout_errors():
    good = blocks.wav_head(8_000, 1, 2, 10) + b"\0" * 10
    assert blocks.layout_of(good, len(good))["frames"] == 5
    assert blocks.layout_of(good, len(good) - 4)["frames"] == 3  # cut off
    for bad in (b"", good[:11], b"RIFX" + good[4:], good[:20] + b"\x03" + good[21:], good[:36] + b"LIST" + good[40:]):
        with pytest.raises(ValueError):
            blocks.layout_of(bad, len(bad))
