"""Large recordings read by ranges: digests, PCM blocks, resampling, and clips cut to WAV files.

No recording and no clip is a value of its own. Files are opened through Arrow's file systems, and a task reads a range of a
few megabytes at a time. A WAV file's layout comes from its first chunks; blocks of frames are then dealt over all
tasks, and a clip is put together in the order of its pieces with a running digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are read at once, and frames of a block.
READ_BYTES, BLOCK_FRAMES = 8_000_000, 1 << 18
#: Bytes from a file's beginning in which its format and the begin of its samples must lie.
HEAD_BYTES = 1 << 16
_PCM, _EXTENSIBLE = 1, 0xFFFE


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path in it; Spark's ``file:/x`` is a local path."""
    return pyarrow.fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def file_digests(files: DataFrame) -> DataFrame:
    """path, sha256, bytes of each file of the column ``path``, each path once. A file is read by one task, a range after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = opened(path)
                h, n = hashlib.sha256(), 0
                with fs.open_input_stream(name) as f:
                    while part := f.read(READ_BYTES):
                        h.update(part)
                        n += len(part)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([h.hexdigest()]), pa.array([n], pa.int64())], names=["path", "sha256", "bytes"])

    return files.select("path").filter("path is not null").distinct().repartition("path").mapInArrow(run, "path string, sha256 string, bytes long")


def layout_of(head: bytes, size: int) -> dict:
    """rate, channels, width, begin (of the samples, in bytes) and frames of a PCM WAV file of ``size`` bytes; raises on others."""
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind = 12, None
    while at + 8 <= len(head):
        name, n = head[at : at + 4], struct.unpack_from("<L", head, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(head):
            code, channels, rate, _, _, bits = struct.unpack_from("<HHLLHH", head, at + 8)
            if code not in (_PCM, _EXTENSIBLE) or bits not in (8, 16, 24, 32) or not channels or not rate:
                raise ValueError("only PCM of 8, 16, 24 or 32 bits is read")
            kind = rate, channels, bits // 8
        elif name == b"data":
            if kind is None:
                raise ValueError("samples before their format")
            rate, channels, width = kind
            return {"rate": rate, "channels": channels, "width": width, "begin": at + 8, "frames": min(n, size - at - 8) // (channels * width)}
        at += 8 + n + n % 2
    raise ValueError("no samples")


def layouts(files: DataFrame) -> DataFrame:
    """path, rate, channels, width, begin, frames, duration_ms, error (null where it's PCM) of each file; only its head is read."""
    names = ["rate", "channels", "width", "begin", "frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    fs, name = opened(path)
                    with fs.open_input_file(name) as f:
                        size = f.size()
                        told = layout_of(f.read_at(min(HEAD_BYTES, size), 0) if size else b"", size)
                    rows.append((path, *(told[n] for n in names), round(1000 * told["frames"] / told["rate"]), None))
                except (OSError, ValueError) as e:
                    rows.append((path, *[None] * 6, str(e) or type(e).__name__))
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", *names, "duration_ms", "error"])

    return files.select("path").filter("path is not null").mapInArrow(run, "path string, rate int, channels int, width int, begin long, frames long, duration_ms long, error string")


def mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples from -1 to 1, the mean of the channels."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1)


def decode_blocks(layout: DataFrame, rate: int | None = None, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """path, block, start (of the block's samples in the decoded recording), rate, samples (mono, array of float) of all files without an error.

    ``rate``: samples are taken at this rate, by straight lines between those of the file; a block reads one frame beyond its own for that, so
    blocks make up what the whole file would. The last sample is at or before the file's last frame. Blocks of a file are dealt over tasks.
    """
    names = ["path", "rate", "channels", "width", "begin", "frames"]
    ranges = layout.filter("error is null and frames > 0").select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("frames") / block_frames) - 1)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, own, channels, width, begin, frames, block in zip(*(c.to_pylist() for c in batch.columns)):
                first, last = block * block_frames, min(frames, (block + 1) * block_frames)
                wide = min(frames, last + 1)
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    x = mono(f.read_at((wide - first) * channels * width, begin + first * channels * width), width, channels)
                to, start = rate or own, first
                if to == own:
                    x = x[: last - first]
                else:
                    # Output j lies at frame j * own / to: those of this block, in whole numbers.
                    start, stop = -(-first * to // own), min(-(-last * to // own), (frames - 1) * to // own + 1)
                    at = np.arange(start, stop) * own
                    low, part = at // to - first, (at % to) / to
                    x = x[low] + part * (x[np.minimum(low + 1, len(x) - 1)] - x[low])
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([to], pa.int32()), pa.array([x.astype(np.float32)], pa.list_(pa.float32()))], names=["path", "block", "start", "rate", "samples"])

    return ranges.repartition("path", "block").mapInArrow(run, "path string, block long, start long, rate int, samples array<float>")


def block_energy(blocks: DataFrame, hop_ms: int = 10, floor_db: float = -100.0) -> DataFrame:
    """path, frame, start_ms, rms_dbfs, peak_dbfs of each hop, from the sums that ``decode_blocks`` rows give to the hops they touch; the last hop may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, rate, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                x = np.asarray(held.values.to_numpy(), float)
                if not len(x):
                    continue
                hop = max(1, rate * hop_ms // 1000)
                frame = np.arange(start // hop, (start + len(x) - 1) // hop + 1)
                at = np.maximum(frame * hop - start, 0)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(frame), pa.array(np.add.reduceat(x * x, at)), pa.array(np.diff(np.append(at, len(x)))), pa.array(np.maximum.reduceat(np.abs(x), at))], names=["path", "frame", "power", "n", "peak"])

    parts = blocks.select("path", "start", "rate", "samples").mapInArrow(run, "path string, frame long, power double, n long, peak double")
    whole = parts.groupBy("path", "frame").agg(F.sum("power").alias("power"), F.sum("n").alias("n"), F.max("peak").alias("peak"))
    db = lambda v: F.greatest(F.lit(floor_db), 20 * F.log10(F.greatest(v, F.lit(1e-12))))
    return whole.select("path", "frame", (F.col("frame") * hop_ms).alias("start_ms"), db(F.sqrt(F.col("power") / F.col("n"))).alias("rms_dbfs"), db(F.col("peak")).alias("peak_dbfs"))


def wav_head(rate: int, channels: int, width: int, size: int) -> bytes:
    return struct.pack("<4sL4s4sLHHLLHH4sL", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, _PCM, channels, rate, rate * channels * width, channels * width, 8 * width, b"data", size)


def clip_pieces(layout: DataFrame, items: DataFrame, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """The bytes of each item's WAV file in pieces: item_id, piece (0: the head), clip_start_ms, clip_end_ms, content.

    ``items``: path, item_id (distinct), start_ms, end_ms, clamped to the recording, of whose format the clip is. Items of files that aren't
    read (``error``) have no piece. Each piece is a range of its own, so a clip of hours is many rows.
    """
    start, end = F.greatest(F.col("start_ms"), F.lit(0)), F.greatest(F.col("end_ms"), F.col("start_ms"), F.lit(0))
    frame = lambda ms: F.least(F.col("frames"), F.bround(ms.cast("long") * F.col("rate") / 1000).cast("long"))
    both = items.select("path", "item_id", "start_ms", "end_ms").join(layout.filter("error is null"), "path")
    both = both.select("path", "item_id", start.cast("long").alias("clip_start_ms"), end.cast("long").alias("clip_end_ms"), "rate", "channels", "width", "begin", frame(start).alias("a"), frame(end).alias("b"))
    count = F.ceil((F.col("b") - F.col("a")) / block_frames).cast("long")
    ranges = both.select("*", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("piece"))

    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (path, item, s, e, rate, channels, width, begin, a, b, piece) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                wide = channels * width
                if piece:
                    first, last = a + (piece - 1) * block_frames, min(b, a + piece * block_frames)
                    fs, name = opened(path)
                    with fs.open_input_file(name) as f:
                        part = f.read_at((last - first) * wide, begin + first * wide)
                else:
                    part = wav_head(rate, channels, width, (b - a) * wide)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(k, 1), pa.array([piece], pa.int64()), pa.array([s], pa.int64()), pa.array([e], pa.int64()), pa.array([part], pa.binary())], names=["item_id", "piece", "clip_start_ms", "clip_end_ms", "content"])

    return ranges.repartition("item_id", "piece").mapInArrow(run, f"item_id {kind}, piece long, clip_start_ms long, clip_end_ms long, content binary")


def export_clips(pieces: DataFrame, folder: str) -> DataFrame:
    """Write each item of ``clip_pieces`` as a WAV file in ``folder``: item_id, audio_path, audio_sha256, bytes, clip_start_ms, clip_end_ms.

    Files are called by their item's id (safe characters), so ids must differ in them. A file appears under its name when it's complete; a task that runs again replaces it by the same bytes.
    Writing happens when the rows are read.
    """
    from ..functions import text as texts

    kind = pieces.schema["item_id"].dataType.simpleString()
    named = pieces.withColumn("_name", F.concat(texts.safe_id(F.col("item_id").cast("string")), F.lit(".wav")))
    ordered = named.select("item_id", "_name", "piece", "clip_start_ms", "clip_end_ms", "content").repartition("item_id").sortWithinPartitions("item_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        names = ["item_id", "audio_path", "audio_sha256", "bytes", "clip_start_ms", "clip_end_ms"]
        now = stream = row = None

        def close(item: pa.Array) -> pa.RecordBatch:
            stream.close()
            fs.move(f"{base}/{row['temp']}", f"{base}/{row['name']}")
            return pa.RecordBatch.from_arrays([item, pa.array([f"{folder.rstrip('/')}/{row['name']}"]), pa.array([row["h"].hexdigest()]), pa.array([row["n"]], pa.int64()), pa.array([row["s"]], pa.int64()), pa.array([row["e"]], pa.int64())], names=names)

        try:
            for batch in batches:
                for k, (item, name, _, s, e, part) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                    if stream is None or item != now:
                        if stream is not None:
                            yield close(row["item"])
                        now, row = item, {"name": name, "temp": f"_{uuid.uuid4().hex}", "h": hashlib.sha256(), "n": 0, "s": s, "e": e, "item": batch.column(0).slice(k, 1)}
                        stream = fs.open_output_stream(f"{base}/{row['temp']}")
                    stream.write(part)
                    row["h"].update(part)
                    row["n"] += len(part)
            if stream is not None:
                yield close(row["item"])
                stream = None
        finally:
            if stream is not None:  # a task that's stopped leaves no half file
                stream.close()
                if row and fs.get_file_info(f"{base}/{row['temp']}").type != pyarrow.fs.FileType.NotFound:
                    fs.delete_file(f"{base}/{row['temp']}")

    return ordered.mapInArrow(run, f"item_id {kind}, audio_path string, audio_sha256 string, bytes long, clip_start_ms long, clip_end_ms long")
