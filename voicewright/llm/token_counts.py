"""Token counts from flat token files without an index.

A flat file is a run of token ids in which an end-of-document id closes each document; its name ends in the
width of an id, ``.u16`` or ``.u32``. Files are read by ranges of ``RANGE_BLOCKS`` blocks of ``BLOCK_IDS`` ids, cut without
regard to documents, so one file is read by many tasks. Each block is searched for the end-of-document id as one
array; documents that lie across blocks are put together by a prefix scan over the blocks' counts, in two levels, so
that a file of any length is scanned by many tasks.

Files are written and read through ``pyarrow.fs``, which knows local paths, HDFS, S3 and GCS.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, shared

BLOCK_IDS = 1 << 16
#: Blocks that one task reads of a file at a time.
RANGE_BLOCKS = 32
#: Blocks of a file whose counts are scanned by one task.
SPAN = 4096
END = "<|endoftext|>"
WIDTHS = {2: np.uint16, 4: np.uint32}


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path in it; Spark's ``file:/x`` is a local path."""
    return pyarrow.fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def write_flat(docs: DataFrame, folder: str | None = None, id_column: str = "doc_id", column: str = "text", path: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Encode texts into flat files, one for each partition; returns files, names and the end-of-document id.

    Files: file, bytes. Names: file, ordinal, doc_id, for each document of the file in its order. Null texts count as
    empty. A task that runs again writes a file of another name, and only files that the result names count.
    """
    spark = docs.sparkSession
    shared.tune(spark)
    path, folder = path or public_tokenizers.path(bpe.VOCABULARY), folder or shared.scratch_path(spark, "flat-files")
    rows = docs.select(F.col(id_column).alias("doc_id"), shared.text_or_empty(docs, column).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    end = bpe.Codec.of(path).tokenizer.token_to_id(END)
    width = 2 if bpe.Codec.of(path).tokenizer.get_vocab_size() <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, close = bpe.Codec.of(path), np.uint32(end).tobytes()
        fs, base = _opened(folder)
        fs.create_dir(base, recursive=True)
        name, ordinal, size, out = f"{uuid.uuid4().hex}.u{8 * width}", 0, 0, None
        names = ["file", "number", "names", "kind"]

        def row(number: int, held: pa.Array, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([number], pa.int64()), held, pa.array([kind], pa.int32())], names=names)

        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{base}/_{name}")
            ids = np.frombuffer(b"".join(x + close for x in codec.encode(batch.column(1).to_pylist())), np.uint32).astype(WIDTHS[width])
            out.write(ids.tobytes())
            size += ids.nbytes
            column_ = batch.column(0)
            yield row(ordinal, pa.ListArray.from_arrays(pa.array([0, len(column_)], pa.int32()), column_), 1)
            ordinal += batch.num_rows
        if out is not None:
            out.close()
            fs.move(f"{base}/_{name}", f"{base}/{name}")
            yield row(size, pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), column_.slice(0, 0)), 0)

    parts = rows.mapInArrow(run, f"file string, number long, names array<{id_type.simpleString()}>, kind int")
    stored = shared.saved(parts, "flat-names", partition_by="kind")
    files = stored.filter("kind = 0").select("file", F.col("number").alias("bytes"))
    names = stored.filter("kind = 1").select("file", "number", F.posexplode("names").alias("k", "doc_id")).select("file", (F.col("number") + F.col("k")).alias("ordinal"), "doc_id")
    return files, names, end


def flat_files(spark: SparkSession, *paths: str) -> DataFrame:
    """file, bytes of the flat files in folders; contents aren't read. Other files are left out."""
    found = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    return found.filter(F.col("file").rlike(r"\.u(16|32)$"))


def read_flat(files: DataFrame) -> DataFrame:
    """Blocks of flat files: file, block, ids, width (bytes of an id). Ranges of a file are dealt over tasks."""
    shared.tune(files.sparkSession, 64)
    width = F.when(F.col("file").endswith(".u32"), 4).otherwise(2)
    step = BLOCK_IDS * RANGE_BLOCKS
    ranges = files.filter("bytes > 0").withColumn("width", width).select("file", "bytes", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("bytes") / (F.col("width") * step)) - 1)).alias("range"))
    block_ids, range_blocks = BLOCK_IDS, RANGE_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, wide, k in zip(*(batch.column(i).to_pylist() for i in range(4))):
                fs, path = _opened(file)
                with fs.open_input_file(path) as f:
                    for block in range(k * range_blocks, (k + 1) * range_blocks):
                        at = block * block_ids * wide
                        if at >= size:
                            break
                        part = f.read_at(min(block_ids * wide, size - at), at)
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([part], pa.binary()), pa.array([wide], pa.int32())], names=["file", "block", "ids", "width"])

    return ranges.repartition("file", "range").mapInArrow(run, "file string, block long, ids binary, width int")


def scan(blocks: DataFrame, end: int) -> DataFrame:
    """One row per document of each file: file, ordinal, n_tokens (without the end-of-document id).

    ``blocks``: file, block, ids, width.

    Ids after the last end-of-document id of a file are a document as well; without such ids there's
    none. Empty documents have 0. Null blocks count as empty.
    """
    shared.tune(blocks.sparkSession, 64)
    file_type = blocks.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, wide in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ids = np.frombuffer(raw or b"", WIDTHS[wide])
                at = np.flatnonzero(ids == end)
                out.append((len(ids), len(at), int(at[0]) if len(at) else -1, int(at[-1]) if len(at) else -1, (np.diff(at) - 1).tolist()))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.int64()))], names=["file", "block", "n", "ends", "head", "tail", "inner"])

    found = shared.saved(blocks.select("file", F.col("block").cast("long").alias("block"), "ids", "width").mapInArrow(run, f"file {file_type}, block long, n long, ends long, head long, tail long, inner array<bigint>"), "token-scan")
    found = found.withColumn("span", F.floor(F.col("block") / SPAN))
    # First level: totals of spans of blocks, and where the last document of a span ends, counted from the span's start.
    inside = Window.partitionBy("file", "span").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("count", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    local = local.withColumn("closed", F.when(F.col("ends") > 0, F.col("start") + F.col("tail") + 1))
    local = local.withColumn("since", F.max("closed").over(before))
    spans = local.groupBy("file", "span").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max("closed").alias("closed"))
    earlier = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("span_start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("span_count", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    spans = spans.withColumn("span_since", F.coalesce(F.max(F.col("span_start") + F.col("closed")).over(earlier), F.lit(0)))
    every = local.join(spans.select("file", "span", "span_start", "span_count", "span_since"), ["file", "span"])
    since = F.coalesce(F.col("span_start") + F.col("since"), F.col("span_since"))
    ordinal = F.col("span_count") + F.col("count")
    first = F.struct(ordinal.alias("ordinal"), (F.col("span_start") + F.col("start") + F.col("head") - since).alias("n_tokens"))
    inner = F.transform("inner", lambda n, i: F.struct((ordinal + i + 1).alias("ordinal"), n.alias("n_tokens")))
    closed = every.filter("ends > 0").select("file", F.explode(F.concat(F.array(first), inner)).alias("d")).select("file", "d.*")
    # Ids behind a file's last end-of-document id.
    sums = spans.groupBy("file").agg(F.sum("n").alias("n"), F.sum("ends").alias("ordinal"), F.coalesce(F.max(F.col("span_start") + F.col("closed")), F.lit(0)).alias("since"))
    loose = sums.filter("n > since").select("file", "ordinal", (F.col("n") - F.col("since")).alias("n_tokens"))
    return closed.unionByName(loose)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_tokens, from flat token files. Null and empty texts have none; repeated rows are counted one by one."""
    files, names, end = write_flat(shared.read(spark, sf_dir, "documents"))
    return names.join(scan(read_flat(files), end), ["file", "ordinal"], "left").select("doc_id", "n_tokens")
