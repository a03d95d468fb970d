"""Helpers that several operators share: session settings, scratch tables, words and their hashes.

Words and hashes are computed over whole Arrow batches with numpy. A batch is cut into runs of
documents of a few megabytes, so that memory depends on the batch size and the longest document
alone.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

CHUNK_BYTES = 2_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def tune(spark: SparkSession, rows: int = 512) -> None:
    """Small Arrow batches, as documents can be long and a batch is held whole by a Python worker.

    Workers on this machine also find the package where the driver has found it.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_own_base: dict[str, str] = {}
_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table in the shared checkpoint folder of the cluster.

    Where ``spark.checkpoint.dir`` isn't set, a local session gets a temporary folder of its own; a cluster has none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_base.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_base[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def give_back() -> None:
    """Return the driver's memory that a fit has used and freed to the system, where the C library can (it else keeps it for the process)."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def scratch_mark() -> int:
    return len(_written)


def drop_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the intermediate tables written since a mark, but for the last ``keep``. Only for results that are written elsewhere."""
    fs, done = spark.sparkContext._jvm.org.apache.hadoop.fs, len(_written) - keep
    for path in _written[since:done]:
        p = fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _written[since:done]


def saved(df: DataFrame, name: str, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def schema_with(df: DataFrame, *more: tuple[str, str]) -> StructType:
    schema = StructType(list(df.schema.fields))  # the schema of a frame is shared, and add() changes it
    for name, kind in more:
        schema = schema.add(StructType.fromDDL(f"`{name}` {kind}")[0])
    return schema


#: Bytes up to which a table is sent to all executors.
SENT_BYTES = 24_000_000


def _width(column: Column, kind: DataType) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | StructType | ArrayType):
            each = F.aggregate(column, F.lit(8).cast("long"), lambda acc, x: acc + _width(x, kind.elementType))
            return F.coalesce(each, F.lit(8))
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 8
    return F.lit(8)


def table_bytes(df: DataFrame) -> int:
    each = sum((_width(df[f.name], f.dataType) for f in df.schema.fields), F.lit(16))
    return int(df.agg(F.sum(each.cast("long"))).first()[0] or 0)


def sent(df: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its values have no more than ``most`` bytes; else joins with it shuffle."""
    return F.broadcast(df) if table_bytes(df) <= most else df


#: Bits of a table of digests, and its 64-bit words: what ``maybe_among`` sends is bounded, whatever the tables' size.
TABLE_BITS = 24


def maybe_among(rows: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: false only where the binary ``column`` isn't among the ids (one column); so only true rows need a join.

    The ids' leading bits are kept as a table of at most 2 ** (``TABLE_BITS`` - 6) rows, put together by partial aggregates.
    """
    bit = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - TABLE_BITS)
    of_word = F.expr("shiftleft(1L, cast(b % 64 as int))")
    words = ids.select(bit(ids.columns[0]).alias("b")).groupBy(F.shiftright("b", 6).alias("_word")).agg(F.bit_or(of_word).alias("_bits"))
    marked = rows.withColumn("_b", bit(column)).join(F.broadcast(saved(words, "digest-bits")), F.shiftright("_b", 6) == F.col("_word"), "left")
    return marked.withColumn(name, F.coalesce(F.expr("shiftright(_bits, cast(_b % 64 as int)) & 1") == 1, F.lit(False))).drop("_b", "_word", "_bits")


def sampled(df: DataFrame, column: str, rows: int) -> list[str]:
    """The ``rows`` distinct values of ``column`` with the least hashes, for a fit; all, if there are no more.

    Copies of a value make no difference. An estimate of the distinct values only decides how many are compared.
    """
    h = F.xxhash64(column)
    share = 2 * rows / max(1, df.agg(F.approx_count_distinct(column)).first()[0])
    while True:
        part = df if share >= 0.5 else df.filter(h < int(share * (1 << 64)) - (1 << 63))
        chosen = part.select(column).dropDuplicates([column]).orderBy(h, column).limit(rows).collect()
        if share >= 0.5 or len(chosen) == rows:
            return [r[0] for r in chosen]
        share *= 4


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


# --- words and hashes ---------------------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of non-blank bytes; the other table also breaks at ASCII punctuation and controls.
SPACED = ~_BLANK
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n, kept for the process."""
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(int(_MULT), -1, 1 << 64)
        for k, base in enumerate((int(_MULT), inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _pow[k] = np.cumprod(steps, dtype=np.uint64)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash; bijective."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of bytes; ``span_hash`` reads the hash of any span from it."""
    powers, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column without copying; nulls read as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes; a longer document is a run of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end of each word, and the first word of each document (with one entry more at the end)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[bounds] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[bounds - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word in lower case (A-Z only), with ``words``' three arrays."""
    start, end, first = words(data, offsets, table)
    return span_hash(prefix_hash(LOWER[data]), start, end), start, end, first


_COEF = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingle hashes of each document, ascending; offsets of the documents' sets.

    A document with fewer words has its whole word sequence as its only shingle; without words, none.
    """
    w, _, _, first = word_hashes(data, offsets)
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(at[-1]) - at[doc] + first[doc]
    wide = np.concatenate([w, np.zeros(size, np.uint64)])
    h = np.zeros(at[-1], np.uint64)
    last = first[1:][doc]
    short = count[doc] < size
    for j in range(size):
        term = wide[pos + j] * _COEF[j]
        if short.any():
            term[short & (pos + j >= last)] = _COEF[size + 1]
        h += term
    h = mix(h)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    if len(h):
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    kept = np.zeros(len(h) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return h[keep], kept[at]


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each run values[at[i]:at[i+1]], modulo 2**64 for unsigned values."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def set_ids(tokens: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128-bit identity of each set, whatever its order; None for an empty set."""
    high = mix(sums(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), at) + np.diff(at).astype(np.uint64))
    low = mix(sums(mix(tokens ^ np.uint64(0x14057B7EF767814F)), at))
    raw = np.stack([high, low], 1).astype(">u8").tobytes()
    return [raw[i * 16 : i * 16 + 16] if n else None for i, n in enumerate(np.diff(at).tolist())]


def list_array(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def blob_array(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary column of the runs of ``values`` (their bytes as they are in memory)."""
    width = values.dtype.itemsize
    offs = pa.py_buffer((at * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offs, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)
