"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases (each is the shortest string not seen before
as a phrase; the last may be a repeat). The hashes of the phrase set give a signature of ``SLOTS``
minimum hashes, of which a byte each is kept. The likeness of two fingerprints estimates the Jaccard
similarity of their phrase sets from the share of equal slots, corrected for chance agreement of a
byte. Texts without phrases (empty) have a fingerprint of their own, equal only to itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SLOTS = 128
_SHIFT = np.uint64(57)
_SLOT = np.arange(SLOTS + 1, dtype=np.uint64)[:SLOTS] << _SHIFT


def parse(data: bytes, known: dict[int, int], state: int, ends: list[int], at: int) -> int:
    """Parse ``data``, which starts at byte ``at``, on from ``state``; returns the state after it.

    A state is a phrase's number times 256 (0: between phrases); ``known`` maps state plus byte to the
    longer phrase's state. ``ends`` gets the end of each new phrase.
    """
    find, note, fresh = known.get, ends.append, 256 * len(known) + 256
    for at, byte in enumerate(data, at + 1):
        key = state + byte
        state = find(key, 0)
        if not state:
            known[key] = fresh
            fresh += 256
            note(at)
    return state


def _of_phrases(data: bytes, ends: list[int]) -> np.ndarray:
    """One-permutation minimum hashes: the first seven bits of a hash choose the slot, the rest compete; an empty slot borrows from the next."""
    if ends[-1:] != [len(data)]:
        ends = [*ends, len(data)]
    to = np.array(ends)
    h = shared.span_hash(shared.prefix_hash(np.frombuffer(data, np.uint8)), np.concatenate([[0], to[:-1]]), to)
    h.sort()
    at = np.searchsorted(h, _SLOT)
    own = at < len(h)
    least = h[np.minimum(at, len(h) - 1)]
    own &= (least >> _SHIFT) == (_SLOT >> _SHIFT)
    full = np.flatnonzero(own)
    lender = full[np.searchsorted(full, np.arange(SLOTS)) % len(full)]
    lent = least[lender] + ((np.arange(SLOTS) - lender) % SLOTS).astype(np.uint64)
    return (shared.mix(lent) & np.uint64(255)).astype(np.uint8)


def signature(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(SLOTS, np.uint8)
    ends: list[int] = []
    parse(data, {}, 0, ends, 0)
    return _of_phrases(data, ends)


def two_signatures(data: bytes, edited: bytes, shared_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of two texts that begin with the same ``shared_bytes`` bytes, which are parsed once."""
    if not data or not edited:
        return signature(data), signature(edited)
    known: dict[int, int] = {}
    ends: list[int] = []
    state = parse(data[:shared_bytes], known, 0, ends, 0)
    more = list(ends)
    parse(edited[shared_bytes:], dict(known), state, more, shared_bytes)
    parse(data[shared_bytes:], known, state, ends, shared_bytes)
    return _of_phrases(data, ends), _of_phrases(edited, more)


def likeness(a: np.ndarray, b: np.ndarray, empty_a: bool = False, empty_b: bool = False) -> float:
    """0 to 1; 1 for equal fingerprints; 0 where one text is empty and the other isn't."""
    if empty_a or empty_b:
        return float(empty_a and empty_b)
    same = float((a == b).mean())
    return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def fingerprint(docs: DataFrame, column: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lz_fingerprint`` (hex). Null texts count as empty; repeated rows have equal ones."""
    shared.tune(docs.sparkSession)
    rest = docs.drop("lz_fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [signature((t or "").encode()).tobytes().hex() for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "lz_fingerprint"])

    return rest.mapInArrow(run, shared.schema_with(rest, ("lz_fingerprint", "string")))


def with_next(docs: DataFrame, id_column: str = "doc_id", column: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """Rows ``block``, ``guest``, ``doc_id``, ``text``, dealt by block and sorted, so that each row's successor by id follows it.

    Blocks are ranges of the id, of about ``block_bytes`` of text. The rows of the least id of each
    block also go, as guests, to the end of the block before it; those of the first block to the end of
    the last. Only the blocks' borders reach the driver. Rows of one id are ordered by text, null ids
    come first.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), shared.text_or_empty(docs, column).alias("text"))
    low, size = rows.agg(F.min("doc_id"), F.sum(F.octet_length("text"))).first()
    low = low if low is not None else 0
    blocks = int(-(-(size or 0) // block_bytes))
    cuts = np.unique(np.array(rows.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.2 / blocks) if blocks > 1 else [], np.int64))
    key = F.coalesce("doc_id", F.lit(low))

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right"))

    first = dict(sorted(tuple(r) for r in rows.select(key.alias("k")).withColumn("block", block("k")).groupBy("block").agg(F.min("k")).collect()))
    order = list(first)
    host = {first[b]: order[i - 1] for i, b in enumerate(order)}

    @F.pandas_udf("int")
    def visits(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: host.get(i, -1)).astype("int32")

    seat = lambda b, g: F.struct(b.alias("block"), F.lit(g).alias("guest"))
    placed = rows.withColumn("own", block(key)).withColumn("host", visits(key))
    seats = F.when(F.col("host") >= 0, F.array(seat(F.col("own"), False), seat(F.col("host"), True))).otherwise(F.array(seat(F.col("own"), False)))
    dealt = placed.select(F.explode(seats).alias("seat"), "doc_id", "text").select("seat.block", "seat.guest", "doc_id", "text")
    return dealt.repartition("block").sortWithinPartitions("block", "guest", F.col("doc_id").asc_nulls_first(), "text")


def compare_edited(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half (in code points, rounded down) is the start of the next document."""
    spark = docs.sparkSession
    shared.tune(spark)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def one(doc_id, text: str, after: str) -> tuple:
        half = len(text) // 2
        kept = text[: len(text) - half]
        data, edited = text.encode(), (kept + after[:half]).encode()
        own, other = two_signatures(data, edited, len(kept.encode()))
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other, not data, not edited), not data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # a row whose successor hasn't come yet
        before: tuple | None = None  # a finished row that lacks its successor's fingerprint
        for batch in batches:
            out = []
            for block, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if waiting and waiting[0] == block:
                    row = one(waiting[1], waiting[2], text)
                    if before:
                        out.append((*before[:6], likeness(before[3], row[3], before[6], row[6])))
                    before = row
                    if guest:  # the block ends here
                        out.append((*before[:6], likeness(before[3], signature(text.encode()), before[6], not text)))
                        before = None
                waiting = None if guest else (block, doc_id, text)
            if out:
                cols = [list(c) for c in zip(*out)]
                cols[3], cols[4] = ([x.tobytes().hex() for x in c] for c in cols[3:5])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_column, column).mapInArrow(run, schema)


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints, their edited texts' and their likeness to these and to the next document. Null texts are empty; ids are whole numbers."""
    return compare_edited(shared.read(spark, sf_dir, "documents"))
