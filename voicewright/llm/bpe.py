"""Byte-level BPE encoding and decoding over Arrow batches, with the ``tokenizers`` library.

Encoding: the text is cut where no token can span, that is before a single blank or line feed that
stands between two characters that aren't white space. Each distinct piece of a batch is encoded
once by the tokenizer; the ids of the documents are gathered from the pieces'. A document with
other white space is encoded whole. Either way the ids are those of the whole text.

Decoding: every token string is mapped back to bytes by the reversed byte-to-character table. A
character may be split over tokens: bytes are joined before they're read as UTF-8.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept by a worker; the table starts anew when it is full.
PIECES = 600_000
PATTERN = regex.compile(public_tokenizers.PATTERN)


def byte_to_char() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """One tokenizer per Python worker."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.model = Tokenizer(self.tokenizer.model)
        self.alphabet = byte_to_char()
        self.pieces: dict[str, bytes] = {}
        self._bytes: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, path: str) -> Codec:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: set[str]) -> None:
        """Encode the new ones of ``pieces``; those with other white space are left out.

        They're matched in one text, with a line feed before each. Each distinct match goes once through
        the model, with its bytes mapped to characters, as a word of one long input.
        """
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        new = [p for p in pieces if p not in self.pieces and (core := p.removeprefix("\n")) and core.split() == [core]]
        if not new:
            return
        matches = PATTERN.findall("".join([p if p[0] == "\n" else "\n " + p for p in new]))
        distinct = list(set(matches))
        mapped = [m.encode().decode("latin-1").translate(self.alphabet) for m in distinct]
        found = self.model.encode_batch([mapped], is_pretokenized=True, add_special_tokens=False)[0]
        raw = np.array(found.ids, np.uint32).tobytes()
        at = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(distinct) + 1))).tolist()
        of = {m: raw[a:b] for m, a, b in zip(distinct, at, at[1:])}
        each = list(map(of.__getitem__, matches))
        starts = [i for i, m in enumerate(matches) if m == "\n"]
        for p, a, b in zip(new, starts, [*starts[1:], len(matches)], strict=True):
            self.pieces[p] = b"".join(each[a + (p[0] != "\n") : b])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as native unsigned 32-bit integers."""
        # A piece stands for itself after its line feed, or else for itself after a blank. The first gets a line feed.
        cut = [("\n" + t).replace("\n", " \n").split(" ")[1:] for t in texts]
        self.learn(set().union(*cut))
        find, out, left = self.pieces.__getitem__, [], []
        for i, c in enumerate(cut):
            try:
                out.append(b"".join(map(find, c))[4:])
            except KeyError:
                out.append(b"")
                left.append(i)
        for i, ids in zip(left, self.whole([texts[i] for i in left])):
            out[i] = ids
        return out

    def offsets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Code points that each token covers; tokens that share a character all cover it."""
        return [e.offsets for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    @property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens, one after another, and where each starts (with one entry more)."""
        if self._bytes is None:
            back = {c: b for b, c in byte_to_char().items()}
            table = [b""] * self.tokenizer.get_vocab_size()
            special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            for token, i in self.tokenizer.get_vocab().items():
                table[i] = token.encode() if token in special else bytes(back[c] for c in token)
            self._bytes = np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])
        return self._bytes

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence (native unsigned 32-bit integers)."""
        flat, start = self.token_bytes
        all_ids = np.frombuffer(b"".join(ids), np.uint32)
        n = start[all_ids + 1] - start[all_ids]
        at = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=at[1:])
        raw = flat[np.arange(at[-1]) + np.repeat(start[all_ids] - at[:-1], n)].tobytes()
        ends = at[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


def encode(docs: DataFrame, column: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``bpe_ids`` (array of int); with ``offsets`` also ``bpe_starts``, ``bpe_ends`` (code points).

    A null text has no ids, as an empty one. Columns that already have these names are replaced.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    shared.tune(docs.sparkSession)
    new = ["bpe_ids", *(["bpe_starts", "bpe_ends"] if offsets else [])]
    rest = docs.drop(*new)
    schema = shared.schema_with(rest, *((name, "array<int>") for name in new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(column).to_pylist()]
            ids = codec.encode(texts)
            at = np.cumsum([0, *(len(x) // 4 for x in ids)])
            cols = [shared.list_array(np.frombuffer(b"".join(ids), np.int32), at, pa.int32())]
            if offsets:
                spans = codec.offsets(texts)
                cols += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *new])

    return rest.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "bpe_ids", path: str | None = None) -> DataFrame:
    """All columns of ``df`` and ``bpe_bytes`` (binary), ``bpe_text`` (null where the bytes aren't UTF-8, as after a cut within a character).

    Null ids give null bytes; an id outside the vocabulary is an error.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rest = df.drop("bpe_bytes", "bpe_text")
    schema = shared.schema_with(rest, ("bpe_bytes", "binary"), ("bpe_text", "string"))

    def text(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else raw.decode()
        except UnicodeDecodeError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            held = batch.column(ids)
            packed = [b"" if x is None else array("I", x).tobytes() for x in held.to_pylist()]
            raw = [x if ok else None for x, ok in zip(codec.decode(packed), held.is_valid().to_pylist())]
            cols = [pa.array(raw, pa.binary()), pa.array([text(x) for x in raw], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "bpe_bytes", "bpe_text"])

    return rest.mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_column: str = "doc_id", column: str = "text", path: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, n_bytes, exact (decoded bytes equal the text's).

    Encodes and decodes in one pass, so ids never leave the worker. Null texts count as empty; every
    row has a result, repeated ids and null ids included.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    shared.tune(docs.sparkSession)
    rest = docs.select(F.col(id_column), shared.text_or_empty(docs, column).alias("text"))
    schema = shared.schema_with(rest.select(id_column), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("n_bytes", "long"), ("exact", "boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = codec.encode(texts)
            raw = codec.decode(ids)
            cols = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                pa.array([len(x) for x in raw], pa.int64()),
                pa.array([t.encode() == x for t, x in zip(texts, raw)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rest.mapInArrow(run, schema)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_tokens, ids_sha256, decoded_sha256. Null texts are empty, with no ids; repeated rows are encoded alike."""
    return round_trip(shared.read(spark, sf_dir, "documents"))
