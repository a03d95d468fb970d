"""Chat formatting at token level.

A turn is ``[INST]`` role ``[/INST]`` text ``</s>``; the three marks are reserved ids behind the
vocabulary. Role and text are encoded separately, with control strings in them escaped by a backslash
(and read back without it), so no content can make a mark. The loss mask is a prefix sum of steps at
the borders of the trained texts. Segments are encoded before rows meet their conversation; a
conversation is then put together row by row in turn order, so memory doesn't grow with its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, shared

MARKS = ("[INST]", "[/INST]", "</s>")
TRAINED = ("assistant",)
_CONTROL = re.compile(r"(</?|\[/?)(\\*)(s>|INST\])")
_ESCAPED = re.compile(r"(</?|\[/?)\\(\\*)(s>|INST\])")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def reserved(codec: bpe.Codec) -> tuple[int, int, int]:
    n = codec.tokenizer.get_vocab_size()
    return n, n + 1, n + 2


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", path: str | None = None) -> DataFrame:
    """One row for each row of ``turns``: ``conv``, ``turn_no`` (from 0), ``token_start``, ``ids``, ``loss_mask``.

    ``ids`` are native 32-bit integers, ``loss_mask`` one byte for each id (1: text of a trained role).
    Joined in ``turn_no`` order they're the conversation. Rows are ordered by turn, nulls first, ties by
    role and text; a null role or text is empty; rows with a null conversation id form one
    conversation. Other columns of ``turns`` are left out.
    """
    spark = turns.sparkSession
    shared.tune(spark)
    path = path or public_tokenizers.path(bpe.VOCABULARY)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), shared.text_or_empty(turns, role).alias("role"), shared.text_or_empty(turns, text).alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    order = rows.schema["turn"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.Codec.of(path)
        begin, split, end = reserved(codec)
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            role_ids = codec.encode([escape(r) for r in roles])
            text_ids = codec.encode([escape(t) for t in texts])
            mark = {k: np.uint32(k).tobytes() for k in (begin, split, end)}
            ids = [mark[begin] + r + mark[split] + t + mark[end] for r, t in zip(role_ids, text_ids)]
            head = [len(r) // 4 + 2 for r in role_ids]
            length = [len(t) // 4 * (r in TRAINED) for r, t in zip(roles, text_ids)]
            tie = [r + "\x00" + t for r, t in zip(roles, texts)]
            tie = [hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in tie]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(tie, pa.binary()), pa.array(ids, pa.binary()), pa.array(head, pa.int64()), pa.array(length, pa.int64())], names=["conv", "turn", "role", "tie", "ids", "head", "trained"])

    encoded = rows.mapInArrow(encode, f"conv {kind}, turn {order}, role string, tie binary, ids binary, head long, trained long")
    ordered = encoded.repartition("conv").sortWithinPartitions("conv", "turn", "role", "tie")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, no, at = object(), 0, 0
        for batch in batches:
            convs, ids = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            length = np.array([len(x) // 4 for x in ids], np.int64)
            start = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(length, out=start[1:])
            step = np.zeros(start[-1] + 1, np.int8)
            first = start[:-1] + batch.column(5).to_numpy()
            many = batch.column(6).to_numpy()
            np.add.at(step, first, (many > 0).astype(np.int8))
            np.add.at(step, first + many, -(many > 0).astype(np.int8))
            mask = np.cumsum(step[:-1], dtype=np.int8).astype(np.uint8)
            numbers, starts = [], []
            for c, n in zip(convs, length.tolist()):
                if c != last:
                    last, no, at = c, 0, 0
                numbers.append(no)
                starts.append(at)
                no, at = no + 1, at + n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), batch.column(4), shared.blob_array(mask, start)], names=[conv, "turn_no", "token_start", "ids", "loss_mask"])

    return ordered.mapInArrow(assemble, f"`{conv}` {kind}, turn_no long, token_start long, ids binary, loss_mask binary")


def read_back(formatted: DataFrame, conv: str = "conv_id", path: str | None = None) -> DataFrame:
    """Per conversation, from the ids and masks alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens.

    Takes the rows of ``format_turns`` as they come, each conversation's together and in order.
    """
    path = path or public_tokenizers.path(bpe.VOCABULARY)
    kind = formatted.schema[conv].dataType.simpleString()

    class Reader:
        def __init__(self, key):
            self.key, self.turns, self.chars, self.loss, self.tokens = key, 0, 0, 0, 0
            self.all, self.trained = hashlib.sha256(), hashlib.sha256()

        def row(self):
            return self.key, self.turns, self.all.hexdigest(), self.loss, self.trained.hexdigest(), self.chars, self.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.Codec.of(path)
        begin, split, end = reserved(codec)
        names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        now: Reader | None = None
        for batch in batches:
            done = []
            segments, where = [], []
            for key, raw, masked in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                ids, mask = np.frombuffer(raw, np.uint32), np.frombuffer(masked, np.uint8)
                cut = np.flatnonzero(ids == split)
                if ids[0] != begin or ids[-1] != end or len(cut) != 1 or (ids >= begin).sum() != 3:
                    raise ValueError("a turn doesn't consist of its three marks and two segments")
                c = int(cut[0])
                segments += [raw[4 : 4 * c], raw[4 * c + 4 : -4], ids[mask > 0].tobytes()]
                where.append((key, len(ids)))
            texts = [b.decode() for b in codec.decode(segments)]
            for i, (key, n) in enumerate(where):
                if now is None or key != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = Reader(key)
                role, text, loss = texts[3 * i : 3 * i + 3]
                now.turns += 1
                now.tokens += n
                now.chars += sum(map(len, MARKS)) + len(role) + len(text)
                now.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                now.loss += len(loss := unescape(loss))
                now.trained.update(loss.encode())
            if done:
                cols = list(zip(*done))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=names)
        if now is not None:
            cols = [[v] for v in now.row()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=names)

    return formatted.mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, read back from their ids and masks. Null roles and texts are empty, rows of a null conversation id are one conversation."""
    turns = shared.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return read_back(format_turns(turns.unionByName(more))).drop("n_tokens")
