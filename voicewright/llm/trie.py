"""The trie of conversations' prefixes, by range partitions and the skeleton of their splitters.

A conversation is its path: ``UNIT`` bytes for each turn, a digest of role and text and the text's length. Paths are dealt by
ranges of (path, conversation). A node whose members are in two ranges is a prefix of the splitter between them, so the trie
of the splitters' paths, which is sent to all tasks and bounded by ``SKELETON_BYTES``, holds all such nodes: the
skeleton. A task reads its range in order, with one open node for each turn of the path at hand, and finishes all other nodes.
Of the skeleton's nodes it gives partial aggregates, which are added up; texts take no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

UNIT = 24
#: Bytes of paths that a range should have, ranges at most, and bytes of the splitters' paths at most.
SHARD_BYTES, MOST_SHARDS, SKELETON_BYTES = 256_000, 4096, 8_000_000
#: Finished nodes that an open node holds until its smallest member is known; beyond, they find it by a join.
HELD = 1000
_CLOSED, _OPEN, _PART, _OWNER, _END = range(5)
_OUT = "kind int, conv_id long, depth long, parent_conv_id long, key binary, parent_key binary, above array<binary>, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string"
_EMPTY = hashlib.sha256().hexdigest()


def ordered_units(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, path: all turns of each conversation by turn (nulls first), ties by role and text. A null role or text is empty.

    Rows without a conversation id belong to none and are left out. A path is one value, ``UNIT`` bytes a turn.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), shared.text_or_empty(turns, role).alias("role"), shared.text_or_empty(turns, text).alias("text")).filter("conv is not null")
    unit = F.concat(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")), F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0"))
    by = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.select("conv", F.row_number().over(by).alias("no"), unit.alias("unit"))
    units = F.transform(F.array_sort(F.collect_list(F.struct("no", "unit"))), lambda x: x["unit"])
    return numbered.groupBy("conv").agg(F.unhex(F.array_join(units, "")).alias("path"))


def forked(own: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % ``every``, then has its own after its first h; h = crc32(c) % ``heads``."""
    own = shared.saved(own, "paths")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    base = own.filter(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.substring("path", 1, UNIT * heads).alias("head"))
    both = own.withColumn("h", h).join(base, F.col("conv") - F.col("conv") % every == F.col("base"), "left")
    head = F.expr(f"substring(coalesce(head, X''), 1, {UNIT} * h)")
    return both.select("conv", F.concat(head, F.expr(f"substring(path, {UNIT} * h + 1)")).alias("path"))


Splitter = tuple[bytes, tuple]  # path and conversation, in the order of both; without a conversation: before all that have the path


def splitters(paths: DataFrame, shards: int | None = None) -> list[Splitter]:
    """Bounds of about equal ranges, from the paths of least hash. Their bytes are bounded: long ones are cut to a prefix, which still bounds a range."""
    if shards is None:
        size = paths.agg(F.sum(F.octet_length("path") + 16)).first()[0] or 0
        shards = min(MOST_SHARDS, 2 + size // SHARD_BYTES)
    if shards < 2:
        return []
    cut = max(1, SKELETON_BYTES // (UNIT * shards)) * UNIT
    near = paths.select(F.substring("path", 1, cut).alias("path"), "conv", (F.octet_length("path") > cut).alias("cut"))
    found = near.orderBy(F.xxhash64("conv", "path"), "conv").limit(8 * shards).collect()
    keys = sorted((bytes(r.path), () if r.cut else (r.conv,)) for r in found)
    return sorted({keys[i * len(keys) // shards] for i in range(1, shards)} if keys else set())


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with together."""
    most = min(len(a), len(b)) // UNIT
    if a[: most * UNIT] == b[: most * UNIT]:
        return most
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * UNIT] == b[: mid * UNIT]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("skeleton", "key", "n", "least", "children", "leaves", "saved", "bytes", "ends", "held", "spilt")

    def __init__(self, size: int, key: bytes | None, skeleton: bool):
        self.skeleton, self.key, self.bytes = skeleton, key, size
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.held, self.spilt = None, [], False


class Shard:
    """Reads the sorted paths of one range and gives rows of ``_OUT``."""

    def __init__(self, left: bytes | None, right: bytes | None):
        self.bounds = [p for p in (left, right) if p is not None]
        self.path, self.stack, self.rows = b"", [], []

    def add(self, conv: int, path: bytes) -> None:
        depth = len(path) // UNIT
        if not self.stack:
            self.stack.append(Node(0, hashlib.md5(b"", usedforsecurity=False).digest(), True))
        same = common(self.path, path)
        self.close(same)
        if len(self.stack) <= depth:
            bones = max((common(path, p) for p in self.bounds), default=0)
            for d in range(len(self.stack), depth + 1):
                skeleton = d <= bones
                self.stack.append(Node(int.from_bytes(path[d * UNIT - 8 : d * UNIT], "big"), hashlib.md5(path[: d * UNIT], usedforsecurity=False).digest() if skeleton else None, skeleton))
        self.path = path
        top = self.stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(conv, top.least)
        if top.skeleton:
            self.rows.append((_END, conv, None, None, top.key, None, None, None, None, None, None, None, None))
        elif top.ends is None:
            top.ends = hashlib.sha256(str(conv).encode())
        else:
            top.ends.update(f",{conv}".encode())

    def key(self, depth: int) -> bytes:
        return hashlib.md5(self.path[: depth * UNIT], usedforsecurity=False).digest()

    def spill(self, node: Node, depth: int) -> None:
        """Children of ``node`` go out with its key in place of its smallest member."""
        node.key = node.key or self.key(depth)
        self.rows += [(_OPEN, r[1], r[2], None, None, node.key, *r[6:]) for r in node.held]
        node.held, node.spilt = [], True

    def close(self, to: int) -> None:
        """Finish the open nodes deeper than ``to``."""
        while len(self.stack) > to + 1:
            depth = len(self.stack) - 1
            node, above = self.stack.pop(), self.stack[-1]
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
            if node.skeleton:
                self.part(node, depth)
                continue
            self.rows += [(_CLOSED, r[1], r[2], node.least, *r[4:]) for r in node.held]
            if node.spilt:
                self.rows.append((_OWNER, node.least, None, None, node.key, None, None, None, None, None, None, None, None))
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.bytes
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
            above.held.append((_CLOSED, node.least, depth, None, None, None, None, node.n, node.children, leaves, saved, None, node.ends.hexdigest() if node.ends else _EMPTY))
            if above.skeleton or len(above.held) > HELD:
                self.spill(above, depth - 1)

    def part(self, node: Node, depth: int) -> None:
        above = [n.key for n in self.stack]
        self.rows.append((_PART, node.least, depth, None, node.key, above[-1] if above else None, above, node.n, node.children, node.leaves, node.saved, node.bytes, None))

    def end(self) -> None:
        if self.stack:
            self.close(0)
            self.part(self.stack.pop(), 0)
        self.path = b""


def shard_rows(paths: DataFrame, bounds: list[Splitter]) -> DataFrame:
    """Rows of ``_OUT`` from all ranges: finished nodes, and parts, ends and owners of those that need others."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(bounds, (path, (conv,))) for conv, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["conv", "path", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), *[pa.int64()] * 5, pa.string()]
        names = [f.strip().split()[0] for f in _OUT.split(",")]
        now, shard = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for conv, path, s in zip(*(c.to_pylist() for c in batch.columns)):
                if s != now:
                    if shard:
                        shard.end()
                        yield out(shard.rows)
                    now, shard = s, Shard(bounds[s - 1][0] if s else None, bounds[s][0] if s < len(bounds) else None)
                shard.add(conv, path)
                if len(shard.rows) > 10_000:
                    yield out(shard.rows)
                    shard.rows = []
        if shard:
            shard.end()
            yield out(shard.rows)

    dealt = paths.select("conv", "path").mapInArrow(number, "conv long, path binary, shard int")
    return dealt.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "path", "conv").mapInArrow(run, _OUT)


def _end_digests(ends: DataFrame) -> DataFrame:
    """key, ends: digest of the ids that end at each skeleton node, read in order; an id is a few bytes, and the digest needs them one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["end_key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["end_key", "ends"])

    return ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "end_key binary, ends string")


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``paths``: conv (distinct whole numbers) and path. No conversation: no node; empty paths end at the root. Copies of a path are
    dealt by their ids. ``shards``: number of ranges, by default from the paths' bytes.
    """
    shared.tune(paths.sparkSession, 4096)
    paths = shared.saved(paths, "forked-paths")
    rows = shared.saved(shard_rows(paths, splitters(paths, shards)), "trie-shards")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    parts = rows.filter(F.col("kind") == _PART).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("above").alias("above"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.first("bytes").alias("bytes"),
    )
    parts = shared.saved(parts, "trie-parts")
    within = parts.filter("parent_key is not null").groupBy(F.col("parent_key").alias("k")).agg(F.count(F.lit(1)).alias("bones"))
    bones = parts.join(within, F.col("key") == F.col("k"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("bones", F.lit(0))).drop("k", "bones")
    own = bones.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes"))
    below = own.select(F.explode(F.concat("above", F.array("key"))).alias("k"), "n_leaves", "saved_tokens").groupBy("k").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = _end_digests(rows.filter(F.col("kind") == _END))
    owners = shared.sent(shared.saved(parts.select(F.col("key").alias("owner_key"), F.col("conv_id").alias("owner")).unionByName(rows.filter(F.col("kind") == _OWNER).select(F.col("key").alias("owner_key"), F.col("conv_id").alias("owner"))), "trie-owners"))
    skeleton = bones.drop("n_leaves", "saved_tokens").join(below, F.col("key") == F.col("k")).join(ends, F.col("key") == F.col("end_key"), "left").join(owners, F.col("parent_key") == F.col("owner_key"), "left")
    skeleton = skeleton.withColumns({"parent_conv_id": F.col("owner"), "ends_sha256": F.coalesce("ends", F.lit(_EMPTY))})
    opened = rows.filter(F.col("kind") == _OPEN).join(owners, F.col("parent_key") == F.col("owner_key")).withColumn("parent_conv_id", F.col("owner"))
    return rows.filter(F.col("kind") == _CLOSED).select(*names).unionByName(opened.select(*names)).unionByName(skeleton.select(*names))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prefix_trie`` of all conversations after ``forked``. Null roles and texts are empty; rows without a conversation id belong to none."""
    turns = shared.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(forked(ordered_units(turns)))
