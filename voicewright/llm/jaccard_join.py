"""Exact n-gram Jaccard join with set-relation skipping.

A document's set holds its distinct five-word shingles. Equal sets are one class from the start, known
by a 128-bit identity, so copies meet only in a count. The join of distinct sets has three steps.

1. Elimination. Two linked sets share a given number of shingles within extended prefixes (the
   ``EXTRA`` rule below), in the order of hashes. Prefix shingles are dealt in blocks over buckets; a set
   whose prefix shares too few with all others can't have a link. Shingles that several sets of one
   map task share are counted there and sent once, so frequent ones don't pile up.
2. Index lists. The remaining sets are ordered by (frequency level, hash), rare shingles first, and
   their prefixes are indexed by shingle. A list has a leader, its entry of most rest (shingles of the set
   from the entry's position on). A list skips the block of all entries whose rest can't reach the overlap
   that a link with the shortest set it could have needs. Sets that share a leader are a family, whatever the
   number of lists that they meet in.
3. Answers from answers. Each set of a family is told by its differences from the leader: A, the leader's
   shingles that it lacks, and B, those it adds. With x the leader's size and c = 4 |A| + 3 |B|, a set is linked to
   the leader where c <= x, and two sets y, z of the family where 7 |(A_y & A_z) + (B_y & B_z)| >= c_y + c_z - x:
   their overlap follows from the answers to the leader and from what their differences share, without their sets.
   Links to leaders are joined into components. What lies outside the leader's component is compared with the rest of the
   family, in blocks of ``BLOCK_TOKENS`` differences: each pair of blocks is dealt for itself, so that a large family is many
   tasks. A pair of blocks gives the links that join its components, never its pairs.

Two sets of one component need no further comparison: their class is already known.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .graph import components

SHINGLE = 5
THRESHOLD = 75  # percent
EXTRA = 10  # percent of a set's size by which its prefix is extended in the first step
BUCKET_BYTES = 8_000_000
#: Sets that hold a shingle from which on it counts as frequent.
FREQUENT = 8
#: Differences (and places for sets) in a block of a family.
BLOCK_TOKENS = 60_000


def _least(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n must share with any linked one: ceil(0.75 n)."""
    return -(-n * THRESHOLD // 100)


def _extra(n: np.ndarray) -> np.ndarray:
    return -(-n * EXTRA // 100)


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = shared.buffers(batch.column(column))
    for a, b in shared.chunks(offsets):
        tokens, at = shared.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SHINGLE)
        yield a, b, tokens, at


def set_table(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes; null for an empty set) of each row."""
    shared.tune(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), shared.text_or_empty(docs, column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, tokens, at in _sets(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at), pa.int64()), pa.array(shared.set_ids(tokens, at), pa.binary())], names=["doc_id", "n_shingles", "set_id"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_shingles long, set_id binary")


def _prefixes(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """Extended prefix of each row's text, by hash."""
    for _a, _b, tokens, at in _sets(batch, 0):
        for i, sid in enumerate(shared.set_ids(tokens, at)):
            if sid is not None:
                n = int(at[i + 1] - at[i])
                yield sid, tokens[at[i] : at[i] + int(n - _least(n) + _extra(n))]


def _whole(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """Whole sets, from columns set_id and shingles."""
    column = batch.column(1)
    at, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    for i, sid in enumerate(batch.column(0).to_pylist()):
        yield sid, flat[at[i] : at[i + 1]]


def _blocks(rows: DataFrame, buckets: int, of: Callable[[pa.RecordBatch], Iterator[tuple[bytes, np.ndarray]]]) -> DataFrame:
    """Shingles in blocks: (bucket, shingles, how many sets each had here, table of set ids, owner of single ones) or local counts (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        held_t, held_o, held_ids, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            t, o = np.concatenate(held_t), np.concatenate(held_o)
            order = np.argsort(t, kind="stable")
            t, o = t[order], o[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            many = np.diff(np.append(first, len(t)))
            ids = np.frombuffer(b"".join(held_ids), "V16")
            # Shared within this block: counted here for their sets, and sent once without an owner.
            here = np.bincount(o[np.repeat(many, many) > 1], minlength=len(ids))
            some = np.flatnonzero(here)
            t, o = t[first], np.where(many > 1, -1, o[first])
            bucket = (t >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            t, o, many, bucket = t[order], o[order], many[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            rows = [(-1, here[some].astype(np.int32).tobytes(), b"", ids[some].tobytes(), b"")]
            for b in np.flatnonzero(np.diff(cut)).tolist():
                x = slice(cut[b], cut[b + 1])
                own = o[x]
                back, local = np.unique(own[own >= 0], return_inverse=True)
                owner = np.full(len(own), -1, np.int32)
                owner[own >= 0] = local
                rows.append((b, t[x].tobytes(), np.minimum(many[x], 65535).astype(np.uint16).tobytes(), ids[back].tobytes(), owner.tobytes()))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "shingles", "many", "ids", "owner"])

        for batch in batches:
            for sid, tokens in of(batch):
                if sid in met:
                    continue
                met.add(sid)
                held_t.append(tokens)
                held_o.append(np.full(len(tokens), len(held_ids)))
                held_ids.append(sid)
                size += len(tokens)
                if size > 1_000_000:
                    yield flush()
                    held_t, held_o, held_ids, size = [], [], [], 0
            if len(met) > 1_000_000:
                met.clear()
        if size:
            yield flush()

    return rows.mapInArrow(run, "bucket int, shingles binary, many binary, ids binary, owner binary")


def _shared_counts(targets: int):
    """From all blocks of some buckets: how many shingles each set shares (kind 0, packed by target), and frequent shingles with their counts (kind 1)."""
    names = ["kind", "target", "ids", "counts"]

    def packed(raw: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
        if not len(n):
            return None
        to = raw[:, 0] % np.uint64(targets)
        order = np.argsort(to, kind="stable")
        raw, n, to = raw[order], n[order], to[order]
        cut = np.searchsorted(to, np.arange(targets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut)).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(some), np.int32)), pa.array(some, pa.int32()), pa.array([raw[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()), pa.array([n[cut[k] : cut[k + 1]].astype(np.int32).tobytes() for k in some], pa.binary())], names=names
        )

    def of_bucket(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = [np.frombuffer(c, np.uint64).reshape(-1, 2) for _, _, c, _ in rows]
        base = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        own = [np.frombuffer(d, np.int32) for _, _, _, d in rows]
        t, m = np.concatenate([np.frombuffer(a, np.uint64) for a, _, _, _ in rows]), np.concatenate([np.frombuffer(b, np.uint16) for _, b, _, _ in rows]).astype(np.int64)
        o, ids = np.concatenate([np.where(x >= 0, x + k, -1) for x, k in zip(own, base)]), np.concatenate(ids)
        order = np.argsort(t, kind="stable")
        t, m, o = t[order], m[order], o[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        runs = np.diff(np.append(first, len(t)))
        total = np.add.reduceat(m, first)
        both = (np.repeat(total, runs) > 1) & (o >= 0)
        many = np.bincount(o[both], minlength=len(ids))
        if (out := packed(ids[many > 0], many[many > 0])) is not None:
            yield out
        hot = np.flatnonzero(total >= FREQUENT)
        if len(hot):
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([-1], pa.int32()), pa.array([t[first[hot]].tobytes()], pa.binary()), pa.array([total[hot].astype(np.int32).tobytes()], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one bucket is held at a time."""
        rows, now = [], None
        for batch in batches:
            for bucket, a, b, c, d in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bucket < 0:
                    if (out := packed(np.frombuffer(c, np.uint64).reshape(-1, 2), np.frombuffer(a, np.int32).astype(np.int64))) is not None:
                        yield out
                    continue
                if bucket != now and rows:
                    yield from of_bucket(rows)
                    rows = []
                now = bucket
                rows.append((a, b, c, d))
        if rows:
            yield from of_bucket(rows)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set_id and its number of shared shingles, from packed counts sorted by target; one target is held at a time."""

    def of_target(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for x, _ in rows])
        n = np.concatenate([np.frombuffer(x, np.int32) for _, x in rows]).astype(np.int64)
        order = np.lexsort((ids[:, 1], ids[:, 0]))
        ids, n = ids[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(1)]))
        raw, total = ids[first].tobytes(), np.add.reduceat(n, first)
        for k in range(0, len(first), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([raw[i * 16 : i * 16 + 16] for i in range(k, min(k + 50_000, len(first)))], pa.binary()), pa.array(total[k : k + 50_000])], names=["id", "shared"])

    rows, now = [], None
    for batch in batches:
        for target, ids, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if target != now and rows:
                yield from of_target(rows)
                rows = []
            now = target
            rows.append((ids, n))
    if rows:
        yield from of_target(rows)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.floor(np.log2(np.frombuffer(n, np.int32))).astype(np.int32))], names=["shingle", "level"])


def _counted(rows: DataFrame, buckets: int, of: Callable, name: str) -> tuple[DataFrame, DataFrame]:
    """How many of its shingles in ``rows`` each set shares with another set (id, shared), and the frequent shingles (shingle, level)."""
    blocks = _blocks(rows, buckets, of).repartition(F.col("bucket"), F.when(F.col("bucket") < 0, F.substring("ids", 1, 2))).sortWithinPartitions("bucket")
    counts = shared.saved(blocks.mapInArrow(_shared_counts(max(4, buckets // 4)), "kind int, target int, ids binary, counts binary"), name)
    found = counts.filter("kind = 0").repartition("target").sortWithinPartitions("target").select("target", "ids", "counts").mapInArrow(_summed, "id binary, shared long")
    hot = counts.filter("kind = 1").select("ids", "counts").mapInArrow(_frequent, "shingle long, level int")
    return found, hot


def _remaining(texts: DataFrame, sizes: DataFrame, buckets: int) -> DataFrame:
    """Identities of sets whose extended prefixes share enough for a link."""
    found, _ = _counted(texts, buckets, _prefixes, "shared-in-prefixes")
    need = F.ceil(F.ceil(F.col("n") * THRESHOLD / 100) * EXTRA / 100)
    return sizes.join(found, sizes.set_id == found.id).filter(F.col("shared") >= need).select("set_id")


def _sets_of(docs: DataFrame, base: DataFrame, left: DataFrame, id_column: str, column: str) -> DataFrame:
    """set_id, shingles (array of long) of the remaining sets, one row each."""
    rows = docs.select(F.col(id_column).alias("doc_id"), shared.text_or_empty(docs, column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, tokens, at in _sets(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.set_ids(tokens, at), pa.binary()), shared.list_array(tokens.view(np.int64), at, pa.int64())], names=["doc_id", "set_id", "shingles"])

    first = base.groupBy("set_id").agg(F.min("doc_id").alias("rep")).join(left, "set_id", "left_semi")
    first = shared.sent(shared.saved(first, "set-owners"))
    all_sets = rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, set_id binary, shingles array<bigint>")
    kept = all_sets.join(first.withColumnRenamed("set_id", "sid"), (F.col("set_id") == F.col("sid")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    return shared.saved(kept.select("set_id", "shingles").dropDuplicates(["set_id"]), "sets")


def _ordered_sets(sets: DataFrame, buckets: int) -> DataFrame:
    """set_id, n, shingles (structs of level and shingle, in this order) of the sets that share three quarters of their shingles or more."""
    found, hot = _counted(sets.select("set_id", "shingles"), buckets, _whole, "shared-in-sets")
    full = sets.join(found.withColumnRenamed("id", "set_id"), "set_id").filter(F.col("shared") >= F.ceil(F.size("shingles") * THRESHOLD / 100))
    each = full.select("set_id", F.explode("shingles").alias("shingle")).join(shared.sent(shared.saved(hot, "frequent-shingles")), "shingle", "left")
    item = F.struct(F.coalesce("level", F.lit(0)).alias("level"), "shingle")
    listed = each.groupBy("set_id").agg(F.array_sort(F.collect_list(item)).alias("shingles"))
    return shared.saved(listed.select("set_id", F.size("shingles").cast("long").alias("n"), "shingles"), "ordered-sets")


def _entries(sets: DataFrame) -> DataFrame:
    """Index entries of prefixes: shingle, salt, level, set_id, n, rest (shingles of the set from this position on).

    The entries of a frequent shingle are dealt over salts, one for 256 sets that hold it, so that no list is one task.
    """
    prefix = F.slice("shingles", 1, (F.col("n") - F.ceil(F.col("n") * THRESHOLD / 100) + 1).cast("int"))
    rows = sets.select("set_id", "n", F.posexplode(prefix).alias("pos", "s"))
    salt = F.pmod(F.xxhash64("set_id"), _salts(F.col("s.level")))
    return rows.select("s.shingle", salt.alias("salt"), "s.level", "set_id", "n", (F.col("n") - F.col("pos")).alias("rest"))


def _salts(level: F.Column) -> F.Column:
    return F.pow(F.lit(2), F.greatest(level - 7, F.lit(0))).cast("long")


def _families(sets: DataFrame) -> DataFrame:
    """set_id and leader of the sets that meet in a list, each pair once.

    A list's leader is the entry of most rest (then greatest set_id), found by partial aggregates. An entry stays only if
    its rest reaches the overlap with some set that its own size allows and that the leader's rest allows too.
    """
    entries = shared.saved(_entries(sets), "entries")
    lists = entries.groupBy("shingle").agg(F.max_by(F.struct("set_id", "n", "rest"), F.struct("rest", "set_id")).alias("lead"), F.count(F.lit(1)).alias("many"), F.max("level").alias("level"), F.min("n").alias("shortest")).filter("many > 1")
    dealt = lists.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), _salts(F.col("level")) - 1)).alias("salt"), F.col("lead.set_id").alias("leader"), "shortest")
    met = entries.drop("level").join(dealt, ["shingle", "salt"])
    least_other = F.greatest("shortest", F.ceil(F.col("n") * THRESHOLD / 100))
    return met.filter(F.col("rest") >= _needed(F.col("n"), least_other)).select("set_id", "leader").distinct()


def _needed(n, m):
    """Least overlap of linked sets of n and m: ceil(75 (n + m) / 175)."""
    return F.ceil((n + m) * THRESHOLD / (100 + THRESHOLD))


_ADDED = 0x2545F4914F6CDD1D  # tells shingles that a set adds from those that it lacks


def _answers(families: DataFrame, sets: DataFrame) -> DataFrame:
    """leader, set_id, x (the leader's size), cost (4 |A| + 3 |B|), differences (A, and B marked)."""
    side = lambda k, v: sets.select(F.col("set_id").alias(k), F.transform("shingles", lambda s: s["shingle"]).alias(v))
    both = families.join(side("set_id", "own"), "set_id").join(side("leader", "led"), "leader")
    lacks, adds = F.array_except("led", "own"), F.array_except("own", "led")
    parts = both.select("leader", "set_id", F.size("led").cast("long").alias("x"), lacks.alias("lacks"), adds.alias("adds"))
    marked = F.concat("lacks", F.transform("adds", lambda t: t.bitwiseXOR(F.lit(_ADDED))))
    return parts.select("leader", "set_id", "x", (4 * F.size("lacks") + 3 * F.size("adds")).cast("long").alias("cost"), marked.alias("differences"))


def _joining(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of links between components a and b, the places of those that join what the links before have not."""
    top: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := top.get(c, c)) != c:
            top[c] = top.get(up, up)
            c = up
        return c

    pair, first = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
    kept = []
    for (p, q), i in zip(pair.tolist(), first.tolist()):
        p, q = find(p), find(q)
        if p != q:
            top[max(p, q)] = min(p, q)
            kept.append(i)
    return np.array(kept, np.int64)


def _block_links(ids: np.ndarray, comp: np.ndarray, cost: np.ndarray, tokens: np.ndarray, at: np.ndarray, right: np.ndarray, x: int) -> Iterator[tuple[bytes, bytes]]:
    """Links between different components of the sets of a block (not ``right``) and another, or of one block alone.

    ``at``: the borders of each set's differences in ``tokens``. A link needs a difference that both have.
    """
    own = np.repeat(np.arange(len(ids)), np.diff(at))
    left_rows, right_rows = np.flatnonzero(~right), np.flatnonzero(right) if right.any() else np.arange(len(ids))
    place_l, place_r = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    place_l[left_rows], place_r[right_rows] = np.arange(len(left_rows)), np.arange(len(right_rows))
    _, name = np.unique(tokens, return_inverse=True)
    on_right = right[own] if right.any() else np.ones(len(own), bool)
    on_left = ~right[own]
    both = np.isin(name, name[on_left]) & np.isin(name, name[on_right]) & (np.bincount(name)[name] > 1)
    share = np.zeros((len(left_rows), len(right_rows)), np.float32)
    used, small = np.unique(name[both], return_inverse=True)
    own, on_left, on_right = own[both], on_left[both], on_right[both]
    for k in range(0, len(used), 2048):  # tokens that both sides have, some at a time
        here = (small >= k) & (small < k + 2048)
        width = min(2048, len(used) - k)
        p, q = np.zeros((len(left_rows), width), np.float32), np.zeros((len(right_rows), width), np.float32)
        p[place_l[own[here & on_left]], small[here & on_left] - k] = 1
        q[place_r[own[here & on_right]], small[here & on_right] - k] = 1
        share += p @ q.T
    need = cost[left_rows][:, None] + cost[right_rows][None] - x
    link = (7 * share >= need) & (comp[left_rows][:, None] != comp[right_rows][None])
    i, j = np.nonzero(link)
    if len(i):
        i, j = left_rows[i], right_rows[j]
        for k in _joining(comp[i], comp[j]).tolist():
            yield ids[i[k]], ids[j[k]]


def _cross_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links u, v from rows sorted by (leader, i, j): a pair of blocks of a family at a time."""
    held, now = [], None

    def close() -> pa.RecordBatch | None:
        ids, comp, cost, right, x, tokens = zip(*held)
        code = {c: k for k, c in enumerate(dict.fromkeys(comp))}
        at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        found = list(_block_links(np.array(ids, object), np.array([code[c] for c in comp]), np.array(cost, np.int64), np.concatenate(tokens), at, np.array(right), x[0]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["u", "v"]) if found else None

    for batch in batches:
        flat = batch.column(8)
        at, values = flat.offsets.to_numpy(), flat.values.to_numpy()
        for k, (leader, i, j, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(8)))):
            if (leader, i, j) != now and held and (out := close()) is not None:
                yield out
            now = (leader, i, j)
            held.append((*row, values[at[k] : at[k + 1]].copy()))
    if held and (out := close()) is not None:
        yield out


def links(docs: DataFrame, base: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Components of distinct sets: set_id, comp (the least set_id of its component), for sets with a link to another set."""
    sizes = base.filter("set_id is not null").groupBy("set_id").agg(F.first("n_shingles").alias("n"))
    texts = docs.select(shared.text_or_empty(docs, column).alias("text"))
    buckets = max(8, math.ceil(shared.total_bytes(texts) / BUCKET_BYTES))
    sets = _ordered_sets(_sets_of(docs, base, _remaining(texts, sizes, buckets), id_column, column), buckets)
    answers = shared.saved(_answers(_families(sets), sets), "answers")
    found = answers.filter("cost <= x").select(F.col("set_id").alias("u"), F.col("leader").alias("v"))
    comps = components(found)

    # Families with sets outside their leader's component: those are compared with each other, and with those inside.
    of = lambda key, name: shared.sent(comps.select(F.col("set_id").alias(key), F.col("comp").alias(name)))
    rows = answers.filter("set_id <> leader").join(of("set_id", "comp"), "set_id", "left").join(of("leader", "leader_comp"), "leader", "left")
    rows = rows.withColumn("comp", F.coalesce("comp", "set_id")).withColumn("inside", F.col("comp") == F.coalesce("leader_comp", "leader"))
    blocks = lambda inside: F.ceil(F.coalesce(F.sum(F.when(F.col("inside") == inside, F.size("differences") + 256)), F.lit(0)) / BLOCK_TOKENS)
    sizes = rows.groupBy("leader").agg(F.count(F.lit(1)).alias("many"), blocks(False).alias("outer"), blocks(True).alias("inner"))
    mixed = shared.saved(sizes.filter("many > 1 and outer > 0").select("leader", "outer", "inner"), "mixed-families")
    dealt = rows.join(shared.sent(mixed), "leader")
    own, zero = F.xxhash64("set_id"), F.lit(0).cast("long")
    dealt = dealt.withColumn("block", F.when(F.col("inside"), F.col("outer") + F.pmod(own, F.greatest("inner", F.lit(1)))).otherwise(F.pmod(own, "outer")))
    last = F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    dealt = dealt.select("leader", "set_id", "comp", "cost", "x", "differences", "block", F.explode(F.sequence(zero, last)).alias("other"))
    dealt = dealt.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set_id", "comp", "cost", (F.col("block") > F.col("other")).alias("right"), "x", "differences")
    shared.tune(docs.sparkSession)
    cross = dealt.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(_cross_links, "u binary, v binary")
    more = shared.saved(cross.distinct(), "later-links")
    return comps if more.isEmpty() else components(found.unionByName(more))


def classes(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach, its own included) of each row.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows
    with equal sets are linked. Repeated ids are taken each for itself; a null id is never the least
    unless all of a component are null. Other columns are left out.
    """
    base = shared.saved(set_table(docs, id_column, column), "sets-of-rows")
    comps = links(docs, base, id_column, column)
    least = base.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    of_comp = least.join(comps, "set_id").groupBy("comp").agg(F.min("least").alias("c"))
    named = comps.join(of_comp, "comp").select("set_id", F.col("c"))
    per_set = least.join(named, "set_id", "left").select(F.col("set_id").alias("sid"), F.coalesce("c", "least").alias("component_id"))
    out = base.join(per_set, base.set_id == F.col("sid"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_shingles, component_id. Null and empty texts have no shingles and are linked with nothing; copies are linked."""
    return classes(shared.read(spark, sf_dir, "documents"))
