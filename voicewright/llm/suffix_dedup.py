"""Removal of repeated byte strings, by merged Burrows-Wheeler transforms of shards.

Every byte is removed that a ``LENGTH``-byte string covers which also starts anywhere else. Strings
never cross documents.

1. A string is known by the least hash of its ``GRAM``-byte substrings. Neighbouring strings with the same
   least hash are a segment; all occurrences of a string lie in segments of one key. Segments meet by key
   as hashes: one that meets nothing has no repeat, one that meets an equal one repeats whole. Only
   segments that meet different ones need their text.
2. These meet again by key, with their text, cut into phrases where the text itself says so. Each shard of
   segments has its suffixes sorted once and its transform taken over the phrases. Shards are merged by
   iterative interleave refinement: each round orders the merged suffixes by one phrase more, from the
   transforms alone, and a border that first appears in a round gives the common prefix there. Intervals
   whose common prefix has ``CORE`` bytes are the repeated ones.
3. Within the segments of repeated intervals, equal ``LENGTH``-byte strings are told by their hashes, which
   settles the ends to the byte.

A key with more than ``HOT`` distinct segments (a passage that many texts hold) would put them all into one task.
Its strings meet by their hashes alone: counted within each batch of texts, sent once, and dealt over tasks.

Passages shorter than ``LENGTH`` bytes stay, but are reported: ``shared_marks`` counts a text's marks that another row has too.

``CORE``: of a repeated string, phrase borders from ``2 * CUT - 1`` bytes behind its start to ``2 * CUT + MARK``
bytes before its end are the same in both places, so the suffix at the first such border shares that much.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LENGTH, GRAM = 400, 200
CUT, MARK = 48, 16
CORE = LENGTH - 4 * CUT - MARK
BUCKET_BYTES = 8_000_000
SHARD_SYMBOLS = 50_000
GROUP_BYTES = 1_500_000
#: Distinct segments of one key beyond which its strings meet by their hashes alone, and hashes that one task takes of these.
HOT = 256
PART_HASHES = 500_000
#: Words of a passage that is reported at any number of bytes, and of a mark in it.
PASSAGE, PASSAGE_GRAM = 50, 25
_SEGMENT = np.dtype([("key", "u8"), ("hash", "u8"), ("r", "i4"), ("j", "i4"), ("own", "i4"), ("many", "i4")])
_SELF = 1 << 16  # added to ``many``: the segment may repeat within itself


def _sliding(a: np.ndarray, width: int, take: np.ufunc) -> np.ndarray:
    """``take`` over each run of ``width`` values; shorter by width - 1."""
    span = 1
    while 2 * span <= width:
        a = take(a[: len(a) - span], a[span:])
        span *= 2
    return take(a[: len(a) - (width - span)], a[width - span :]) if width > span else a


def segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Segments of a run of documents; ``own`` is the document, ``j`` the first start in it, ``r`` the number of starts."""
    if len(data) < LENGTH:
        return np.zeros(0, _SEGMENT)
    prefix = shared.prefix_hash(data)
    place = np.arange(len(data) - GRAM + 1)
    gram = shared.span_hash(prefix, place, place + GRAM)
    least = _sliding(gram, LENGTH - GRAM + 1, np.minimum)
    n = np.diff(offsets)
    many = np.maximum(n - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(n)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + offsets[:-1][doc]
    if not len(start):
        return np.zeros(0, _SEGMENT)
    key = least[start]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    out = np.zeros(len(first), _SEGMENT)
    out["key"], out["own"] = key[first], doc[first]
    out["r"] = np.diff(np.append(first, len(start)))
    begin = start[first]
    out["j"] = begin - offsets[:-1][doc[first]]
    end = begin + out["r"] - 1 + LENGTH
    out["hash"] = shared.span_hash(prefix, begin, end)
    # Does the least gram stand twice in a segment? Only then can a string repeat within it.
    # The segments that hold a place follow each other, as begins and ends ascend.
    s = np.searchsorted(begin, place, "right") - 1
    times = np.zeros(len(first), np.int64)
    while True:
        held = np.flatnonzero((s >= 0) & (place + GRAM <= end[s]))
        if not len(held):
            break
        place, gram, s = place[held], gram[held], s[held]
        times += np.bincount(s[gram == out["key"][s]], minlength=len(first))
        s -= 1
    out["many"] = 1 + _SELF * ((times > 1) | (out["r"] > LENGTH))
    return out


def _bucketed(texts: DataFrame, buckets: int) -> DataFrame:
    """Segments in blocks by bucket: (bucket, segments, ids). Bucket -1: stretches known to repeat (as segments, from j on for r bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        told: set[bytes] = set()
        held, ids, size = [], [], 0

        def row(bucket: int, segs: np.ndarray) -> pa.RecordBatch:
            own, local = np.unique(segs["own"], return_inverse=True)
            segs = segs.copy()
            segs["own"] = local
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([segs.tobytes()], pa.binary()), pa.array([b"".join(ids[i] for i in own)], pa.binary())], names=["bucket", "segments", "ids"])

        def flush() -> Iterator[pa.RecordBatch]:
            s = np.concatenate(held)
            s = s[np.lexsort((s["r"], s["hash"], s["key"]))]
            first = np.flatnonzero(np.concatenate([[True], (s["key"][1:] != s["key"][:-1]) | (s["hash"][1:] != s["hash"][:-1]) | (s["r"][1:] != s["r"][:-1])]))
            many = np.diff(np.append(first, len(s)))
            known = s[np.repeat(many, many) > 1]
            if len(known):
                known["r"] += LENGTH - 1
                yield row(-1, known)
            s = s[first]
            s["many"] += (many > 1).astype(np.int32)
            bucket = (s["key"] >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            s, bucket = s[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                yield row(b, s[cut[b] : cut[b + 1]])

        for batch in batches:
            tid = batch.column(0).to_pylist()
            data, offsets = shared.buffers(batch.column(1))
            for a, b in shared.chunks(offsets):
                s = segments(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.searchsorted(s["own"], np.arange(b - a + 1))
                for i in range(b - a):
                    part = s[at[i] : at[i + 1]]
                    if not len(part):
                        continue
                    t = tid[a + i]
                    if t in told:
                        continue
                    if t in met:  # a copy: all of it repeats, which is told once
                        told.add(t)
                        ids.append(t)
                        whole = np.zeros(1, _SEGMENT)
                        whole["r"], whole["own"] = offsets[a + i + 1] - offsets[a + i], len(ids) - 1
                        yield row(-1, whole)
                        ids.pop()
                        continue
                    met.add(t)
                    part["own"] = len(ids)
                    ids.append(t)
                    held.append(part)
                    size += len(part)
                if size > 400_000:
                    yield from flush()
                    held, ids, size = [], [], 0
            if len(met) > 1_000_000:
                met.clear()
                told.clear()
        if size:
            yield from flush()

    return texts.mapInArrow(run, "bucket int, segments binary, ids binary")


_FOUND = "kind int, text_id binary, a int, b int, key long, many int"


def _found(kind: int, raw: bytes, own: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray, many: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    many = np.zeros(len(own), np.int32) if many is None else many
    for k in range(0, len(own), 50_000):
        x = slice(k, k + 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(own[x]), kind, np.int32)), pa.array([raw[i * 16 : i * 16 + 16] for i in own[x].tolist()], pa.binary()), pa.array(a[x].astype(np.int32)), pa.array(b[x].astype(np.int32)), pa.array(key[x].view(np.int64)), pa.array(many[x].astype(np.int32))],
            names=["kind", "text_id", "a", "b", "key", "many"],
        )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks sorted by bucket, one bucket at a time. Kind 0: bytes a to b of a text repeat. Kind 1: the text of the segment at a, with b starts, is needed; ``many`` distinct segments have its key."""

    def of_bucket(held: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        parts, base = [], 0
        for raw, ids in held:
            part = np.frombuffer(raw, _SEGMENT).copy()
            part["own"] += base
            base += len(ids) // 16
            parts.append(part)
        s, raw = np.concatenate(parts), b"".join(ids for _, ids in held)
        s = s[np.lexsort((s["r"], s["hash"], s["key"]))]
        new_key = np.concatenate([[True], s["key"][1:] != s["key"][:-1]])
        new = new_key | np.concatenate([[True], (s["hash"][1:] != s["hash"][:-1]) | (s["r"][1:] != s["r"][:-1])])
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, len(s)))
        group = np.cumsum(new_key)[first] - 1  # key group of each distinct segment
        kinds = np.bincount(group)
        again = (np.repeat(runs, runs) > 1) | (s["many"] % _SELF > 1)
        yield from _found(0, raw, s["own"][again].astype(np.int64), s["j"][again], s["j"][again] + s["r"][again] - 1 + LENGTH, s["key"][again])
        some = (kinds[group] > 1) | (s["many"][first] >= _SELF)
        need = s[first][some]
        yield from _found(1, raw, need["own"].astype(np.int64), need["j"], need["r"], need["key"], kinds[group][some])

    held, now = [], None
    for batch in batches:
        for bucket, raw, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if bucket < 0:
                s = np.frombuffer(raw, _SEGMENT)
                yield from _found(0, ids, s["own"].astype(np.int64), s["j"], s["j"] + s["r"], s["key"].copy())
                continue
            if bucket != now and held:
                yield from of_bucket(held)
                held = []
            now = bucket
            held.append((raw, ids))
    if held:
        yield from of_bucket(held)


# --- transforms ---------------------------------------------------------------------------------


def phrase_borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places whose ``MARK``-gram is the least of some ``CUT`` neighbouring ones within its segment."""
    if len(data) < MARK + CUT:
        return np.zeros(0, np.int64)
    place = np.arange(len(data) - MARK + 1)
    gram = shared.span_hash(shared.prefix_hash(data), place, place + MARK)
    least = _sliding(gram, CUT, np.minimum)
    n = np.diff(offsets)
    valid = np.zeros(len(data) + 1, np.int64)
    ok = n >= MARK + CUT - 1
    np.add.at(valid, offsets[:-1][ok], 1)
    np.add.at(valid, offsets[1:][ok] - (MARK + CUT - 1) + 1, -1)
    least = np.where(np.cumsum(valid)[: len(least)] > 0, least, 0)
    edge = np.zeros(CUT - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), CUT, np.maximum)[: len(gram)]
    return np.flatnonzero(most == gram)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; zeros end the strings, an earlier zero is the lesser one."""
    rank = symbols.astype(np.int64)
    zero = rank == 0
    rank[~zero] += zero.sum()
    rank[zero] = np.arange(zero.sum())
    span = 1
    while True:
        after = np.full(len(rank), -1, np.int64)
        after[:-span] = rank[span:]
        order = np.lexsort((after, rank))
        step = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        new = np.empty_like(rank)
        new[order] = np.concatenate([[0], np.cumsum(step)])
        rank, span = new, span * 2
        if step.all() or span >= len(rank):
            return order


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a shard, and the symbol before each suffix (zero before a string's first)."""
    order = suffix_order(symbols)
    return order, symbols[order - 1]


def merge(parts: list[np.ndarray], length: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes (shard of each place), and the common prefix in bytes with the place before.

    Refinement ends when no border is missing that could lie below ``core`` bytes; borders that haven't
    appeared by then have a common prefix of ``core`` or more, and count as that.
    """
    z = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    n = len(z)
    border = np.zeros(n, bool)
    border[:1] = True
    common = np.full(n, core, np.int64)
    common[:1] = 0
    depth = np.zeros(n, np.int64)
    while True:
        symbol = np.empty(n, np.int64)
        for s, part in enumerate(parts):
            symbol[z == s] = part
        block = np.cumsum(border)
        order = np.argsort(symbol, kind="stable")
        now = symbol[order]
        split = np.concatenate([[True], (now[1:] != now[:-1]) | (block[order][1:] != block[order][:-1]) | (now[1:] == 0)])
        fresh = split & ~border
        common[fresh] = np.minimum(depth[fresh], core)
        border |= split
        z = z[order]
        deeper = np.where(now == 0, 0, length[now] + depth[order])
        inner = ~border | ~np.append(border[1:], True)  # places in blocks of two or more
        stalled = not fresh.any() and np.array_equal(deeper[inner], depth[inner])
        depth = deeper
        if stalled or not (inner & (depth < core)).any():
            return z, common


def repeated_segments(data: np.ndarray, offsets: np.ndarray, shard_symbols: int = SHARD_SYMBOLS) -> np.ndarray:
    """Segments that have a suffix in a repeated interval."""
    cut = phrase_borders(data, offsets)
    if not len(cut):
        return np.zeros(0, np.int64)
    seg = np.searchsorted(offsets, cut, "right") - 1
    end = np.minimum(np.append(cut[1:], len(data)), offsets[seg + 1])
    prefix = shared.prefix_hash(data)
    _, name = np.unique(shared.span_hash(prefix, cut, end), return_inverse=True)
    length = np.zeros(name.max() + 2, np.int64)
    length[name + 1] = end - cut
    last = np.append(seg[1:] != seg[:-1], True)
    at = np.arange(len(cut)) + np.concatenate([[0], np.cumsum(last)[:-1]])  # a zero behind each segment's phrases
    symbols, owner = np.zeros(len(cut) + last.sum(), np.int64), np.zeros(len(cut) + last.sum(), np.int64)
    symbols[at], owner[at] = name + 1, seg
    ends = np.flatnonzero(symbols == 0) + 1
    owner[ends - 1] = seg[last]
    parts, orders, begin = [], [], 0
    while begin < len(symbols):
        k = min(np.searchsorted(ends, begin + shard_symbols), len(ends) - 1)
        stop = int(ends[k])
        order, before = transform(symbols[begin:stop])
        parts.append(before)
        orders.append(order + begin)
        begin = stop
    z, common = merge(parts, length, CORE)
    suffix = np.empty(len(z), np.int64)
    for s, order in enumerate(orders):
        suffix[z == s] = order
    far = common >= CORE
    both = far | np.append(far[1:], False)
    return np.unique(owner[suffix[both]])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text_id and packed spans that repeat, from rows sorted by (key, part).

    Part -2: known already. Part -1: needed segments, taken together up to ``GROUP_BYTES``, by whole keys. Others: string
    hashes of hot keys, of which one part is held at a time.
    """
    ids, start, texts, size, last = [], [], [], 0, None
    hot, now = [], None
    for batch in batches:
        for key, part, tid, places, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if hot and part != now:
                yield from _hot_repeats(hot)
                hot = []
            if part == -2:
                yield pa.RecordBatch.from_arrays([pa.array([tid], pa.binary()), pa.array([np.frombuffer(body, np.int64)], pa.list_(pa.int64()))], names=["text_id", "spans"])
                continue
            if part >= 0:
                now = part
                hot.append((tid, places, body))
                continue
            if size >= GROUP_BYTES and key != last:
                yield from _repeats_of(ids, start, texts)
                ids, start, texts, size = [], [], [], 0
            last = key
            ids.append(tid)
            start.append(int(np.frombuffer(places, np.int32)[0]))
            texts.append(body)
            size += len(body)
    if hot:
        yield from _hot_repeats(hot)
    if texts:
        yield from _repeats_of(ids, start, texts)


def _repeats_of(ids: list[bytes], start: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    hit = repeated_segments(data, offsets)
    n = offsets[hit + 1] - offsets[hit] - LENGTH + 1
    seg = np.repeat(hit, n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[seg]
    if not len(at):
        return
    h = shared.span_hash(shared.prefix_hash(data), at, at + LENGTH)
    same = _met(h)
    seg, at = seg[same], at[same]
    if len(at):
        yield _spans(ids, seg, at, np.array(start) - offsets[:-1])


def _met(h: np.ndarray) -> np.ndarray:
    """Whether a hash is there more than once."""
    order = np.argsort(h, kind="stable")
    same, equal = np.zeros(len(h), bool), h[order][1:] == h[order][:-1]
    same[order[1:][equal]] = True
    same[order[:-1][equal]] = True
    return same


def _packed(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners, and spans (start and end in one number) of strings that start at ``at``, in order of owner and place; neighbouring starts are one span."""
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(first[1:], len(at)) - 1
    return owner[first], at[first] << 32 | (at[last] + LENGTH)


def _spans(ids: list[bytes], owner: np.ndarray, at: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
    """A row per owner: its id, and its packed spans. ``base`` is added to an owner's places."""
    owner, spans = _packed(owner, at + base[owner])
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in owner[first].tolist()], pa.binary()), shared.list_array(spans, np.append(first, len(spans)), pa.int64())], names=["text_id", "spans"])


def _hot_rows(segs: list[tuple[bytes, int, bytes]], parts: int) -> list[tuple]:
    """Of the hot keys' segments (text, first place, bytes) of a batch: what repeats among them (part -2), and each distinct string's hash once, dealt over parts.

    Rows: key, part, texts (ids, one after another), places (text, place and count of each hash), hashes.
    """
    if not segs:
        return []
    h, at, own = [], [], []
    for i, (_, start, raw) in enumerate(segs):
        data = np.frombuffer(raw, np.uint8)
        place = np.arange(len(data) - LENGTH + 1)
        h.append(shared.span_hash(shared.prefix_hash(data), place, place + LENGTH))
        at.append(place + start)
        own.append(np.full(len(place), i))
    h, at, own = np.concatenate(h), np.concatenate(at), np.concatenate(own)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    many = np.diff(np.append(first, len(h)))
    again = np.zeros(len(h), bool)
    again[order] = np.repeat(many > 1, many)
    rows = []
    if again.any():
        owner, spans = _packed(own[again], at[again])
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for i, x in zip(owner[cut].tolist(), np.split(spans, cut[1:])):
            rows.append((int.from_bytes(segs[i][0][:7], "big"), -2, segs[i][0], b"", x.tobytes()))
    one = order[first]
    part = (h[one] % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    for x in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
        used, local = np.unique(own[one[x]], return_inverse=True)
        places = np.stack([local, at[one[x]], np.minimum(many[x], 2)], 1).astype(np.int32)
        rows.append((0, int(part[x[0]]), b"".join(segs[i][0] for i in used.tolist()), places.tobytes(), h[one[x]].tobytes()))
    return rows


def _hot_repeats(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """What repeats among the hashes of one part."""
    ids, place, base = [], [], 0
    for texts, places, _ in rows:
        one = np.frombuffer(places, np.int32).reshape(-1, 3).astype(np.int64)
        place.append(one + np.array([base, 0, 0]))
        ids += [texts[k : k + 16] for k in range(0, len(texts), 16)]
        base = len(ids)
    place, h = np.concatenate(place), np.concatenate([np.frombuffer(x, np.uint64) for _, _, x in rows])
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    runs = np.diff(np.append(first, len(h)))
    total = np.add.reduceat(place[order, 2], first)
    found = place[order[np.repeat(total > 1, runs)]]
    if len(found):
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        yield _spans(ids, found[:, 0], found[:, 1], np.zeros(len(ids), np.int64))


def repeats(docs: DataFrame, column: str = "text") -> DataFrame:
    """``text_id`` (16-byte digest of a text) and ``spans``: bytes that repeat, from a to b, as a * 2 ** 32 + b, in no order, may overlap."""
    spark = docs.sparkSession
    shared.tune(spark)
    texts = docs.select(F.unhex(F.md5(shared.text_or_empty(docs, column).cast("binary"))).alias("text_id"), shared.text_or_empty(docs, column).alias("text")).filter(F.octet_length("text") >= LENGTH)
    buckets = max(8, math.ceil(shared.total_bytes(docs, column) / BUCKET_BYTES))
    blocks = _bucketed(texts, buckets).repartition(F.col("bucket"), F.when(F.col("bucket") < 0, F.substring("ids", 1, 2))).sortWithinPartitions("bucket")
    met = shared.saved(blocks.mapInArrow(_meet, _FOUND), "segments")
    parts = math.ceil((met.filter(f"kind = 1 and many > {HOT}").agg(F.sum("b")).first()[0] or 0) / PART_HASHES) or 1
    need = met.filter("kind = 1").groupBy("text_id").agg(F.collect_list(F.struct("a", "b", "key", "many")).alias("parts"))
    need = shared.saved(need, "needed-segments")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of the needed segments (part -1, place of the first byte), and string hashes of those of hot keys."""
        met: set[bytes] = set()
        for batch in batches:
            rows, hot = [], []
            for tid, text, segs in zip(*(batch.column(n).to_pylist() for n in ("text_id", "text", "parts"))):
                if tid in met:
                    continue
                met.add(tid)
                raw = text.encode()
                for p in segs:
                    body = raw[p["a"] : p["a"] + p["b"] - 1 + LENGTH]
                    if p["many"] > HOT:
                        hot.append((tid, p["a"], body))
                    else:
                        rows.append((p["key"], -1, tid, np.int32(p["a"]).tobytes(), body))
            rows += _hot_rows(hot, parts)
            if len(met) > 1_000_000:
                met.clear()
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["key", "part", "text_id", "places", "body"])

    near = shared.maybe_among(texts, "text_id", need.select("text_id"), "near").filter("near").drop("near")
    given = near.join(need.hint("merge"), "text_id").mapInArrow(cut, "key long, part int, text_id binary, places binary, body binary")
    more = given.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_settled, "text_id binary, spans array<bigint>")
    known = met.filter("kind = 0").select("text_id", F.array(F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("spans"))
    every = known.unionByName(more).groupBy("text_id").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    return shared.saved(every, "repeats")


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each mark, once a document: the least hash of the ``PASSAGE_GRAM``-word strings in each ``PASSAGE``-word string."""
    start, end, first = shared.words(data, offsets)
    n = np.diff(first)
    if not (n >= PASSAGE).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = shared.prefix_hash(shared.span_hash(shared.prefix_hash(data), start, end))
    place = np.arange(len(start) - PASSAGE_GRAM + 1)
    key = _sliding(shared.span_hash(prefix, place, place + PASSAGE_GRAM), PASSAGE - PASSAGE_GRAM + 1, np.minimum)
    doc = np.repeat(np.arange(len(n)), n)
    inside = doc[PASSAGE - 1 :] == doc[: len(doc) - PASSAGE + 1]
    doc, key = doc[: len(inside)][inside], key[inside]
    for again in (False, True):  # neighbours first, so that less is sorted
        if again:
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        doc, key = doc[new], key[new]
    return doc, key


def shared_marks(docs: DataFrame, column: str = "text") -> DataFrame:
    """``text_id`` and ``n_shared_marks``: how many of a text's marks another row of ``docs`` has too; texts with none are left out.

    Marks follow from the words alone. So a passage of ``PASSAGE`` words that two rows share gives both a mark that they share, and
    rows that share no ``PASSAGE_GRAM`` words have none. Null texts and those of fewer words than ``PASSAGE`` have no marks.
    """
    shared.tune(docs.sparkSession)
    text = shared.text_or_empty(docs, column)
    texts = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("text_id"), text.alias("text")).filter(F.octet_length("text") >= 2 * PASSAGE - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = shared.buffers(batch.column(1))
            for a, b in shared.chunks(offsets):
                doc, key = marks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + a)), pa.array(key.view(np.int64))], names=["text_id", "key"])

    rows = shared.saved(texts.mapInArrow(run, "text_id binary, key long"), "marks")
    twice = shared.saved(rows.groupBy("key").count().filter("count > 1").select("key"), "marks-twice")
    near = shared.maybe_among(rows, "key", twice, "near").filter("near").select("text_id", "key").distinct()
    return shared.saved(near.join(twice, "key").groupBy("text_id").agg(F.count(F.lit(1)).alias("n_shared_marks")), "shared-marks")


def remove(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), n_shared_marks of each row.

    Null and short texts keep all they have. Rows with equal texts of ``LENGTH`` bytes or more repeat each
    other whole, whatever their ids. What is kept may not be UTF-8, as a cut can split a character. ``n_shared_marks`` (see
    ``shared_marks``) tells of passages that another row has too, also of those too short to be removed.
    """
    found = shared.saved(repeats(docs, column).join(shared_marks(docs, column), "text_id", "full"), "found")
    shared.tune(docs.sparkSession)
    text = shared.text_or_empty(docs, column)
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("text_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                kept, done, removed, runs = [], 0, 0, 0
                for a, b in ((s >> 32, s & 0xFFFFFFFF) for s in sorted(found or ())):
                    if a > done or not runs:
                        kept.append(raw[done:a])
                        runs += 1
                        removed += b - a
                        done = b
                    elif b > done:
                        removed += b - done
                        done = b
                out.append((len(raw), removed, runs, b"".join([*kept, raw[done:]])))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), batch.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared_marks"])

    # Only texts that may have a span or a shared mark are shuffled.
    marked = shared.maybe_among(rows, "text_id", found.select("text_id"), "near")
    none = marked.filter("not near").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("spans"), F.lit(0).cast("long").alias("n_shared_marks"))
    joined = marked.filter("near").join(found.hint("merge"), "text_id", "left")
    joined = joined.select("doc_id", "text", "spans", F.coalesce("n_shared_marks", F.lit(0)).cast("long").alias("n_shared_marks"))
    return none.unionByName(joined).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_shared_marks long")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_marks. Null texts are empty; repeated texts of 400 bytes or more lose what they share."""
    out = remove(shared.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_marks")
