"""Benchmark decontamination with spaced-seed hashing.

Words are runs of ASCII letters and digits and of other non-ASCII characters, in lower case (A-Z).
A document overlaps an item where, on one alignment, ``REACH`` consecutive item words (all words of an
item that has fewer) have at most ``words // 5 - 1`` substitutions: 3 in 20. An item of fewer than five
words must stand whole and unchanged.

Each length of that stretch has its own mask (``MASKS``), which ignores the positions between: with k
substitutions allowed, one of the k + 1 classes of places modulo k + 1 is free of them, so a mask of every
(k + 1)-th place has a hit in every overlap. An item's seeds are hashed with its mask at every place, a document's
with the masks of all items; the hashes are joined, and the alignments of the hits are verified word by word over
the whole item. Masks only choose the alignments, so the result is that of the definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

REACH = 20
#: Least words of the compared stretch, and the mask for it: lossless for the substitutions allowed there.
MASKS = ((20, "10001000100010001"), (15, "1001001001001"), (10, "101010101"), (5, "11011"), (4, "1101"), (3, "101"), (2, "11"), (1, "1"))
#: Words of all items up to which the items are sent to the executors; beyond, hashes are joined by a shuffle.
SENT_WORDS = 2_000_000
#: Bits of a seed by which a table of all items' seeds is kept: 2 MB, whatever their number.
FILTER_BITS = 24
SALTS = 8


def allowed(words: int) -> int:
    return max(0, min(words, REACH) // 5 - 1)


def mask_of(words: int) -> int:
    """Index in ``MASKS`` of the mask for an item of so many words."""
    return next(k for k, (least, _) in enumerate(MASKS) if words >= least)


def seeds(h: np.ndarray, first: np.ndarray, masks: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Seed hash and place (index of the first word) of a mask at every place where it fits into its text.

    ``masks``: those to use (for documents); None: of each text the one for its length (for items).
    """
    out, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    n = np.diff(first)
    last = np.repeat(first[1:], n)
    own = None
    if masks is None:
        kinds = np.array([mask_of(w) if w else -1 for w in n.tolist()], np.int64)
        own, masks = np.repeat(kinds, n), np.unique(kinds[kinds >= 0]).tolist()
    for k in masks:
        mask = MASKS[k][1]
        fits = np.arange(len(h)) + len(mask) <= last
        places = np.flatnonzero(fits if own is None else fits & (own == k))
        s = np.full(len(places), k + 1, np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                s += h[places + j] * shared._COEF[j]
        out.append(shared.mix(s))
        at.append(places)
    return np.concatenate(out), np.concatenate(at)


class Items:
    """Words and sorted seeds of benchmark items."""

    def __init__(self, ids: list, texts: list[str]):
        data, offsets = shared.buffers(pa.array(texts, pa.string()))
        self.ids = ids
        self.h, _, _, self.first = shared.word_hashes(data, offsets, shared.ALNUM)
        s, at = seeds(self.h, self.first)
        order = np.argsort(s, kind="stable")
        self.seed, self.at = s[order], at[order]
        self.item = np.searchsorted(self.first, self.at, "right") - 1
        self.masks = sorted({mask_of(n) for n in np.diff(self.first).tolist() if n})
        self.filter = np.zeros(1 << 22, bool)  # most places of documents stop here
        self.filter[(self.seed >> np.uint64(42)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (document, item, place of the item's first word in the document) of all hits."""
        s, at = seeds(h, first, self.masks)
        near = np.flatnonzero(self.filter[(s >> np.uint64(42)).astype(np.int64)])
        s, at = s[near], at[near]
        lo, hi = np.searchsorted(self.seed, s, "left"), np.searchsorted(self.seed, s, "right")
        n = hi - lo
        hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        doc = np.searchsorted(first, at, "right") - 1
        item = self.item[hit]
        shift = (at - first[doc]) - (self.at[hit] - self.first[item])
        return np.unique(np.stack([doc, item, shift], 1), axis=0) if len(doc) else np.zeros((0, 3), np.int64)

    def verify(self, h: np.ndarray, first: np.ndarray, doc: int, item: int, shift: int) -> tuple[int, int, int] | None:
        """Start and end (words of the document) of the overlapping stretch, and its equal words; None if there's none."""
        words = self.h[self.first[item] : self.first[item + 1]]
        a, b = max(0, shift), min(int(first[doc + 1] - first[doc]), shift + len(words))
        reach = min(len(words), REACH)
        if b - a < reach:
            return None
        same = h[first[doc] + a : first[doc] + b] == words[a - shift : b - shift]
        total = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(total[reach:] - total[:-reach] >= reach - allowed(reach))
        if not len(good):
            return None
        x, y = int(good[0]), int(good[-1]) + reach
        return a + x, a + y, int(total[y] - total[x])


def _overlaps(h: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, items: Items) -> list[tuple]:
    """(document, item id, char span in bytes, words, equal words) of each item found; the longest alignment of an item stands for it."""
    best: dict[tuple[int, int], tuple] = {}
    for doc, item, shift in items.candidates(h, first).tolist():
        if found := items.verify(h, first, doc, item, shift):
            a, b, same = found
            key = (same, -a)
            if (doc, item) not in best or key > best[doc, item][0]:
                best[doc, item] = (key, int(start[first[doc] + a]), int(end[first[doc] + b - 1]), b - a, same)
    return [(doc, items.ids[item], s, e, n, same) for (doc, item), (_, s, e, n, same) in sorted(best.items())]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", column: str = "text", item_column: str = "item_id", item_text: str = "text", sent_words: int = SENT_WORDS) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, start, end (bytes in the document), n_words, n_same.

    Null texts and items have no words. Repeated rows are taken each for itself. Items whose words are
    up to ``sent_words`` are sent to the executors. Beyond, seeds are joined: a table of ``FILTER_BITS`` bits holds
    back the documents' seeds that no item has, common ones are dealt over salts, and candidates are verified by
    joins. ``id_column`` may be a struct, as any value that tells rows apart.
    """
    spark = docs.sparkSession
    shared.tune(spark)
    rows = docs.select(F.col(id_column).alias("doc_id"), shared.text_or_empty(docs, column).alias("text"))
    bench = benchmark.select(F.col(item_column).alias("item_id"), shared.text_or_empty(benchmark, item_text).alias("text"))
    id_type, item_type = rows.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, start long, end long, n_words long, n_same long"
    if shared.total_bytes(bench) > 6 * sent_words:
        return _joined(rows, bench, schema)
    held = bench.collect()  # of a checked size
    sent = spark.sparkContext.broadcast(([r.item_id for r in held], [r.text for r in held]))
    cache: dict[int, Items] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if 0 not in cache:
            cache[0] = Items(*sent.value)
        for batch in batches:
            data, offsets = shared.buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            out = []
            for a, b in shared.chunks(offsets):
                h, start, end, first = shared.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.ALNUM)
                base = offsets[a : b + 1] - offsets[a]
                out += [(ids[a + d], item, s - int(base[d]), e - int(base[d]), n, same) for d, item, s, e, n, same in _overlaps(h, start, end, first, cache[0])]
            if out:
                cols = list(zip(*out))
                kinds = [batch.schema.field(0).type, pa.infer_type(cols[1]), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "start", "end", "n_words", "n_same"])

    return rows.mapInArrow(run, schema)


def _seed_rows(texts: DataFrame, masks: list[int] | None, known: np.ndarray | None = None) -> DataFrame:
    """key, mask kinds, words (hashes), and an array of the seeds with their places, for each text; only seeds in ``known``, where given."""
    sent = None if known is None else texts.sparkSession.sparkContext.broadcast(known)  # 2 ** FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if sent is None else np.unpackbits(sent.value, bitorder="little").view(bool)
        for batch in batches:
            data, offsets = shared.buffers(batch.column(1))
            for a, b in shared.chunks(offsets):
                local = offsets[a : b + 1] - offsets[a]
                h, start, end, first = shared.word_hashes(data[offsets[a] : offsets[b]], local, shared.ALNUM)
                s, at = seeds(h, first, masks)
                if table is not None:
                    near = table[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                    s, at = s[near], at[near]
                doc = np.searchsorted(first, at, "right") - 1
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(b - a + 1))
                base = np.repeat(local[:-1], np.diff(first))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([mask_of(n) if n else -1 for n in np.diff(first).tolist()], pa.int32()),
                        shared.list_array(h.view(np.int64), first, pa.int64()),
                        shared.list_array(start - base, first, pa.int64()),
                        shared.list_array(end - base, first, pa.int64()),
                        shared.list_array(s[order].view(np.int64), cut, pa.int64()),
                        shared.list_array((at - first[doc])[order], cut, pa.int64()),
                    ],
                    names=["key", "mask", "words", "starts", "ends", "seeds", "places"],
                )

    kind = texts.schema[0].dataType.simpleString()
    return texts.mapInArrow(run, f"key {kind}, mask int, words array<bigint>, starts array<bigint>, ends array<bigint>, seeds array<bigint>, places array<bigint>")


def _known(items: DataFrame) -> np.ndarray:
    """Bit table of the leading bits of all items' seeds, put together by partial aggregates."""
    leads = items.select(F.explode("seeds").alias("s")).select(F.shiftrightunsigned("s", 64 - FILTER_BITS).alias("b"))
    words = leads.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = words.toArrow()  # at most a row for each 64 bits of the table
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint8)


def _joined(rows: DataFrame, bench: DataFrame, schema: str) -> DataFrame:
    """The same rows for any number of items: seeds meet by a join, then words by two more."""
    number = lambda df, name: df.select(F.struct(F.col(df.columns[0]).alias("id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n")).alias("key"), "text")
    items = shared.saved(_seed_rows(number(bench, "b"), None), "seeds-b")
    masks = sorted(r.mask for r in items.select("mask").filter("mask >= 0").distinct().collect())
    sides = {"d": shared.saved(_seed_rows(number(rows, "d"), masks, _known(items)), "seeds-d"), "b": items}
    flat = {k: df.select(F.col("key").alias(k), F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(k, F.col("s.seeds").alias("seed"), F.col("s.places").alias(f"{k}_at")) for k, df in sides.items()}
    flat["d"] = flat["d"].withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)))
    flat["b"] = flat["b"].withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pairs = flat["d"].join(flat["b"], ["seed", "salt"]).select("d", "b", (F.col("d_at") - F.col("b_at")).alias("shift")).distinct()
    full = pairs.join(sides["d"].select(F.col("key").alias("d"), F.col("words").alias("dw"), "starts", "ends"), "d").join(sides["b"].select(F.col("key").alias("b"), F.col("words").alias("bw")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, d, shift, dw, starts, ends, bw in zip(*(batch.column(n).to_pylist() for n in ("b", "d", "shift", "dw", "starts", "ends", "bw"))):
                one = Items.__new__(Items)
                one.h, one.first = np.array(bw, np.int64), np.array([0, len(bw)])
                if found := one.verify(np.array(dw, np.int64), np.array([0, len(dw)]), 0, 0, shift):
                    x, y, same = found
                    out.append((d["id"], d["n"], b["id"], b["n"], starts[x], ends[y - 1], y - x, same, x))
            cols = list(zip(*out)) if out else [[]] * 9
            kinds = [batch.schema.field("d").type.field("id").type, pa.int64(), batch.schema.field("b").type.field("id").type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "dn", "item_id", "bn", "start", "end", "n_words", "n_same", "at"])

    kinds = schema.split(", ")
    found = full.mapInArrow(run, f"{kinds[0]}, dn long, {kinds[1]}, bn long, start long, end long, n_words long, n_same long, at long")
    best = found.groupBy("doc_id", "dn", "item_id", "bn").agg(F.max_by(F.struct("start", "end", "n_words", "n_same"), F.struct("n_same", -F.col("at"))).alias("x"))
    return best.select("doc_id", "item_id", "x.*")


def flag(docs: DataFrame, benchmark: DataFrame, column: str = "text", **options) -> DataFrame:
    """All columns of ``docs`` and ``overlap``: struct of n_items, n_same (of the longest overlap), item_ids (ascending); null where a row is clean.

    Rows meet their overlaps by id and text, so a null or repeated id makes no difference. A column ``overlap`` of ``docs`` is replaced.
    """
    rows = docs.drop("overlap")
    key, found_key = shared.fresh_name(rows, "row_key"), shared.fresh_name(rows, "found_key")
    keyed = rows.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64(shared.text_or_empty(rows, column)).alias("h"), F.unhex(F.md5(shared.text_or_empty(rows, column).cast("binary"))).alias("m")))
    hits = overlaps(keyed.select(key, column), benchmark, id_column=key, column=column, **options)
    per = hits.groupBy(F.col("doc_id").alias(found_key)).agg(F.struct(F.count_distinct("item_id").alias("n_items"), F.max("n_same").alias("n_same"), F.array_sort(F.collect_set("item_id")).alias("item_ids")).alias("overlap"))
    per = shared.sent(shared.saved(per, "overlaps"))
    same = keyed[key]["id"].eqNullSafe(per[found_key]["id"]) & (keyed[key]["h"] == per[found_key]["h"]) & (keyed[key]["m"] == per[found_key]["m"])
    return keyed.join(per, same, "left").select(*rows.columns, "overlap")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with what it shares with the benchmark: n_items 0 and no ids where it's clean."""
    docs, bench = shared.read(spark, sf_dir, "documents").select("doc_id", "text"), shared.read(spark, sf_dir, "benchmark")
    found, many = flag(docs, bench), F.coalesce("overlap.n_items", F.lit(0))
    return found.select("doc_id", (many > 0).alias("contaminated"), many.cast("long").alias("n_items"), F.coalesce("overlap.n_same", F.lit(0)).cast("long").alias("n_same_words"), F.array_join("overlap.item_ids", ",").alias("item_ids"))
