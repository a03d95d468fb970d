"""Quality rules, and a modified Kneser-Ney model whose perplexity bands reject documents.

The model is over UTF-8 bytes, of order ``ORDER``, one for each language. Spark counts the n-grams of all texts
(partial counts in each task first), and lower orders and discounts follow from that table by grouping. Estimated
probabilities are kept as arrays sorted by hash, and looked up by binary search. A text is judged as a whole, from its
begin mark to its end mark: its figure is the mean number of bits of its bytes and its end. The band is the language's
median, plus or minus ``WIDTH`` deviations; short texts, whose mean varies more, have a wider one. Bands come from
counts of rounded figures, so they're exact and don't depend on how rows are dealt. A second estimate, over the bytes
alone, gives the bits a byte that are reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

ORDER = 3
PAD, END = 0xFF, 0xFE  # stand before and after a text; no bytes of UTF-8
WIDTH = 3.5
LEAST_WORDS = 50
#: Least deviations in bits: of long texts, and of one byte (a text of n bytes has this over sqrt(n)).
LEAST_SPREAD, LEAST_BYTE_SPREAD = 0.01, 0.5
#: Counts that a task holds before it hands them on.
HELD = 1_000_000
#: Steps of rounding, in bits.
_STEP = 1 / 1024
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, bits double, whole_bits double"


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte and at the end of each document, its last symbol lowest, and the documents' offsets among these.

    ``PAD`` stands before each document, ``END`` behind it.
    """
    n = np.diff(offsets)
    ends = offsets + np.arange(len(offsets))
    begin = np.repeat(ends[:-1], n + 1)
    symbols = np.full(len(begin), END, np.uint32)
    symbols[np.arange(len(data)) + np.repeat(np.arange(len(n)), n)] = data
    place = np.arange(len(symbols)) - begin
    out = symbols.copy()
    for j in range(1, ORDER):
        before = np.full(len(symbols), PAD, np.uint32)
        before[j:] = symbols[:-j] if j < len(symbols) else []
        before[place < j] = PAD
        out |= before << np.uint32(8 * j)
    return out, ends


def _runs(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Language, rows, bytes and offsets of a few megabytes of documents of one language."""
    names = np.array(langs.fill_null("").to_pylist(), object)
    for lang in dict.fromkeys(names.tolist()):
        rows = np.flatnonzero(names == lang)
        data, offsets = shared.buffers(texts.take(pa.array(rows)))
        for a, b in shared.chunks(offsets):
            yield lang, rows[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, n: the n-grams of all texts and of their ends by language. A null language is the empty one; null texts are empty."""
    shared.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for name, _, data, offsets in _runs(batch.column(0), batch.column(1)):
                keys, n = np.unique(grams(data, offsets)[0], return_counts=True)
                if name in held:
                    both = np.concatenate([held[name][0], keys])
                    keys, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[name][1], n]), len(keys)).astype(np.int64)
                held[name] = keys, n
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), shared.text_or_empty(docs, text).alias("text"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def estimate(counts: DataFrame) -> DataFrame:
    """lang, whole, k, gram, p and backoff of all n-grams of order k = 1 to ``ORDER``: interpolated modified Kneser-Ney.

    ``p`` is the probability of the last symbol after the others; ``backoff`` the weight that the context of these others leaves
    to the order below. The count of a lower order is the number of symbols that stand before the n-gram. Rows with ``whole`` are
    the model of whole texts: ``END`` is a symbol like others, and n-grams at a text's begin, before which only ``PAD`` can stand,
    keep their own counts in lower orders. Rows without it are the model of the bytes alone, ``PAD`` being a symbol like others.
    """
    counts = shared.saved(counts, "grams")
    inner = counts.filter(F.col("gram").bitwiseAND(0xFF) != END)
    return _estimate(inner, False).unionByName(_estimate(counts, True))


def _estimate(counts: DataFrame, whole: bool) -> DataFrame:
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        suffixes = orders[k + 1].select("lang", F.col("gram").bitwiseAND((1 << (8 * k)) - 1).alias("gram"), "n")
        n = F.count(F.lit(1))
        if whole:
            n = F.when(F.shiftright("gram", 8 * (k - 1)) == PAD, F.sum("n")).otherwise(n)
        orders[k] = suffixes.groupBy("lang", "gram").agg(n.alias("n"))
    lower, every = None, None
    for k in range(1, ORDER + 1):
        c = orders[k]
        # Discounts for counts of 1, 2 and more, from the counts of counts.
        n1, n2, n3, n4 = (F.count_if(F.col("n") == i) for i in range(1, 5))
        y = F.when(n1 + n2 > 0, n1 / (n1 + 2 * n2)).otherwise(0.0)
        less = lambda i, a, b: F.least(F.lit(float(i)), F.greatest(F.lit(0.0), F.when(a > 0, i - (i + 1) * y * b / a).otherwise(0.0)))
        discounts = c.groupBy("lang").agg(less(1, n1, n2).alias("d1"), less(2, n2, n3).alias("d2"), less(3, n3, n4).alias("d3"))
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = c.join(discounts, "lang").select("lang", "gram", "n", F.shiftright("gram", 8).alias("context"), F.least(taken, F.col("n")).alias("d"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("all"), (F.sum("d") / F.sum("n")).alias("backoff"))
        rows = rows.join(contexts, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(below, ["lang", "suffix"])
        p = (F.col("n") - F.col("d")) / F.col("all") + F.col("backoff") * F.col("below")
        lower = shared.saved(rows.select("lang", F.lit(whole).alias("whole"), F.lit(k).alias("k"), "gram", p.alias("p"), "backoff"), f"order-{k}")
        every = lower if every is None else every.unionByName(lower)
    return every


class Arrays:
    """The model of one language, of ``whole`` texts or of bytes alone: probabilities of all pairs, and of the highest order as arrays sorted by hash."""

    def __init__(self, table: pa.Table, whole: bool = False):
        table = table.filter(pc.equal(table.column("whole"), whole))
        k, gram, p, backoff = (table.column(c).to_numpy() for c in ("k", "gram", "p", "backoff"))
        one, rest = np.full(256, 1 / 256), np.ones(256)
        one *= backoff[k == 1][0] if (k == 1).any() else 1
        one[gram[k == 1]] = p[k == 1]
        rest[gram[k == 2] >> 8] = backoff[k == 2]
        two = (rest[:, None] * one).ravel()
        two[gram[k == 2]] = p[k == 2]
        self.two, self.rest = two, np.ones(1 << 16)
        self.rest[gram[k == 3] >> 8] = backoff[k == 3]
        hashes = shared.mix(gram[k == 3].astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.bits = hashes[order], -np.log2(p[k == 3][order])

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each n-gram's last symbol after the others; without the n-gram, by the orders below."""
        h = shared.mix(keys.astype(np.uint64))
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        seen = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        out = np.zeros(len(h))
        out[seen] = self.bits[at[seen]]
        rest = keys[~seen].astype(np.int64)
        out[~seen] = -np.log2(self.rest[rest >> 8] * self.two[rest & 0xFFFF])
        return out


def base_measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    start, end, first = shared.words(data, offsets)
    n_docs = len(offsets) - 1
    total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    letters = total((data & 0xC0) != 0x80)
    chars = np.concatenate([[0], np.cumsum(letters[end] - letters[start])])[first]
    symbols = total(_SYMBOLS[data])[offsets]
    prefix = shared.prefix_hash(data)
    w = shared.span_hash(prefix, start, end)

    # Words in windows of three that the document has twice.
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    again = np.zeros(len(w) + 1, np.int64)
    if len(w) > 2:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        h = shared.mix(shared.mix(shared.mix(w[inside] + np.uint64(1)) + w[inside + 1]) + w[inside + 2]) + doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, at, n = np.unique(h, return_inverse=True, return_counts=True)
        found = inside[n[at] > 1]
        np.add.at(again, found, 1)
        np.add.at(again, np.minimum(found + 3, len(w)), -1)
    repeated = total(np.cumsum(again[:-1]) > 0)[first]

    # Lines with a word that stand earlier in the document.
    cuts = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    of = np.searchsorted(offsets, begin, "right") - 1
    mine = np.searchsorted(cuts, begin)
    stop = np.minimum(np.concatenate([cuts, [len(data)]])[mine], offsets[np.minimum(of + 1, n_docs)]) if n_docs else begin
    full = total(shared.SPACED[data])
    stop = np.maximum(stop, begin)
    worded = full[stop] > full[begin]
    begin, stop, of = begin[worded], stop[worded], of[worded]
    h = shared.span_hash(prefix, begin, stop) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, firsts = np.unique(h, return_index=True)
    lines = np.bincount(of, minlength=n_docs) - np.bincount(of[firsts], minlength=n_docs)
    return [np.diff(first), np.diff(chars), np.diff(symbols), lines, np.diff(repeated)]


def measure(docs: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", output: str = "quality", most: int = shared.SENT_BYTES) -> DataFrame:
    """``docs`` with a struct ``output`` of ``MEASURES``; ``bits`` is the cost of the text's bytes under the model of its language,
    ``whole_bits`` that of the text with its end, under the model of whole texts.

    A model of over ``most`` bytes is sent in parts, by the context, each over the rows written by the one before; a part's
    bits are added up. Null texts are empty and cost nothing but their end, a null language is the empty one; rows that repeat are judged one by one.
    ``output`` must be a name that ``docs`` doesn't have.
    """
    spark = docs.sparkSession
    shared.tune(spark)
    parts = max(1, math.ceil(shared.table_bytes(model) / most))
    at = [docs.columns.index(c) for c in (text, lang)]
    kind = shared.schema_with(docs, (output, f"struct<{MEASURES.replace(' ', ':').replace(',:', ',')}>"))
    out, names = docs, kind.names
    for i in range(parts):
        # The lower orders are at most 2 ** 16 pairs a language and model; they go with each part of the highest one.
        sent = model if parts == 1 else model.filter((F.col("k") < ORDER) | (F.shiftright("gram", 8) % parts == i))
        table = sent.toArrow()
        langs = np.array(table.column("lang").to_pylist(), object)
        own = {name: table.take(pa.array(np.flatnonzero(langs == name))) for name in dict.fromkeys(langs.tolist())}
        arrays = {name: (Arrays(t), Arrays(t, whole=True)) for name, t in own.items()}

        def run(batches: Iterator[pa.RecordBatch], i=i, arrays=arrays) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, texts = batch.column(at[1]).cast(pa.string()), batch.column(at[0]).cast(pa.string())
                got = [np.zeros(len(texts), np.int64) for _ in range(6)] + [np.zeros(len(texts)) for _ in range(2)]
                for name, rows, data, offsets in _runs(langs, texts):
                    keys, ends = grams(data, offsets)
                    costs = [m.cost(keys) for m in arrays[name]] if name in arrays else [np.full(len(keys), 8.0) for _ in range(2)]
                    costs[0][(keys & np.uint32(0xFF)) == END] = 0
                    if parts > 1:
                        for cost in costs:
                            cost[(keys >> np.uint32(8)) % parts != i] = 0
                    for k, v in enumerate([*base_measures(data, offsets), np.diff(offsets), *(shared.sums(cost, ends) for cost in costs)]):
                        got[k][rows] = v
                if i:
                    before = batch.column(batch.num_columns - 1)
                    got[6:] = [g + before.field(f).to_numpy() for g, f in zip(got[6:], ["bits", "whole_bits"])]
                struct = pa.StructArray.from_arrays([pa.array(g) for g in got], names=[f.split()[0] for f in MEASURES.split(", ")])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], struct], names=names)

        out = out.mapInArrow(run, kind)
        if parts > 1:
            out = shared.saved(out, "measured")
    return out


def _middle(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The upper median of ``value`` by language, rounded to ``_STEP``, from counts of the rounded values."""
    counts = rows.groupBy("lang", F.round(value / _STEP).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("v")  # rounded values of a language
    run = counts.withColumn("sum", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return run.filter(F.col("sum") * 2 > F.col("all")).groupBy("lang").agg((F.min("v") * _STEP).alias(name))


def whole_figure() -> Column:
    """Bits a symbol of a text, its end being one; null without text."""
    return F.when(F.col("n_bytes") > 0, F.col("whole_bits") / (F.col("n_bytes") + 1))


def bands(measured: DataFrame) -> DataFrame:
    """lang, middle, spread, byte_spread, from rows (lang, n_bytes, whole_bits) that aren't rejected already; languages without a byte have none."""
    rows = measured.filter("n_bytes > 0").select("lang", "n_bytes", whole_figure().alias("x"))
    rows = rows.join(shared.sent(shared.saved(_middle(rows, F.col("x"), "middle"), "band-middles")), "lang")
    off = F.abs(F.col("x") - F.col("middle")) * 1.4826
    spread = _middle(rows, off, "spread").join(_middle(rows, off * F.sqrt("n_bytes"), "byte_spread"), "lang")
    return rows.select("lang", "middle").distinct().join(spread, "lang")


def within(x: Column, n_bytes: Column) -> Column:
    """Whether the figure ``x`` is inside the band of the joined columns of ``bands``."""
    deviation = F.greatest(F.col("spread"), F.lit(LEAST_SPREAD), F.greatest(F.col("byte_spread"), F.lit(LEAST_BYTE_SPREAD)) / F.sqrt(n_bytes))
    return F.abs(x - F.col("middle")) <= WIDTH * deviation


def judge(docs: DataFrame, ids: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns ``ids`` of ``docs`` and, for each row, the base measures, ``base_failed``, ``kept``, ``bits_per_byte`` and
    ``whole_bits_per_symbol`` (both null without text).

    Fewer than ``LEAST_WORDS`` words, or over half of them in repeated windows of three, fail the base rules; what these
    leave sets the bands of ``whole_bits_per_symbol`` and is kept if inside. Null and empty texts fail. Copies are judged one by one, and alike. ``ids`` may
    not be named as what's added.
    """
    rows = docs.select(F.struct(*ids).alias("ids"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), shared.text_or_empty(docs, text).alias("text"))
    model = shared.saved(estimate(count_grams(rows)), "model")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = shared.saved(measure(rows, model).select("ids", "lang", "quality.*").withColumn("base_failed", failed), "quality")
    band = shared.sent(shared.saved(bands(found.filter("not base_failed")), "bands"))
    x = F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes"))
    kept = ~F.col("base_failed") & F.coalesce(within(whole_figure(), F.col("n_bytes")), F.lit(False))
    return found.join(band, "lang", "left").select("ids.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), x.alias("bits_per_byte"), whole_figure().alias("whole_bits_per_symbol"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` on all documents: doc_id, base measures, base_failed, kept, bits_per_byte, whole_bits_per_symbol. Null texts have no words and fail."""
    return judge(shared.read(spark, sf_dir, "documents"), ["doc_id"])
