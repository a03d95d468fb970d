"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token's inputs come from its word and its characters: learned evidence of the word, of its first
bytes, and of its byte 4-grams (strongest and mean). The network reads windows of ``WINDOW`` words that
overlap by half; the last window ends with the text. A document's score is that of its highest window,
so documents of any length are scored whole. An empty text has one window without words.

Training takes labelled rows whose crc32(doc_id as text) mod 3 is not 1, at most ``SAMPLE_TOXIC`` and
``SAMPLE_CLEAN`` of the two labels (those of least hash). Evidence is the shrunk log-ratio of document
frequencies; while the network is trained, each half of the sample takes its evidence from the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW, STEP = 32, 16
HIDDEN, ATTEND, INPUTS = 8, 8, 6
BUCKETS = 1 << 18
SHRINK = 3
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 2_500
REJECT = 0.7
_MASK = np.uint64(BUCKETS - 1)


class Tokens:
    """Distinct words of a run of documents: word of each place, buckets of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = shared.LOWER[data]
        start, end, self.first = shared.words(data, offsets, shared.ALNUM)
        prefix = shared.prefix_hash(low)
        h = shared.span_hash(prefix, start, end)
        distinct, at, self.word = np.unique(h, return_index=True, return_inverse=True)
        start, end = start[at], end[at]
        self.length = end - start
        self.words = (distinct & _MASK).astype(np.int32)
        self.word = self.word.astype(np.int32)
        bucket = lambda a, b, salt: (shared.mix(shared.span_hash(prefix, a, b) + np.uint64(salt)) & _MASK).astype(np.int32)
        self.heads = [bucket(start, np.minimum(start + n, end), n) for n in (4, 6)]
        n = np.maximum(self.length - 3, 1)
        self.gram_at = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(self.gram_at[-1]) - np.repeat(self.gram_at[:-1] - start, n)
        self.grams = bucket(place, np.minimum(place + 4, np.repeat(end, n)), 9)

    def slim(self) -> Tokens:
        """Owned arrays alone: a view would keep the larger array that it was cut from."""
        self.grams, self.gram_at = self.grams.copy(), self.gram_at.astype(np.int32)
        return self

    def kinds(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each evidence table: the buckets, and the word that each belongs to."""
        own = np.arange(len(self.words))
        return [(self.words, own), *((h, own) for h in self.heads), (self.grams, np.repeat(own, np.diff(self.gram_at)))]

    def inputs(self, tables: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(self.words), INPUTS), np.float32)
        if len(out):
            out[:, 0] = tables[0][self.words]
            out[:, 1] = tables[1][self.heads[0]]
            out[:, 2] = tables[2][self.heads[1]]
            gram = tables[3][self.grams]
            out[:, 3] = np.maximum.reduceat(gram, self.gram_at[:-1])
            out[:, 4] = np.add.reduceat(gram, self.gram_at[:-1]) / np.diff(self.gram_at)
            out[:, 5] = np.minimum(self.length, 20) / 20
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each window (-1: none), and the first window of each document."""
        n = np.diff(self.first)
        many = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STEP) + 1)
        at = np.concatenate([[0], np.cumsum(many)])
        doc = np.repeat(np.arange(len(n)), many)
        start = np.minimum((np.arange(at[-1]) - at[doc]) * STEP, np.maximum(n[doc] - WINDOW, 0))
        place = start[:, None] + np.arange(WINDOW)
        inside = place < n[doc][:, None]
        place = np.where(inside, place + self.first[:-1][doc][:, None], 0)
        return np.where(inside, self.word[place] if len(self.word) else 0, -1).astype(np.int32), at


def evidence(tokens: list[Tokens], labels: np.ndarray) -> list[np.ndarray]:
    """Tables of shrunk log-ratios of document frequencies in toxic and clean documents (one ``Tokens`` per document)."""
    seen = np.zeros((4, 2, BUCKETS), np.float32)
    for t, y in zip(tokens, labels):
        for k, (buckets, _) in enumerate(t.kinds()):
            seen[k, y, np.unique(buckets)] += 1
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    both = seen.sum(1)
    ratio = np.log((seen[:, 1] + 0.5) / (n[1] + 1)) - np.log((seen[:, 0] + 0.5) / (n[0] + 1))
    return list((ratio * both / (both + SHRINK)).astype(np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _used(table: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``table`` that ``windows`` name, and the windows by these rows."""
    used, small = np.unique(windows, return_inverse=True)
    small = small.reshape(-1, WINDOW).astype(np.int32)
    return (table[used[1:]], small - 1) if len(used) and used[0] < 0 else (table[used], small)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"v": draw(ATTEND), "A": draw(2 * HIDDEN, ATTEND), "o": draw(2 * HIDDEN), "c": np.float32([-1.0])}
        for d in "fb":
            self.p |= {f"W{d}": draw(INPUTS, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def forward(self, table: np.ndarray, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window; ``table`` has the inputs of each word."""
        p, n = self.p, len(windows)
        inside = windows >= 0
        states = np.zeros((n, WINDOW, 2 * HIDDEN), np.float32)
        H = HIDDEN
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            given = table @ p[f"W{d}"] + p[f"b{d}"] if len(table) else np.zeros((1, 3 * H), np.float32)
            U, h = p[f"U{d}"], np.zeros((n, H), np.float32)
            side = slice(0, H) if d == "f" else slice(H, 2 * H)
            for t in order:
                x = given[windows[:, t]]
                u = h @ U
                gate = _sigmoid(x[:, : 2 * H] + u[:, : 2 * H])
                z, r = gate[:, :H], gate[:, H:]
                new = np.tanh(x[:, 2 * H :] + r * u[:, 2 * H :])
                m = inside[:, t, None]
                if keep is not None:
                    keep.append((d, t, h, z, r, new, u[:, 2 * H :], m))
                h = np.where(m, new + z * (h - new), h)
                states[:, t, side] = h
        a = np.tanh(states @ p["A"])
        e = np.where(inside, a @ p["v"], -1e9)
        w = np.exp(e - e.max(1, keepdims=True)) * inside
        w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", w, states)
        if keep is not None:
            keep.append((states, a, w, pooled))
        return pooled @ p["o"] + p["c"][0]

    def gradient(self, table: np.ndarray, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        table, windows = _used(table, windows)
        keep: list = []
        logit = self.forward(table, windows, keep)
        p, H = self.p, HIDDEN
        states, a, w, pooled = keep.pop()
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = weight * (_sigmoid(logit) - target)
        g["c"][0] = dl.sum()
        g["o"] = pooled.T @ dl
        dp = dl[:, None] * p["o"]
        ds = w[:, :, None] * dp[:, None, :]
        dw = np.einsum("nth,nh->nt", states, dp)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", de, a)
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = np.einsum("nth,nta->ha", states, da)
        ds += da @ p["A"].T
        dh = {"f": np.zeros((len(windows), H), np.float32), "b": np.zeros((len(windows), H), np.float32)}
        for d, t, h, z, r, new, un, m in reversed(keep):
            side = slice(0, H) if d == "f" else slice(H, 2 * H)
            up = dh[d] + ds[:, t, side]
            own = up * m
            dn = own * (1 - z) * (1 - new * new)
            dz = own * (h - new) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], 1)
            dx = np.concatenate([dz, dr, dn], 1)
            g[f"U{d}"] += h.T @ du
            x = np.where(m, table[windows[:, t]], 0)
            g[f"W{d}"] += x.T @ dx
            g[f"b{d}"] += dx.sum(0)
            dh[d] = np.where(m, own * z, up) + du @ p[f"U{d}"].T
        return g


class Model:
    """Evidence tables and the network; a few megabytes, whatever the corpus."""

    def __init__(self, tables: list[np.ndarray], network: Network):
        self.tables, self.network = tables, network

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        tokens = Tokens(data, offsets)
        windows, at = tokens.windows()
        table = tokens.inputs(self.tables)
        logit = np.concatenate([self.network.forward(table, windows[i : i + 4096]) for i in range(0, len(windows), 4096)])
        return _sigmoid(np.maximum.reduceat(logit, at[:-1]).astype(float))


def fit(texts: list[str], labels: np.ndarray, epochs: int = 24) -> Model:
    """Without rows of both labels the network stays as it began, with a low score for all."""
    order = np.random.default_rng(3).permutation(len(texts))
    tokens, labels = [Tokens(*shared.buffers(pa.array([texts[i]]))).slim() for i in order], np.asarray(labels, int)[order]
    network = Network()
    tables = evidence(tokens, labels)
    if not 0 < labels.sum() < len(labels):
        network.p["c"][0] = -4.0
        network.p["o"] *= 0
        return Model(tables, network)
    half = np.arange(len(tokens)) % 2
    parts = []
    for k in (0, 1):
        other = evidence([t for t, b in zip(tokens, half) if b != k], labels[half != k])
        parts += [(i, tokens[i].inputs(other), tokens[i].windows()[0]) for i in np.flatnonzero(half == k)]
    del tokens
    place, rows, at = 0, [], [0]
    inputs = []
    for _, x, w in parts:
        rows.append(np.where(w >= 0, w + place, -1).astype(np.int32))
        inputs.append(x)
        place += len(x)
        at.append(at[-1] + len(w))
    y = labels[[i for i, _, _ in parts]].astype(np.float32)
    table, windows, at = np.concatenate(inputs), np.concatenate(rows).astype(np.int32), np.array(at)
    del parts, inputs, rows
    best = table[:, :5].max(1) if len(table) else np.zeros(1, np.float32)
    rise = np.where(windows >= 0, best[windows], -9).max(1)  # the first guess of each document's window
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32) ** 0.5
    first, second = {k: np.zeros_like(v) for k, v in network.p.items()}, {k: np.zeros_like(v) for k, v in network.p.items()}
    rng, step = np.random.default_rng(5), 0
    for epoch in range(epochs):
        if epoch and epoch % 6 == 0:
            rise = np.concatenate([network.forward(*_used(table, windows[i : i + 2048])) for i in range(0, len(windows), 2048)])
        top = np.array([a + int(rise[a:b].argmax()) for a, b in zip(at[:-1], at[1:])])
        loose = at[:-1] + (rng.random(len(y)) * np.diff(at)).astype(int)
        clean = y == 0
        chosen, target, each = np.concatenate([top, loose[clean]]), np.concatenate([y, y[clean]]), np.concatenate([weight, weight[clean] * 0.5])
        for pick in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 128)):
            step += 1
            g = network.gradient(table, windows[chosen[pick]], target[pick], each[pick] / len(pick))
            rate = 0.02 * (0.1 + 0.9 * (1 - epoch / epochs))
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                network.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(tables, network)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Labels with a null id or label, and texts that are null, are left out of the sample; contradicting labels all count.

    Ids that repeat give no more than ``toxic + clean`` rows in all.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.filter("label = 1").orderBy(*order).limit(toxic).unionAll(known.filter("label = 0").orderBy(*order).limit(clean))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(sample), "doc_id").select("text", "label").orderBy(F.xxhash64("text"), "label").limit(toxic + clean).collect()
    texts, marks = [r.text for r in rows], np.array([r.label for r in rows], int)
    del rows
    model = fit(texts, marks)
    del texts
    shared.give_back()
    return model


def score(docs: DataFrame, model: Model, column: str = "text", output: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and ``output`` (0 to 1), which replaces a column of that name. Null texts count as empty; repeated rows are scored alike."""
    spark = docs.sparkSession
    shared.tune(spark)
    sent = spark.sparkContext.broadcast(model)
    rest = docs.drop(output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = shared.buffers(batch.column(column))
            out = [sent.value.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in shared.chunks(offsets, 1_000_000)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*batch.schema.names, output])

    return rest.mapInArrow(run, shared.schema_with(rest, (output, "double")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted. Null texts are scored as empty ones, repeated rows alike; a null id isn't held out."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, shared.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= REJECT).cast("int").alias("predicted"))
