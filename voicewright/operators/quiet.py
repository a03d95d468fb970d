"""Cuts of long speech at quiet places.

Each cut depends on the one before, so the frames of a span are read in time order, with those of one search window alone
kept. Spans are independent of each other, and only the frames that lie in a span that's too long are moved.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import interval_join


@dataclass(frozen=True)
class Search:
    """Where the next cut may lie: bounds and target in milliseconds, the span that distances are measured by, and whether frames outside the bounds count."""

    lower: float
    upper: float
    target: float
    scale: float
    wide: bool


@dataclass(frozen=True)
class Pauses:
    """Cuts of speech segments: about every ``target_ms`` while more than ``most_ms`` is left."""

    target_ms: int = 12_000
    most_ms: int = 30_000
    search_ms: int = 2_000
    least_ms: int = 1_000

    def search(self, start: int, end: int, last: int, done: int) -> Search | None:
        if end - last <= self.most_ms:
            return None
        target = last + min(self.target_ms, self.most_ms)
        return Search(max(last + self.least_ms, target - self.search_ms), min(last + self.most_ms, end - self.least_ms, target + self.search_ms), target, max(self.search_ms, 1e-9), True)

    def settle(self, s: Search, found: float | None, start: int, end: int, last: int, done: int) -> float:
        at = found if found is not None else min(s.target, end - self.least_ms)
        return at if at > last else min(s.target, end)


@dataclass(frozen=True)
class Caps:
    """Cuts of clips into the least number of parts of up to ``most_ms``, each near its balanced place, bounded by what must remain on both sides."""

    most_ms: int = 15_000
    search_ms: int = 1_500
    least_ms: int = 1_000

    def _bounds(self, start: int, end: int, last: int, done: int) -> tuple[int, int, int]:
        n = max(1, math.ceil((end - start) / self.most_ms))
        left = n - done - 1
        low, high = max(last + self.least_ms, end - left * self.most_ms), min(last + self.most_ms, end - left * self.least_ms)
        return low, high, min(high, max(low, start + round((end - start) * (done + 1) / n)))

    def search(self, start: int, end: int, last: int, done: int) -> Search | None:
        if done + 1 >= max(1, math.ceil((end - start) / self.most_ms)):
            return None
        low, high, target = self._bounds(start, end, last, done)
        a, b = max(low, target - self.search_ms), min(high, target + self.search_ms)
        return Search(a, b, target, max(1.0, b - a), False)

    def settle(self, s: Search, found: float | None, start: int, end: int, last: int, done: int) -> float:
        low, high, target = self._bounds(start, end, last, done)
        return min(high, max(low, found if found is not None and s.upper > s.lower else target))


class Span:
    """One span that's being cut: frames go in by time, parts come out."""

    def __init__(self, rule: Pauses | Caps, start: int, end: int, pause_ms: float, penalty_db: float):
        self.rule, self.start, self.end, self.half, self.penalty = rule, start, end, pause_ms / 2, penalty_db
        self.at: list[int] = []
        self.power: list[float] = []
        self.cuts: list[int] = [start]
        self.parts: list[tuple[int, int, int, str]] = []
        self.next = rule.search(start, end, start, 0)

    def frame(self, at: int, db: float) -> None:
        while self.next and at > self.next.upper + (self.half if self.next.wide else 0):
            self.cut()
        self.at.append(at)
        self.power.append(10 ** (db / 10))

    def cut(self) -> None:
        s, last = self.next, self.cuts[-1]
        lo, hi = bisect_left(self.at, s.lower), bisect_right(self.at, s.upper)
        best = None
        for k in range(lo, hi):
            a, b = bisect_left(self.at, self.at[k] - self.half), bisect_right(self.at, self.at[k] + self.half)
            if not s.wide:
                a, b = max(a, lo), min(b, hi)
            level = 10 * math.log10(max(math.fsum(self.power[a:b]) / (b - a), 1e-12))
            far = abs(self.at[k] - s.target)
            way = (round(level + self.penalty * far / s.scale, 9), far, self.at[k])
            best = way if best is None or way < best else best
        done = len(self.cuts) - 1
        at = int(self.rule.settle(s, best[2] if best else None, self.start, self.end, last, done))
        self.parts.append((done, last, at, "sustained_pause" if best and at == best[2] else "by_time"))
        self.cuts.append(at)
        self.next = self.rule.search(self.start, self.end, at, done + 1)
        keep = bisect_left(self.at, at - self.half)
        del self.at[:keep], self.power[:keep]

    def finish(self) -> None:
        while self.next:
            self.cut()
        if self.end > self.cuts[-1] or len(self.cuts) == 1:
            self.parts.append((len(self.cuts) - 1, self.cuts[-1], self.end, ""))


def quiet_parts(spans: DataFrame, frames: DataFrame, rule: Pauses | Caps, pause_ms: float = 180, penalty_db: float = 1.5) -> DataFrame:
    """Parts of each span: span_id, part (from 0), start_ms, end_ms, method of the cut at its end (sustained_pause, by_time; empty for the last).

    ``spans``: span_id, video_id, start_ms, end_ms. ``frames``: video_id, at_ms, db (levels; a null one is left out). A place's level is the mean power within
    ``pause_ms``; ``penalty_db`` is added by the distance to the target. Equal places: the nearest to the target, then the first. Without
    frames cuts lie at their targets. A span of no length is one part.
    """
    kind = spans.schema["span_id"].dataType.simpleString()
    own = spans.select("span_id", "video_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))
    wide = own.filter(F.col("end_ms") > F.col("start_ms")).withColumns({"from": F.col("start_ms"), "to": F.col("end_ms"), "start_ms": F.col("start_ms") - int(pause_ms), "end_ms": F.col("end_ms") + int(pause_ms)})
    places = frames.filter("db is not null").select("video_id", F.col("at_ms").cast("long").alias("start_ms"), (F.col("at_ms").cast("long") + 1).alias("end_ms"), F.col("db").cast("double").alias("db"))
    inside = interval_join(wide, places).select(F.col("l_span_id").alias("span_id"), F.col("l_from").alias("start_ms"), F.col("l_to").alias("end_ms"), F.col("r_start_ms").alias("at_ms"), F.col("r_db").alias("db"))
    heads = own.select("span_id", "start_ms", "end_ms", F.lit(None).cast("long").alias("at_ms"), F.lit(None).cast("double").alias("db"))
    ordered = heads.unionByName(inside).repartition("span_id").sortWithinPartitions("span_id", F.col("at_ms").asc_nulls_first(), "db")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, span, rows = ["span_id", "part", "start_ms", "end_ms", "method"], None, None, []

        def out(kinds: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kinds, pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=names)

        kinds = pa.null()
        for batch in batches:
            kinds = batch.schema.field(0).type
            for i, start, end, at, db in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None:
                    if span is not None:
                        span.finish()
                        rows += [(now, *p) for p in span.parts]
                    now, span = i, Span(rule, start, end, pause_ms, penalty_db)
                else:
                    span.frame(at, db)
                    rows += [(now, *p) for p in span.parts]
                    span.parts = []
            if rows:
                yield out(kinds)
        if span is not None:
            span.finish()
            rows += [(now, *p) for p in span.parts]
            yield out(kinds)

    return ordered.mapInArrow(run, f"span_id {kind}, part long, start_ms long, end_ms long, method string")
