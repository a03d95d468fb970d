"""Draws from corpora with replacement: a stated number from each, or by their masses, without a job for each corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scoring


def _parted(df: DataFrame, names: list[str], source: str, id_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the corpora with their digest and its prefix (``_digest``, ``_part``); the parts' sizes (``_of``, ``_part``, ``_many``), which are stored; and the corpora's: ``_of``, ``_n``."""
    rows = df.filter(F.col(source).isin(names)).withColumn("_digest", F.sha2(F.concat_ws(":", F.col(source), F.col(id_column).cast("string")), 256)).withColumn("_part", F.substring("_digest", 1, 3))
    parts = scratch.stored(rows.groupBy(F.col(source).alias("_of"), "_part").agg(F.count(F.lit(1)).alias("_many")), "parts")
    return rows, parts, parts.groupBy("_of").agg(F.sum("_many").alias("_n"))


def _taken(rows: DataFrame, parts: DataFrame, picks: DataFrame, source: str, id_column: str) -> DataFrame:
    """``rows`` of ``picks`` (``_from``, ``_at`` and other columns): row ``_at``, from 0, of the corpus ``_from`` in digest order.

    The part of a place follows from the parts' sizes, so only rows of parts that a pick falls on are numbered, and no others are moved or stored.
    """
    before = lambda by, at: F.coalesce(F.sum("_many").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.substring("_part", 1, 2)
    heads = parts.groupBy("_of", head.alias("_head")).agg(F.sum("_many").alias("_many"))
    heads = heads.select(F.col("_of").alias("_from"), "_head", before(["_of"], "_head").alias("_start"), F.col("_many").alias("_in_head"))
    found = picks.join(F.broadcast(heads), "_from").filter((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_in_head")))  # at most 256 rows a corpus
    found = found.withColumn("_at", F.col("_at") - F.col("_start")).drop("_start", "_in_head")
    inner = parts.withColumn("_head", head)
    inner = inner.select(F.col("_of").alias("_from"), "_head", "_part", before(["_of", "_head"], "_part").alias("_start"), "_many")
    found = found.join(F.broadcast(inner), ["_from", "_head"]).filter((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_many")))  # at most 4096 rows a corpus
    found = found.withColumn("_place", F.col("_at") - F.col("_start")).drop("_at", "_head", "_start", "_many").withColumnRenamed("_part", "_in")
    drawn = F.broadcast(found.select("_from", "_in").distinct())  # at most 4096 rows a corpus
    met = rows.join(drawn, (F.col(source) == F.col("_from")) & (F.col("_part") == F.col("_in")), "left_semi")
    place = F.row_number().over(Window.partitionBy(source, "_part").orderBy("_digest", id_column)) - 1
    return met.withColumn("_nth", place).join(found, (F.col(source) == F.col("_from")) & (F.col("_part") == F.col("_in")) & (F.col("_nth") == F.col("_place")))


def _modulo(text: Column, n: Column) -> Column:
    return (scoring.u64_of(text) % n.cast("decimal(20,0)")).cast("long")


def weighted_sample(df: DataFrame, draws: dict[str, int], seed: int, source: str = "source", id_column: str = "item_id") -> DataFrame:
    """A stated number of draws with replacement per corpus, uniform within it: rows with ``times`` drawn.

    Draw k of a corpus of n rows takes row u64(seed:source:k) mod n of the corpus in digest order. A corpus without rows gives none.
    """
    wanted = {k: int(n) for k, n in draws.items() if n > 0}
    rows, parts, sizes = _parted(df, list(wanted), source, id_column)
    upto, edges = 0, []
    for name, n in wanted.items():
        edges.append((name, upto, upto + n))
        upto += n
    named = F.coalesce(*(F.when(F.col("id") < end, F.lit(name)) for name, _, end in edges), F.lit(None).cast("string"))
    first = F.coalesce(*(F.when(F.col("id") < end, F.lit(start)) for _, start, end in edges), F.lit(0))
    picks = df.sparkSession.range(upto).select(named.alias("_from"), (F.col("id") - first).cast("string").alias("_k"))
    picks = picks.join(sizes, F.col("_from") == F.col("_of")).select("_from", _modulo(F.concat(F.lit(f"{seed}:"), "_from", F.lit(":"), "_k"), F.col("_n")).alias("_at"))
    times = picks.groupBy("_from", "_at").agg(F.count(F.lit(1)).alias("times"))
    return _taken(rows, parts, times, source, id_column).select(*df.columns, "times")


def sample_by_mass(df: DataFrame, masses: dict[str, float], samples: int, seed: int, epoch: int = 0, replicas: int = 1, rank: int | None = None, source: str = "source", id_column: str = "item_id") -> DataFrame:
    """``samples`` draws with replacement over corpora of the given masses, uniform within each: a row for each draw, with ``draw``, its number.

    ``samples`` is rounded up to a multiple of ``replicas``; with ``rank`` only draws ``rank``, ``rank + replicas``, ... come back, so that the ranks' draws
    make up the whole. Draw k falls on the corpus in whose share of the (non-empty) corpora's mass u64("mass:seed:epoch:k") / 2**64 lies, by name, and
    on row u64("row:seed:epoch:k") mod n of it in digest order: a multinomial sample whose sum is exact, the same on any cluster.
    """
    kept = {k: float(m) for k, m in masses.items() if m > 0}
    if not kept or samples < 1 or replicas < 1 or not (rank is None or 0 <= rank < replicas):
        raise ValueError("a positive mass, draws and a rank below the replicas are needed")
    rows, parts, sizes = _parted(df, list(kept), source, id_column)
    mass = F.create_map(*[F.lit(x) for kv in sorted(kept.items()) for x in kv])[F.col("_of")]
    upto = F.sum("_m").over(Window.orderBy("_of"))  # a row for each corpus of ``masses``
    shares = sizes.withColumn("_m", mass).select("_of", "_n", (upto / F.sum("_m").over(Window.partitionBy())).alias("_upto"))
    table = shares.agg(F.array_sort(F.collect_list(F.struct("_upto", "_of", "_n"))).alias("_shares"))
    draws = df.sparkSession.range(rank or 0, math.ceil(samples / replicas) * replicas, 1 if rank is None else replicas).select(F.col("id").alias("draw"))
    at = lambda what: F.concat(F.lit(f"{what}:{seed}:{epoch}:"), F.col("draw").cast("string"))
    share = scoring.u64_of(at("mass")).cast("double") / float(1 << 64)
    fallen = draws.crossJoin(F.broadcast(table)).withColumn("_x", F.coalesce(F.get(F.filter("_shares", lambda s: s["_upto"] > share), F.lit(0)), F.element_at("_shares", -1)))  # one row
    picks = fallen.select("draw", F.col("_x._of").alias("_from"), _modulo(at("row"), F.col("_x._n")).alias("_at"))
    return _taken(rows, parts, picks, source, id_column).select(*df.columns, "draw")
