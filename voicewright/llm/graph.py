"""Connected components by alternating stars, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame) -> DataFrame:
    """``set_id``, ``comp`` (least vertex of its component) of every vertex of ``edges`` (u, v).

    Each round points every vertex's larger neighbours, then its smaller ones, at its least neighbour.
    Edges never grow in number; a round halves the depth of a chain or more. Rounds end when the edges
    stay the same. A hub's rows are joined with one row of its own, so no neighbourhood is gathered.
    """
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = shared.saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, is_now = None, state(now)
    while is_now[0] and is_now != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        pointed = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = shared.saved(pointed.filter("u <> v").distinct(), "edges")
        before, is_now = is_now, state(now)
    least = now.groupBy("u").agg(F.min("v").alias("comp"))
    tops = now.select(F.col("v").alias("set_id")).distinct().join(least.select(F.col("u").alias("set_id")), "set_id", "left_anti")
    return shared.saved(least.select(F.col("u").alias("set_id"), "comp").unionByName(tops.select("set_id", F.col("set_id").alias("comp"))), "components")
