"""Running aggregates over the rows of a key in order, without one task for each key.

A window by key puts a hot recording or pool in one task. Here the rows of a key are cut into slices by ``levels``: columns that
don't decrease along the order, coarse ones first. Windows run within a slice; the slices' own aggregates, one row each, are
carried on within the next coarser slice, and only those of the coarsest level within the key. All steps are grouping,
windows and joins on slices. Rows are stored first, so that both branches read them once, and are shuffled once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

#: Widths of time slices in milliseconds.
SLICES = (3_600_000, 60_000)

_AGGREGATE = {"max": F.max, "min": F.min, "sum": F.sum}
_COMBINE = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}


def time_levels(at: str | Column, slices: tuple[int, ...] = SLICES) -> list[Column]:
    at = F.col(at) if isinstance(at, str) else at
    return [F.floor(at / s) for s in slices]


def text_levels(column: str, lengths: tuple[int, ...] = (5, 7)) -> list[Column]:
    """Slices of ids in their order: by their first characters."""
    return [F.substring(F.col(column).cast("string"), 1, n) for n in lengths]


def running(df: DataFrame, keys: list[str], levels: list[Column], order: list[str | Column], values: dict[str, Column], how: str = "max", after: bool = False) -> DataFrame:
    """``df`` with, for each of ``values``, its aggregate (max, min or sum) over the rows before in the key's order (``after``: over those behind).

    Null where there's none. ``order`` must begin as the levels do, and should leave no ties between rows that differ. Null keys are a key.
    """
    return several(df, keys, levels, order, {name: (c, how, after) for name, c in values.items()})


def several(df: DataFrame, keys: list[str], levels: list[Column], order: list[str | Column], values: dict[str, tuple[Column, str, bool]]) -> DataFrame:
    """``running`` for values of several kinds, (column, how, after), in one pass."""
    n = len(levels)
    names = [f"_level{i}" for i in range(n)]
    rows = scratch.stored(df.withColumns(dict(zip(names, levels)) | {f"_own_{v}": c for v, (c, _, _) in values.items()}), "scan")
    frame = lambda after: (1, Window.unboundedFollowing) if after else (Window.unboundedPreceding, -1)
    agg = lambda v, c: _AGGREGATE[values[v][1]](c)
    both = lambda v, a, b: _COMBINE[values[v][1]](F.col(a), F.col(b))
    over = lambda v, c, by, at: agg(v, c).over(Window.partitionBy(*by).orderBy(*at).rowsBetween(*frame(values[v][2])))
    out = rows.withColumns({v: over(v, f"_own_{v}", [*keys, *names], order) for v in values})

    # One row for each slice of each level, with what the slices beside it in the next coarser one carry to it.
    parts = [rows.groupBy(*keys, *names).agg(*(agg(v, f"_own_{v}").alias(v) for v in values))]
    for i in range(n - 1, 0, -1):
        parts.append(parts[-1].groupBy(*keys, *names[:i]).agg(*(agg(v, v).alias(v) for v in values)))
    carried: DataFrame | None = None
    for i, part in enumerate(reversed(parts), 1):
        part = part.select(*keys, *names[:i], *(over(v, v, [*keys, *names[: i - 1]], [names[i - 1]]).alias(f"_to_{v}") for v in values))
        if carried is not None:
            part = _joined(part, carried.select(*keys, *names[: i - 1], *(F.col(f"_to_{v}").alias(f"_up_{v}") for v in values)), [*keys, *names[: i - 1]])
            part = part.select(*keys, *names[:i], *(both(v, f"_to_{v}", f"_up_{v}").alias(f"_to_{v}") for v in values))
        carried = part
    out = _joined(out, carried, [*keys, *names])
    return out.withColumns({v: both(v, v, f"_to_{v}") for v in values}).select(*df.columns, *values)


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` with those of ``right`` that are equal in ``on``, nulls too."""
    named = right.select(*(F.col(c).alias(f"_on_{i}") for i, c in enumerate(on)), *(c for c in right.columns if c not in on))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{i}")) for i, c in enumerate(on)])
    return left.join(named, same).drop(*(f"_on_{i}" for i in range(len(on))))


def neighbours(df: DataFrame, keys: list[str], levels: list[Column], order: list[str], before: list[str] = (), behind: list[str] = ()) -> DataFrame:
    """``df`` with ``prev_*`` of the columns ``before`` from the row before in the key's order, and ``next_*`` of ``behind`` from the one behind.

    The order must be of distinct places.
    """
    beside = lambda columns: F.struct(*order, *(F.col(c).alias(f"v_{c}") for c in columns))
    values = {"_prev": (beside(before), "max", False)} if before else {}
    values |= {"_next": (beside(behind), "min", True)} if behind else {}
    out = several(df, keys, levels, order, values)
    return out.withColumns({f"prev_{c}": F.col(f"_prev.v_{c}") for c in before} | {f"next_{c}": F.col(f"_next.v_{c}") for c in behind}).drop("_prev", "_next")


def ranked(df: DataFrame, keys: list[str], levels: list[Column], order: list[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with the number of rows before each in its key's order."""
    return running(df, keys, levels, order, {name: F.lit(1)}, "sum").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
