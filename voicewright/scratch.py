"""Intermediate tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_base: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that isn't there yet. Without ``spark.checkpoint.dir`` a local session gets a temporary folder of its own; a cluster has none."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_base.get(app)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_base[app] = tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written once and read back: later branches share one pass over its inputs, and lost executors lose nothing of it.

    The shuffle files of the job that writes it are deleted when it ends, rather than when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str = "rows") -> DataFrame:
    """``stored`` of what ``make`` gives; the tables that were stored on the way are deleted, as nothing else reads them."""
    known = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(known)
    df = make()
    mine = known[before:]
    out = stored(df, name)
    for path in mine:
        known.remove(path)
    _delete(spark, mine)
    return out


def drop(spark: SparkSession) -> None:
    """Delete all tables of ``stored`` in this application. Results that aren't written or collected yet can't be read any more."""
    _delete(spark, _written.pop(spark.sparkContext.applicationId, []))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        p = fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
