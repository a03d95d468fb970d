"""JSON-lines manifests, shard lists and published folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_manifest(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file. Blank lines are skipped. A line that isn't an object of the schema raises when
    ``strict``, and is left out otherwise. Fields that a line lacks are null."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_present(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``read_manifest`` with ``present``, the names that each line has, so that a null can be told from a field that isn't there. Lines that aren't objects raise when read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = F.from_json("value", StructType.fromDDL(schema), {"mode": "FAILFAST"})
    names = F.when(F.col("value").rlike(r"^\s*\{"), F.json_object_keys("value")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))))
    return lines.select(row.alias("_row"), names.alias("present")).select("_row.*", "present")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file and line text of what ``read_manifest`` would reject."""
    kind = StructType.fromDDL(schema).add("_corrupt_record", "string")
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.filter("row is null or row._corrupt_record is not null").select("file", "value")


def read_shard_list(spark: SparkSession, path: str) -> DataFrame:
    """audio, labels, count, seconds of each shard; ``#`` starts a comment. A row of fewer than two fields raises when read."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(parts.alias("p"))
    need = F.when(F.size("p") < 2, F.raise_error(F.concat(F.lit("shard list row needs audio and labels: "), F.array_join("p", " ")))).otherwise(F.col("p"))
    get = lambda i: F.try_element_at(F.col("p"), F.lit(i))
    return lines.select(need.alias("p")).select(get(1).alias("audio"), get(2).alias("labels"), get(3).try_cast("long").alias("count"), get(4).try_cast("double").alias("seconds"))


#: Fields of a test list; all but the first two may be missing.
TEST_LIST = "id string, text string, ref_audio string, ref_text string, language_id string, language_name string, duration double, speed double, instruct string"


def read_manifest_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a test list; lines that aren't JSON objects are left out, fields that a line lacks are null."""
    return read_manifest(spark, path, TEST_LIST, strict=False)


def read_shard_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all label files that a shard list names, with ``labels``, the file. Relative names are resolved against the list's folder."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    resolved = F.when(F.col("labels").rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), F.col("labels")).otherwise(F.concat(F.lit(folder + "/"), "labels"))
    files = [r[0] for r in read_shard_list(spark, path).select(resolved).distinct().collect()]  # names of shards
    if not files:
        return spark.createDataFrame([], StructType.fromDDL(schema).add("labels", "string"))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(files).withColumn("labels", F.input_file_name())


def first_present(df: DataFrame, names: list[str]) -> Column:
    """First non-null, non-empty value of the columns of ``names`` that the frame has."""
    found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


#: Accepted names of a record's fields, in order of preference.
ALIASES = {
    "audio_path": ["audio_path", "wav_path", "audio", "path"],
    "text": ["spoken_text", "text", "final_text", "transcript", "sentence"],
    "speaker_id": ["local_speaker_id", "speaker_id", "speaker", "spk_id", "voice"],
    "id": ["id", "utt_id", "audio_id", "key"],
    "duration": ["audio_duration", "duration", "duration_sec", "alignment_audio_duration_sec"],
}


def normalize_record(df: DataFrame) -> DataFrame:
    """Columns of the fixed names (texts trimmed, duration a number), and ``reason``, the first of audio, text and speaker that is missing."""
    blank = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    found = {k: first_present(df, names) for k, names in ALIASES.items()}
    fixed = [blank(found[k]).alias(k) for k in ("audio_path", "text", "speaker_id")] + [found["id"].alias("id"), found["duration"].try_cast("double").alias("duration")]
    out = df.select(*fixed, *(F.col(c) for c in df.columns if c not in ALIASES))
    return out.withColumn("reason", F.coalesce(*(F.when(F.col(c).isNull(), f"missing_{c}") for c in ("audio_path", "text", "speaker_id"))))


def check_weight_conflict(df: DataFrame, source_weight: float | None = None) -> DataFrame:
    """``loss_weight`` of each row, and ``weight_error`` where the row's own weight isn't the source's, or the weight isn't in (0, 1]."""
    own = F.coalesce(*(F.col(c).cast("double") for c in ("pseudo_label_weight", "loss_weight") if c in df.columns), F.lit(None).cast("double"))
    weight = F.lit(float(source_weight)) if source_weight is not None else F.coalesce(own, F.lit(1.0))
    conflict = (F.abs(own - F.lit(source_weight)) > 1e-12) if source_weight is not None else F.lit(False)
    wrong = F.isnan(weight) | (weight <= 0) | (weight > 1)
    return df.withColumn("weight_error", F.when(conflict, "source_weight_conflict").when(wrong, "weight_out_of_range")).withColumn("loss_weight", weight)


def filter_source_records(df: DataFrame, languages: list[str] | None = None, split: str | None = None, min_duration: float = 0.4, max_duration: float = 20.0, unique: str | None = None, source: str | None = None) -> DataFrame:
    """Rows of the languages and the split whose duration is in bounds or unknown. Rows without a language are ``my``, without a split ``train``.

    ``unique``: the id column, which raises when it's read where an id is there twice among the rows that stay (of its ``source``).
    """
    have = lambda names, default: F.coalesce(*(F.col(c) for c in names if c in df.columns), F.lit(default))
    rows = df.filter(F.col("duration").isNull() | F.col("duration").between(min_duration, max_duration))
    if languages:
        rows = rows.filter(have(("language_id", "lang"), "my").isin(*languages))
    if split:
        rows = rows.filter(have(("split",), "train") == split)
    if not unique:
        return rows
    n = F.count(F.lit(1)).over(Window.partitionBy(*([source] if source else []), unique))
    told = F.concat(F.lit("duplicate record id: "), F.coalesce(F.col(unique).cast("string"), F.lit("null")))
    return rows.withColumn(unique, F.when(n > 1, F.raise_error(told).cast(rows.schema[unique].dataType)).otherwise(F.col(unique)))


def require_sources(df: DataFrame, names: list[str], source: str = "source") -> dict[str, int]:
    """Eligible rows of each source of ``names``; raises where one has none, or if there are no names. One row a source comes to the driver."""
    found = {r[0]: r[1] for r in df.filter(F.col(source).isin(*names)).groupBy(source).count().collect()} if names else {}
    empty = [n for n in names if not found.get(n)]
    if empty or not names:
        raise ValueError(f"no eligible records: {', '.join(empty) or 'no sources'}")
    return found


def unwrap_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Fields of the struct ``label`` in place of the row's own ones; rows without it keep theirs."""
    if label not in df.columns:
        return df
    inner = [f.name for f in df.schema[label].dataType.fields]
    within = F.col(label).isNotNull()
    pick = {n: F.when(within, F.col(f"{label}.`{n}`")).otherwise(F.col(n)) if n in df.columns else F.col(f"{label}.`{n}`") for n in inner}
    return df.select(*(pick[c].alias(c) if c in pick else F.when(within, F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("text", "loss_weight", "pseudo_label_weight") else F.col(c) for c in df.columns if c != label), *(v.alias(k) for k, v in pick.items() if k not in df.columns))


def normalize_interval(df: DataFrame) -> DataFrame:
    """``start_ms``, ``end_ms`` (whole milliseconds, half to even) from start (seconds), start_ms or start_time, and ``interval_error``."""

    def bound(name: str) -> Column:
        cols = [F.col(name).cast("double") * 1000] * (name in df.columns) + [F.col(f"{name}_{k}").cast("double") for k in ("ms", "time") if f"{name}_{k}" in df.columns]
        return F.coalesce(*cols) if cols else F.lit(None).cast("double")

    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0)
    start, end = bound("start"), bound("end")
    error = F.when(start.isNull(), "start_missing").when(end.isNull(), "end_missing").when(bad(start) | bad(end), "bound_invalid").when(end <= start, "end_not_after_start")
    return df.withColumns({"start_ms": F.bround(F.when(error.isNull(), start)).cast("long"), "end_ms": F.bround(F.when(error.isNull(), end)).cast("long"), "interval_error": error})


def resolve_row_id(df: DataFrame) -> DataFrame:
    """``row_id`` from id, else target_id; raises when read where both differ or neither is there."""
    a, b = (F.nullif(F.col(c), F.lit("")) if c in df.columns else F.lit(None).cast("string") for c in ("id", "target_id"))
    key = F.coalesce(a, b)
    return df.withColumn("row_id", F.when(a.isNotNull() & b.isNotNull() & (a != b), F.raise_error(F.lit("id and target_id differ"))).when(key.isNull(), F.raise_error(F.lit("a row has no id"))).otherwise(key))


def locate_sidecar(recordings: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``sidecar`` path of each recording (video_id, name): the file named by its id, else by its stem; ``sidecar_error`` where there's none."""
    base = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    files = sidecars.select(F.col("path").alias("_path"), base(F.element_at(F.split("path", "/"), -1)).alias("_base")).groupBy("_base").agg(F.min("_path").alias("_path"))
    side = lambda k: files.select(F.col("_base").alias(f"_b{k}"), F.col("_path").alias(f"_p{k}"))
    out = recordings.join(side(1), F.col("video_id") == F.col("_b1"), "left").join(side(2), base(F.col("name")) == F.col("_b2"), "left")
    found = F.coalesce("_p1", "_p2")
    return out.select(*recordings.columns, found.alias("sidecar"), F.when(found.isNull(), "sidecar_missing").alias("sidecar_error"))


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row's fields: length and value of each, in the order of the names; null is told from empty."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", *(part(c) for c in sorted(columns))), 256)


def manifest_checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, checksum: of the table, whatever the order of its rows. Equal rows count each, so a copy more changes it."""
    h = row_hash(df, columns or df.columns)
    half = lambda k: F.sum(F.conv(F.substring(h, k, 15), 16, 10).cast("decimal(38,0)"))
    total = df.agg(F.count(F.lit(1)).alias("rows"), half(1).alias("a"), half(16).alias("b"), half(31).alias("c"), half(46).alias("d"))
    return total.select("rows", F.sha2(F.concat_ws(":", "rows", *(F.coalesce(F.col(k), F.lit(0)).cast("string") for k in "abcd")), 256).alias("checksum"))


def reconcile_published(expected: DataFrame, present: DataFrame, name: str = "name", digest: str = "sha256") -> DataFrame:
    """name and action for each file that should be or is in a published folder: add, keep, replace (other bytes) or delete."""
    a = expected.select(F.col(name).alias("_a"), F.col(digest).alias("_x"))
    b = present.select(F.col(name).alias("_b"), F.col(digest).alias("_y"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    action = F.when(F.col("_b").isNull(), "add").when(F.col("_a").isNull(), "delete").when(F.col("_x").eqNullSafe(F.col("_y")), "keep").otherwise("replace")
    return both.select(F.coalesce("_a", "_b").alias(name), action.alias("action"))


def merge_run_outputs(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    """Rows of the JSON manifests of several runs, with ``run`` (the number of the folder in the order given) so that the order can be told."""
    parts = [spark.read.schema(schema).option("mode", "FAILFAST").json(f).withColumn("run", F.lit(i)) for i, f in enumerate(folders)]
    if not parts:
        raise ValueError("no runs")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snapshot(spark: SparkSession, paths: list[str]) -> dict[str, tuple[int, str]]:
    """Rows and checksum of the lines of each input, whatever their order: what ``publish`` compares. One row a path comes to the driver."""
    out = {}
    for path in paths:
        told = manifest_checksum(spark.read.text(path)).first()
        out[path] = told.rows, told.checksum
    return out


def publish(tables: dict[str, DataFrame], path: str, inputs: list[str], required: str | None = None, before: dict[str, tuple[int, str]] | None = None) -> None:
    """Write ``tables`` as JSON lines to folders of their names in the new folder ``path``: all of them, or nothing.

    They're written to a folder beside it, which is renamed when all is done. Nothing is published, and the written folder goes, if writing fails, if the
    table ``required`` has no rows, or if the lines of the ``inputs`` are not as they were ``before`` (a ``snapshot``; by default when publishing begins).
    Raises where ``path`` is there already.
    """
    spark = next(iter(tables.values())).sparkSession
    fs_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at = fs_of.Path(path)
    fs = at.getFileSystem(conf)
    if fs.exists(at):
        raise FileExistsError(f"output directory already exists: {path}")
    before = before or snapshot(spark, inputs)
    staging = fs_of.Path(f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}")
    try:
        for name, df in tables.items():
            df.write.json(f"{staging}/{name}")
        if required and spark.read.text(f"{staging}/{required}").isEmpty():
            raise ValueError("no eligible training examples")
        if snapshot(spark, inputs) != before:
            raise ValueError("input changed during preparation")
        if fs.exists(at):
            raise FileExistsError(f"output directory already exists: {path}")
        fs.mkdirs(at.getParent())
        if not fs.rename(staging, at):
            raise OSError(f"can't be renamed to {path}")
    finally:
        fs.delete(staging, True)


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines in a new folder; raises where there's one already. Readers wait for its _SUCCESS."""
    df.write.mode("errorifexists").json(path)


def route_manifests(df: DataFrame, path: str, routes: Column) -> None:
    """One pass to a folder per route; ``routes`` is an array, as a row can have several."""
    df.withColumn("route", F.explode(routes)).write.mode("errorifexists").partitionBy("route").json(path)
