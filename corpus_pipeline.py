"""A corpus pipeline of five stages, each over all rows that the stage before it kept.

Every stage returns rows with the columns of ``documents``, but for the last, which adds the ids. A stage
is written to Parquet and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicewright.llm import bpe, decontaminate, jaccard_join, pii, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold. The model is fitted on the labelled rows of ``docs``."""
    model = toxicity.train(docs, shared.read(spark, sf_dir, "labels"))
    own = shared.fresh_name(docs, "toxic_score")
    return toxicity.score(docs, model, output=own).filter(F.col(own) < toxicity.REJECT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one of least id (then of least text digest; a null id is the least).

    Null and empty texts are linked with nothing, and stay. Of rows equal in id and text one stays.
    """
    key, k, t = (shared.fresh_name(docs, n) for n in ("row_key", "found_id", "found_text"))
    text_id = F.unhex(F.md5(shared.text_or_empty(docs).cast("binary")))
    rows = docs.withColumn(key, F.struct("doc_id", text_id.alias("text_id")))
    classes = jaccard_join.classes(rows.select(F.col(key).alias("id"), "text"), id_column="id")
    found = shared.saved(classes.select(F.col("doc_id").alias("key"), (F.col("component_id") != F.col("doc_id")).alias("linked")), "row-classes")
    of = lambda df: shared.sent(shared.saved(df.select("key.*").select(F.col("doc_id").alias(k), F.col("text_id").alias(t)), "row-keys"))
    same = [rows[key]["doc_id"].eqNullSafe(F.col(k)), rows[key]["text_id"] == F.col(t)]
    again = of(found.groupBy("key").count().filter("count > 1"))
    once = rows.join(of(found.filter("linked").distinct()), same, "left_anti")
    if again.isEmpty():
        return once.select(*docs.columns)
    twice = once.join(again, same, "left_semi").dropDuplicates([key])
    return once.join(again, same, "left_anti").select(*docs.columns).unionByName(twice.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item, whatever their ids."""
    own = shared.fresh_name(docs, "clean_row")
    flagged = decontaminate.flag(docs.withColumnRenamed("overlap", own), shared.read(spark, sf_dir, "benchmark"))
    return flagged.filter("overlap is null").drop("overlap").withColumnRenamed(own, "overlap").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids (``bpe_ids``)."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode_texts),
]

#: No stage can be expressed in SQL as a whole: the first is a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the rows that each keeps go to the next. Nulls and repeated rows are as the stages say."""
    docs = shared.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = shared.scratch_mark()
        docs = shared.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        shared.drop_scratch(spark, mark, keep=1)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
