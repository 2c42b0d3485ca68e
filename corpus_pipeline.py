"""From raw documents to a training mix: quality, exact copies, near copies, benchmark leaks, order.

Each stage reads what its predecessor kept, as Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import content_sort, decontaminate, jaccard, mixing, quality
from tabloom.llm.common import discard, partitions, scratch, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; empty and null texts score as empty ones.

    Without any labelled row to learn from nothing is rejected.
    """
    labels = _table(spark, sf_dir, "labels").filter(~quality.held_out())
    model = quality.train(docs, labels)
    return quality.keep_quality(docs, model) if model.rows else docs


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest id; rows that share it stay together.

    Decided row by row: a row whose id another row has goes only for its own text.
    """
    rows, unique = _rows(docs)
    found = content_sort.exact_duplicates(rows, id_col="_row")
    return _without(rows, unique, found.select(F.col("doc_id").alias("_gone"), F.col("keep_id").alias("_keep")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar five-word shingle sets (0.8 or more) the smallest id, row by row as well."""
    rows, unique = _rows(docs)
    groups = jaccard.similar_groups(rows, size=5, percent=80, id_col="_row")
    return _without(rows, unique, groups.select(F.col("doc_id").alias("_gone"), F.col("component_id").alias("_keep")))


def _rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` and ``_row``, which tells rows apart and rises with the id, null ids last; and whether it is the id itself."""
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("_row", F.col("doc_id")), True
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64(*docs.columns)]
    ordered = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(ordered.withColumn("_row", F.monotonically_increasing_id()), "rows"), False


def _without(rows: DataFrame, unique: bool, found: DataFrame) -> DataFrame:
    """Rows but those that another row stands for; rows without an id, or with that row's id, stay."""
    gone = found.filter("_gone != _keep")
    if not unique:
        ids = rows.select("_row", F.col("doc_id").alias("_id"))
        gone = gone.join(ids.withColumnRenamed("_row", "_gone"), "_gone").join(
            ids.select(F.col("_row").alias("_keep"), F.col("_id").alias("_keep_id")), "_keep"
        )
        gone = gone.filter("_id != _keep_id")
    return rows.join(gone.select("_gone"), rows["_row"] == F.col("_gone"), "left_anti").drop("_row")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of sources."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", one_of_equals),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", no_benchmark),
    ("source_mixing", mixed),
]

#: SQL can't express the classifier, the edit matching and the schedule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(docs._scratch)
        discard(before)  # what the stage before kept has been read
    return docs
