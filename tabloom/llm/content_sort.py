"""Exact duplicates by sorting content.

Sampled splitters deal the rows into ranges of (first characters, digest, id), each range is
sorted by Spark's external sort on the whole normalised text, and every text is compared in full
with its neighbour. Ids take part in the splitters, so that a group of copies of any size is
spread over as many ranges as it needs; groups that cross a range are joined up at the borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import documents, partitions, written

#: Characters of the text in the splitters. The order goes on with the digest and then the id.
SPLITTER_CHARS = 32

_MARKS = "kind int, part int, run long, first boolean, doc_id long, text_sha256 string, edge string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts of a sorted range; its first and last text come along."""
    schema = pa.schema(
        [("kind", pa.int32()), ("part", pa.int32()), ("run", pa.int64()), ("first", pa.bool_())]
        + [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("edge", pa.string())]
    )
    part, run, last = TaskContext.get().partitionId(), -1, None
    for batch in batches:
        texts, runs, firsts = batch.column("norm").to_pylist(), [], []
        head = [(1, part, 0, False, None, None, texts[0])] if last is None and texts else []
        for text in texts:
            new = text != last
            run += new
            last = text
            runs.append(run)
            firsts.append(new)
        n = len(texts)
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(head[0], schema)], schema=schema)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64())]
            + [pa.array(firsts, pa.bool_()), batch.column("doc_id").cast(pa.int64())]
            + [batch.column("text_sha256").cast(pa.string()), pa.nulls(n, pa.string())],
            schema=schema,
        )
    if last is not None:
        tail = (2, part, run, False, None, None, last)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(tail, schema)], schema=schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space. A null
    text counts as empty; empty texts form a group like any other. Of a group the row with the
    smallest id stays; a null id sorts last and stays only if all ids of its group are null. Of
    repeated rows with the same id and text, one is marked as kept. An empty table gives an empty
    result, and other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm")
    )
    rows = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)).withColumn(
        "head", F.substring("norm", 1, SPLITTER_CHARS)
    )
    by_id = F.col("doc_id").asc_nulls_last()
    ordered = rows.repartitionByRange(partitions(spark), "head", "text_sha256", by_id).sortWithinPartitions(
        "head", "text_sha256", "norm", by_id
    )
    marks = written(ordered.select("doc_id", "text_sha256", "norm").mapInArrow(_neighbours, _MARKS), "content-sort")
    members = marks.filter("kind = 0")
    runs = members.groupBy("part", "run").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    joined = _borders(marks)  # at most one row per range
    start = F.col("run") == 0
    runs = runs.join(F.broadcast(joined), "part", "left").select(
        "part",
        "run",
        "least",
        "size",
        F.when(start, F.col("from_part")).alias("from_part"),
        F.when(start, F.col("from_run")).alias("from_run"),
    )
    runs = runs.withColumn("home_part", F.coalesce("from_part", "part")).withColumn(
        "home_run", F.coalesce("from_run", "run")
    )
    whole = Window.partitionBy("home_part", "home_run")  # as many rows as ranges that a group covers
    runs = runs.select(
        "part",
        "run",
        F.col("from_part").isNull().alias("home"),
        F.min("least").over(whole).alias("keep_id"),
        F.sum("size").over(whole).alias("group_size"),
    )
    return members.join(runs, ["part", "run"]).select(
        "doc_id", "keep_id", "group_size", (F.col("first") & F.col("home")).alias("kept"), "text_sha256"
    )


def _borders(marks: DataFrame) -> DataFrame:
    """For ranges whose first run goes on from an earlier range: that run's home (part, run)."""
    first = marks.filter("kind = 1").select("part", F.col("edge").alias("first_text"))
    last = marks.filter("kind = 2").select(F.col("part").alias("before"), "run", F.col("edge").alias("last_text"))
    # a row per range, without texts, in one window
    line = Window.orderBy("part")
    follows = first.select("part").withColumn("before", F.lag("part").over(line))
    same = (
        follows.join(first, "part")
        .join(last, "before")
        .select("part", (F.col("first_text") == F.col("last_text")).alias("goes_on"))
    )
    table = (
        marks.filter("kind = 2").select("part", F.col("run").alias("last_run")).join(same, "part", "left")
    ).withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    begins = ~((F.col("last_run") == 0) & F.col("goes_on"))
    home = F.last(F.when(begins, F.struct("part", "last_run")), ignorenulls=True)
    table = table.withColumn("home", home.over(line.rowsBetween(Window.unboundedPreceding, -1)))
    return table.filter("goes_on").select(
        "part", F.col("home.part").alias("from_part"), F.col("home.last_run").alias("from_run")
    )
