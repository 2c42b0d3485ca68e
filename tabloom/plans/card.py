"""A compact JSON description of a table, as context for a reader or a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.profile import describe, value_counts
from tabloom.types import Roles, col, is_number, numeric_columns

TOP_VALUES = 5
SAMPLE_ROWS = 5


def top_values(df: DataFrame, cols: list[str], k: int = TOP_VALUES) -> DataFrame:
    """``column, rank, value, n``: the k most frequent values of each column."""
    rank = Window.partitionBy("i").orderBy(F.desc("n"), "v")
    names = F.array(*[F.lit(c) for c in cols])
    return (
        value_counts(df, cols)
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select(
            F.element_at(names, F.col("i") + 1).alias("column"), "rank", F.col("v").alias("value"), "n"
        )
    )


def dataset_card(df: DataFrame, roles: Roles, task: str, key: str) -> DataFrame:
    """One row, column ``card``: task, features, target, row count, number statistics, most
    frequent categories and the first rows in key order."""
    features = [c for c in roles.features if c in df.columns]
    labels = [c for c in roles.labels if c in df.columns]
    chosen = df.select(*[col(c) for c in features])
    numeric = numeric_columns(chosen)
    categories = [c for c in features if not is_number(df.schema[c].dataType)]

    def listed(rows: DataFrame, order: list[str], take: str = "all"):
        # bounded: one entry per column, k per column, or SAMPLE_ROWS
        entry = F.struct(*[col(c) for c in [*order, *[c for c in rows.columns if c not in order]]])
        return rows.agg(F.sort_array(F.collect_list(entry)).alias("all")).select(take).scalar()

    first = df.orderBy(col(key)).limit(SAMPLE_ROWS)
    sample = first.select(
        col(key).alias("_key"), F.struct(*[col(c) for c in [*features, *labels]]).alias("row")
    )
    parts = [
        F.lit(task).alias("task"),
        F.lit(features).alias("features"),
        F.lit(labels).cast("array<string>").alias("target"),
        df.agg(F.count("*")).scalar().alias("rows"),
    ]
    if numeric:
        parts.append(listed(describe(chosen, numeric), ["column"]).alias("numeric"))
    if categories:
        parts.append(listed(top_values(chosen, categories), ["column", "rank"]).alias("categories"))
    parts.append(listed(sample, ["_key"], "all.row").alias("sample"))
    one = df.sparkSession.range(1)
    return one.select(F.to_json(F.struct(*parts)).alias("card"))
