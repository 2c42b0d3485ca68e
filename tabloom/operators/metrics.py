"""Model quality from (label, prediction) rows, as one aggregation and a few small steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.types import col


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def _share(part, whole):
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``class, precision, recall, f1, support`` with rows accuracy, macro avg, weighted avg.

    Divisions by zero give 0. The accuracy row carries its value in every score column.
    """
    hit = F.col("label").eqNullSafe(F.col("prediction"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("label").cast("string").alias("class"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
            F.when(hit, F.col("n")).otherwise(zero).alias("hits"),
        ),
        F.struct(
            F.col("prediction").cast("string").alias("class"),
            zero.alias("support"),
            F.col("n").alias("predicted"),
            zero.alias("hits"),
        ),
    )
    per_class = (
        confusion_counts(df, label, prediction)
        .select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
        .withColumn("precision", _share(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _share(F.col("hits"), F.col("support")))
        .withColumn(
            "f1",
            _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )
    scores = ["precision", "recall", "f1"]
    # the rollup adds one grand-total row, from which the three summary rows are made
    both = per_class.rollup("class").agg(
        F.grouping("class").alias("total"),
        *[F.avg(s).alias(s) for s in scores],
        *[_share(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(f"w_{s}") for s in scores],
        _share(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    )

    def row(name, columns):
        return F.struct(
            name.alias("class"),
            *[F.col(c).alias(s) for c, s in zip(columns, scores)],
            F.col("support").alias("support"),
        )

    summary = F.array(
        row(F.lit("accuracy"), ["accuracy"] * 3),
        row(F.lit("macro avg"), scores),
        row(F.lit("weighted avg"), [f"w_{s}" for s in scores]),
    )
    return both.select(
        F.inline(F.when(F.col("total") == 1, summary).otherwise(F.array(row(F.col("class"), scores))))
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: ``n, r2, mse, rmse, mae``; r2 = 1 - SSE / SST."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    sums = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count("*").alias("n"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("var"),
    )
    constant = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(
        "n",
        F.when(F.col("var") == 0, constant).otherwise(1 - F.col("mse") / F.col("var")).alias("r2"),
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
    )


def flatten_metrics(spark, per_target: dict[str, dict]) -> DataFrame:
    """``target, metric, value`` rows of the scalar metrics, rounded to 4 dp; those on rows set
    aside are called ``holdout_…``."""
    rows = [
        (target, prefix + name, round(float(v), 4))
        for target, metrics in per_target.items()
        for prefix, part in (("", metrics), ("holdout_", metrics.get("holdout", {})))
        for name, v in part.items()
        if isinstance(v, (int, float)) and not isinstance(v, bool)
    ]
    return spark.createDataFrame(rows, "target string, metric string, value double")
