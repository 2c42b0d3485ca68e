"""How far a table has moved from an earlier one: population stability index and Kolmogorov-Smirnov distance.

Bins are fitted once and are a small JSON document with the counts of the table that they were fitted on. Later
tables, or a stream, are only counted by bin: one grouped aggregation of plain column expressions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.operators.quantiles import exact_quantiles
from tabloom.session import stage
from tabloom.types import col, is_number, value

#: Share that an empty bin counts as.
FLOOR = 1e-4
#: Limits of the index below which a column is called stable, or moved moderately.
LIMITS = (0.1, 0.25)
MISSING, OTHER, KNOWN = -1, 1, 0


@dataclass
class DriftBins:
    """``edges`` of the bins of number columns, the listed ``values`` of others, and ``counts`` of
    (column, bin, value). Bin -1 is missing cells; of numbers bin i ends with edge i; of other columns bin 0
    is a listed value and bin 1 any other."""

    edges: dict[str, list[float]] = field(default_factory=dict)
    values: dict[str, list[str]] = field(default_factory=dict)
    counts: list[list] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "DriftBins":
        return cls(**json.loads(text))


def fit_bins(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    bins: int = 20,
    max_values: int = 200,
    approximate: bool = False,
) -> DriftBins:
    """Bins of about equal counts for numbers, and the most frequent values of other columns.

    A number column has at most ``bins`` bins, divided at its quantiles; equal quantiles are one edge, so that
    a column with few values may have a bin for each. Of other columns the ``max_values`` most frequent
    values are listed, the smaller of equally frequent ones first; the rest, and values that only later
    tables have, share one bin. Nulls and NaN are a bin of their own. Infinite numbers are in the outer bins.
    """
    names = list(cols or df.columns)
    numbers = [c for c in names if is_number(df.schema[c].dataType)]
    others = [c for c in names if c not in numbers]
    probs = [i / bins for i in range(1, bins)]
    quantiles = (_near_quantiles if approximate else exact_quantiles)(df, numbers, probs)
    edges = {c: sorted({x for x in quantiles[c] if x is not None and math.isfinite(x)}) for c in numbers}
    values: dict[str, list[str]] = {c: [] for c in others}
    if others:
        order = Window.partitionBy("column").orderBy(F.col("count").desc(), "value")
        counted = _text_counts(df, others).withColumn("place", F.row_number().over(order))
        for row in counted.where(F.col("place") <= max_values).collect():
            values[row["column"]].append(row["value"])
    found = DriftBins(edges, {c: sorted(v) for c, v in values.items()})
    found.counts = [list(row) for row in bin_counts(df, found).collect()]
    return found


def _near_quantiles(df: DataFrame, cols: Sequence[str], probs: list[float]) -> dict[str, list]:
    """In one scan, within 1/10,000 of the ranks."""
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(value(df, c).cast("double"), probs, 10_000) for c in cols]).first()
    return {c: x or [] for c, x in zip(cols, row)}


def _text_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in names]
    return df.select(F.inline(F.array(*cells))).where("value is not null").groupBy("column", "value").count()


def _number_bin(x: Column, edges: list[float]) -> Column:
    """Number of edges below ``x``, by a balanced tree of comparisons."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x <= edges[middle], among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(edges))


def _cells(df: DataFrame, bins: DriftBins) -> Column:
    cells = []
    for c, edges in bins.edges.items():
        x = value(df, c).cast("double")
        at = F.when(x.isNull(), MISSING).otherwise(_number_bin(x, edges))
        cells.append(F.struct(F.lit(c).alias("column"), at.alias("bin"), F.lit(None).cast("string").alias("value")))
    for c, listed in bins.values.items():
        x = col(c).cast("string")
        known = x.isin(listed) if listed else F.lit(False)
        at = F.when(x.isNull(), MISSING).when(known, KNOWN).otherwise(OTHER)
        cells.append(F.struct(F.lit(c).alias("column"), at.alias("bin"), F.when(known, x).alias("value")))
    return F.array(*cells)


def bin_counts(df: DataFrame, bins: DriftBins, *by: Column) -> DataFrame:
    """(by..., column, bin, value, n): one grouped aggregation for all columns, of a table or a stream.

    Rows only cross the network as counts. Columns that ``bins`` has and ``df`` hasn't raise.
    """
    cells = df.select(*by, F.inline(_cells(df, bins)))
    groups = [c for c in cells.columns if c not in ("column", "bin", "value")]
    return cells.groupBy(*groups, "column", "bin", "value").agg(F.count("*").alias("n"))


def drift(df: DataFrame, bins: DriftBins) -> DataFrame:
    """One row per column of ``bins``: see ``score``."""
    return score(df.sparkSession, bins, stage(bin_counts(df, bins)))


def score(spark: SparkSession, bins: DriftBins, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Compare counts by bin with those that the bins were fitted on; only counts are read.

    (by..., column, kind, psi, ks, level, missing_before, missing_after, unlisted_before, unlisted_after, n_before,
    n_after). ``psi`` sums (p - q) * ln(p / q) over all bins, missing and unlisted ones too, with shares of at
    least FLOOR. ``ks``, for numbers, is the largest distance of the cumulative shares of present cells
    at the edges; the true distance is at most the largest share of the fitted table within one bin
    above it. A table without rows has null scores.
    """
    kinds = [(c, "number") for c in bins.edges] + [(c, "text") for c in bins.values]
    columns = F.broadcast(spark.createDataFrame(kinds, "column string, kind string"))
    cells = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("bin"), F.lit(v).cast("string").alias("value"), F.lit(n).cast("long").alias("n")) for c, i, v, n in bins.counts]
    fitted = F.array(*cells) if cells else F.array().cast("array<struct<column:string,bin:int,value:string,n:bigint>>")
    groups = counts.select(*by).distinct() if by else spark.range(1).select()
    old = groups.select("*", F.inline(fitted))
    keys = [*by, "column", "bin"]
    a = old.withColumnRenamed("n", "old").withColumn("value", F.coalesce("value", F.lit("")))
    b = counts.select(*keys, F.coalesce("value", F.lit("")).alias("value"), F.col("n").alias("new"))
    both = a.join(b, [*keys, "value"], "full").na.fill(0, ["old", "new"])
    whole = Window.partitionBy(*by, "column")
    present = lambda c: F.sum(F.when(F.col("bin") != MISSING, F.col(c)).otherwise(0))
    up_to = whole.orderBy("bin").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.select(
        "*",
        F.sum("old").over(whole).alias("n_before"),
        F.sum("new").over(whole).alias("n_after"),
        F.abs(F.try_divide(present("old").over(up_to), present("old").over(whole)) - F.try_divide(present("new").over(up_to), present("new").over(whole))).alias("apart"),
    )
    p = F.greatest(F.try_divide("old", "n_before"), F.lit(FLOOR))
    q = F.greatest(F.try_divide("new", "n_after"), F.lit(FLOOR))
    some = (F.col("n_before") > 0) & (F.col("n_after") > 0)
    share = lambda c, n, at: F.try_divide(F.sum(F.when(at, F.col(c)).otherwise(0)), F.first(n))
    missing = F.col("bin") == MISSING
    unlisted = (F.col("kind") == "text") & (F.col("bin") == OTHER)
    out = both.join(columns, "column").groupBy(*by, "column", "kind").agg(
        F.sum(F.when(some, (p - q) * F.log(p / q))).alias("psi"),
        F.max(F.when(some & ~missing & (F.col("kind") == "number"), F.col("apart"))).alias("ks"),
        share("old", "n_before", missing).alias("missing_before"),
        share("new", "n_after", missing).alias("missing_after"),
        share("old", "n_before", unlisted).alias("unlisted_before"),
        share("new", "n_after", unlisted).alias("unlisted_after"),
        F.first("n_before").alias("n_before"),
        F.first("n_after").alias("n_after"),
    )
    level = F.when(F.col("psi") < LIMITS[0], "stable").when(F.col("psi") < LIMITS[1], "moderate").when(F.col("psi").isNotNull(), "major")
    order = [*by, "column", "kind", "psi", "ks", "level", "missing_before", "missing_after", "unlisted_before", "unlisted_after", "n_before", "n_after"]
    return out.withColumn("level", level).select(*order)
