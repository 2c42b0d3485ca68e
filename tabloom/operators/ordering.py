"""Operators that depend on row order: previews, samples, gap filling, last rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import stage
from tabloom.types import col, is_number, present

SAMPLE_SIZE = 5000
COPIES_AT_ONCE = 10_000  # equal rows beyond this many are drawn by another task
ROWS_PER_BUCKET = 500_000


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(col(key)).limit(n)


def last_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(col(key).desc()).limit(n)


def sample_rows(df: DataFrame, n: int = SAMPLE_SIZE, key: str | None = None, seed: int = 42) -> DataFrame:
    """Exactly n rows (all rows if there are fewer), the same ones however the table is split.

    Rows are taken in the order of a seeded hash of the key, which must be unique. Without a key it is a hash of
    the whole row and, from its second copy on, of the number of the copy: equal rows are drawn one by one.
    A threshold on that hash, chosen from the row count, lets only about n rows reach the
    final sort; it is widened in the unlikely case that too few rows pass.
    """
    total = df.count()
    if total <= n:
        return df
    share = (n + 10 * math.sqrt(n) + 100) / total
    if key is None:
        return _sample_copies(df, n, seed, share)
    rows = df.withColumn("_h", F.xxhash64(F.lit(seed), col(key)))
    while share < 1:
        passing = rows.where(F.col("_h") <= F.lit(_hash_limit(share)))
        if passing.count() >= n:
            rows = passing
            break
        share *= 2
    return rows.orderBy("_h", col(key)).limit(n).drop("_h")


def _hash_limit(share: float) -> int:
    """The 64-bit hash that about this share of all hashes does not exceed."""
    return int(-(2**63) + share * 2**64)


def _sample_copies(df: DataFrame, n: int, seed: int, share: float) -> DataFrame:
    """Exactly n of more than n rows, some of which may be equal.

    Only hashes of rows and their counts are shuffled to choose how many copies of which row are taken; the chosen
    ones (n at most) are staged and looked up in the table.
    """
    cells = [F.col(f"c{i}") for i in range(len(df.columns))]
    ordered = [c for c, f in zip(cells, df.schema) if not isinstance(f.dataType, T.MapType)]
    rows = df.toDF(*[f"c{i}" for i in range(len(cells))]).withColumn("h", F.xxhash64(F.lit(seed), *ordered))
    counted = rows.groupBy("h").agg(F.count("*").alias("copies"))
    chunk = F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES_AT_ONCE}L)"))
    copy = F.explode(F.expr(f"sequence(first, least(first + {COPIES_AT_ONCE}, copies) - 1)"))
    draw = F.when(F.col("copy") == 0, F.col("h")).otherwise(F.xxhash64(F.lit(seed), "h", "copy"))
    tasks = df.sparkSession.sparkContext.defaultParallelism  # given, since few bytes here can stand for many copies
    while True:
        limit = F.lit(_hash_limit(share) if share < 1 else 2**63 - 1)
        near = counted.where((F.col("copies") > 1) | (F.col("h") <= limit)).select("*", chunk.alias("first"))
        drawn = near.repartition(tasks, "h", "first").select("h", copy.alias("copy")).select("h", draw.alias("draw"))
        first = drawn.where(F.col("draw") <= limit).orderBy("draw", "h").limit(n)
        taken = stage(first.groupBy("h").agg(F.count("*").alias("taken")))
        if share >= 1 or taken.agg(F.sum("taken")).first()[0] == n:
            break
        share *= 2
    equal = rows.join(taken, "h").groupBy("h", "taken", *cells).agg(F.count("*").alias("copies"))
    # rows of one hash are equal, or nearly never different ones that share the places taken
    before = F.sum("copies").over(Window.partitionBy("h").orderBy("h", *ordered).rowsBetween(Window.unboundedPreceding, -1))
    times = F.least(F.col("copies"), F.col("taken") - F.coalesce(before, F.lit(0)))
    some = equal.select(*cells, times.alias("times")).where("times > 0")
    return some.select(*cells, F.explode(F.expr("sequence(1L, times)"))).select(*cells).toDF(*df.columns)


def _position(df: DataFrame, key: str) -> Column:
    """A double that never falls as the key rises; equal doubles only share a bucket."""
    dtype = df.schema[key].dataType
    if is_number(dtype):
        return col(key).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col(key).cast("timestamp")).cast("double")
    raise ValueError(f"the ordering column {key} must be a number or a point in time")


def fill_gaps(
    df: DataFrame,
    column: str,
    key: str,
    default=0,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Fill missing values from the row before, leading ones from the first value, else 0.

    ``key`` orders the rows and must be unique. The key range is cut into buckets of about
    ``rows_per_bucket`` rows by approximate quantiles. Rows are filled inside their bucket, and
    the last value of the buckets before it is carried in, so no task sees the whole table.
    The number of buckets follows from the rows alone. Rows without a key (null or NaN) come last, in
    no order: each that lacks a value takes the last one of the rows with a key, else ``default``.
    """
    rows, total = df.agg(F.count("*"), F.count_if(present(df, key))).first()
    if total < rows:
        ordered = df.where(present(df, key))
        last = ordered.where(col(column).isNotNull()).agg(F.max_by(col(column), col(key))).scalar()
        rest = df.where(~present(df, key)).withColumn(column, F.coalesce(col(column), last, F.lit(default).cast(df.schema[column].dataType)))
        return fill_gaps(ordered, column, key, default, rows_per_bucket).unionAll(rest)
    position = _position(df, key)
    wanted = max(1, math.ceil(total / rows_per_bucket))
    cuts: list[float] = []
    if wanted > 1:
        fractions = [i / wanted for i in range(1, wanted)]
        (found,) = df.agg(F.percentile_approx(position, fractions, max(10_000, 10 * wanted))).first()
        cuts = sorted(set(found))
    keyed = df.withColumn("_p", position)
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        keyed = Bucketizer(splits=splits, inputCol="_p", outputCol="_b").transform(keyed)
        keyed = keyed.withColumn("_b", F.col("_b").cast("int"))
    else:
        keyed = keyed.withColumn("_b", F.lit(0))
    c, k = col(column), col(key)
    ends = (
        keyed.where(c.isNotNull())
        .groupBy("_b")
        .agg(F.max_by(c, k).alias("last"), F.min_by(c, k).alias("first"))
        .orderBy("_b")
        .collect()  # at most one row per bucket
    )
    dtype = df.schema[column].dataType
    fill = F.lit(default).cast(dtype) if default is not None else F.lit(None).cast(dtype)
    if not ends:
        return df.withColumn(column, F.coalesce(c, fill))
    carried, before, ends = [], None, {r["_b"]: r for r in ends}
    first = ends[min(ends)]["first"]
    for b in range(len(cuts) + 1):
        carried.append((b, before if before is not None else first))
        before = ends[b]["last"] if b in ends else before
    carry = df.sparkSession.createDataFrame(
        carried, T.StructType([T.StructField("_b", T.IntegerType()), T.StructField("_c", dtype)])
    )
    so_far = (
        Window.partitionBy("_b").orderBy(k).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col("_c"), fill)
    return (
        keyed.join(F.broadcast(carry), "_b", "left")  # one row per bucket, 500,000 times fewer than rows
        .withColumn(column, filled)
        .select(*[col(n) for n in df.columns])
    )
