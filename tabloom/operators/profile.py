"""Profile report as tidy DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.quantiles import exact_quantiles
from tabloom.types import col, is_number, is_time, numeric_columns, value

MAX_BROADCAST_KEYS = 100_000  # of at most 64 bytes
PERFECT, ROUNDING = 1 - 1e-12, 1e-13

# In-memory width in bytes of one cell of each fixed-width type.
WIDTHS = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "date": 4,
    "float": 4,
    "bigint": 8,
    "double": 8,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


LONG = 64  # bytes


def compact(c: Column) -> Column:
    """Text as a grouping key of at most 64 bytes: long text is replaced by its SHA-256.

    A digest is 64 characters and shorter text stays itself, so the two cannot be confused.
    Shuffles and comparisons then cost the same for words and for whole documents.
    """
    return F.when(F.octet_length(c) < LONG, c).otherwise(F.sha2(c.cast("binary"), 256))


def row_keys(df: DataFrame, names: list[str]) -> list[Column]:
    """The cells of a row as grouping keys."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return [compact(col(c)) if c in text else col(c) for c in names]


def duplicate_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """One row, ``duplicates``: rows beyond the first of each distinct (sub)row.

    Nulls are equal. Copies are combined before the shuffle, so many copies of one row
    cost no more than one.
    """
    keys = [k.alias(f"g{i}") for i, k in enumerate(row_keys(df, subset or df.columns))]
    copies = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def readable_size(size: Column) -> Column:
    """Bytes as text in the largest unit below 1024."""
    units = ["bytes", "KB", "MB", "GB"]
    text = F.format_string("%.1f GB", size / 1024.0**3)
    for power in (2, 1, 0):
        text = F.when(
            size < 1024.0 ** (power + 1),
            F.format_string(f"%.1f {units[power]}", size / 1024.0**power),
        ).otherwise(text)
    return text


def profile_table(df: DataFrame, duplicates: bool = True) -> DataFrame:
    """One row: rows, columns, size in bytes of the cells, and duplicate rows."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        width = WIDTHS.get(f.dataType.simpleString())
        if width:
            size = size + F.count("*") * width
        else:
            size = size + F.coalesce(F.sum(F.octet_length(col(f.name).cast("string"))), F.lit(0))
    out = df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        size.alias("data_bytes"),
    ).withColumn("data_size", readable_size(F.col("data_bytes").cast("double")))
    if not duplicates:
        return out
    return out.withColumn("duplicates", duplicate_rows(df).scalar())


def profile_missing(df: DataFrame) -> DataFrame:
    """Columns with missing cells: ``column, missing, percent`` (1 dp), most first."""
    counts = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(value(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col("n"))
        for i, c in enumerate(df.columns)
    ]
    return (
        counts.select(F.inline(F.array(*cells)))
        .where("missing > 0")
        .select("column", "missing", F.round(100.0 * F.col("missing") / F.col("n"), 1).alias("percent"))
        .orderBy(F.desc("missing"), "column")
    )


def value_text(df: DataFrame, name: str) -> Column:
    """A cell as text such that equal values have equal text (0.0 and -0.0 included)."""
    c = value(df, name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0).cast(df.schema[name].dataType)
    return c.cast("string")


def value_counts(df: DataFrame, cols: list[str], keys: bool = False) -> DataFrame:
    """``i, v, n``: how often each value of each column occurs; nulls skipped.

    With ``keys``, long values are counted under their digest.
    """
    texts = [value_text(df, c) for c in cols]
    cells = [
        F.struct(F.lit(i).alias("i"), (compact(t) if keys else t).alias("v")) for i, t in enumerate(texts)
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .where("v is not null")
        .groupBy("i", "v")
        .agg(F.count("*").alias("n"))
    )


@dataclass
class Frequent:
    """Distinct values of a column, its most frequent value (the smallest of equals), its count."""

    distinct: int = 0
    value: str | None = None
    n: int = 0


def most_frequent(df: DataFrame, cols: list[str]) -> dict[str, Frequent]:
    """One shuffle of (column, key) counts for all columns.

    Keys are short even for documents. The text behind the winning digests is read back with
    a filter, or with a join when very many long values tie.
    """
    if not cols:
        return {}
    counts = value_counts(df, cols, keys=True)
    digest = F.length("v") == LONG
    tops = (
        counts.groupBy("i", "n")
        .agg(
            F.count("*").alias("tied"),
            F.min(F.when(~digest, F.col("v"))).alias("short"),
            F.count_if(digest).alias("digests"),
            F.min(F.when(digest, F.col("v"))).alias("digest"),
        )
        .groupBy("i")
        .agg(F.sum("tied").alias("distinct"), F.max(F.struct("n", "short", "digests", "digest")).alias("top"))
        .collect()  # one row per column
    )
    found = {c: Frequent() for c in cols}
    for row in tops:
        name, top = cols[row.i], row.top
        best = top.short
        if top.digests:
            text = value_text(df, name)
            tied = counts.where((F.col("i") == row.i) & (F.col("n") == top.n) & digest).select("v")
            if top.n == 1:
                rows = df  # every value ties
            elif top.digests == 1:
                rows = df.where(compact(text) == top.digest)
            elif top.digests <= MAX_BROADCAST_KEYS:
                rows = df.join(F.broadcast(tied), compact(text) == F.col("v"), "left_semi")
            else:
                rows = df.join(tied, compact(text) == F.col("v"), "left_semi")
            longest = rows.agg(F.min(F.when(F.octet_length(text) >= LONG, text))).first()[0]
            # byte order, as in Spark
            best = min((v for v in (best, longest) if v is not None), key=lambda v: v.encode())
        found[name] = Frequent(row.distinct, best, top.n)
    return found


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Exact distinct counts of number and time columns: one shuffle of (column, value) of at
    most 16 bytes of value; only decimals travel as text."""
    if not cols:
        return {}
    cells = []
    for i, c in enumerate(cols):
        dtype, v = df.schema[c].dataType, value(df, c)
        whole = number = text = None
        if isinstance(dtype, T.IntegralType):
            whole = v
        elif isinstance(dtype, (T.DoubleType, T.FloatType)):
            number = v
        elif isinstance(dtype, T.DateType):
            whole = F.unix_date(v)
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            whole = F.unix_micros(v.cast("timestamp"))
        else:
            text = value_text(df, c)
        part = lambda x, t, name: (F.lit(None) if x is None else x).cast(t).alias(name)
        cells.append(
            F.struct(
                F.lit(i).alias("i"),
                part(whole, "bigint", "l"),
                part(number, "double", "d"),
                part(text, "string", "s"),
            )
        )
    long = df.select(F.inline(F.array(*cells))).where("l is not null or d is not null or s is not null")
    counts = long.groupBy("i", "l", "d", "s").agg(F.lit(1)).groupBy("i").agg(F.count("*").alias("n")).collect()
    return dict.fromkeys(cols, 0) | {cols[r.i]: r.n for r in counts}


def fewer_values(df: DataFrame, name: str, limit: int, estimate: int | None = None) -> bool:
    """Whether a column has fewer than ``limit`` distinct values (for small limits).

    A sketch is never above a true count of a few dozen, so an estimate at or above
    the limit settles the question and only small ones need the exact count, which is then
    cheap.
    """
    if estimate is None:
        estimate = df.agg(F.approx_count_distinct(value(df, name))).first()[0]
    if estimate >= limit:
        return False
    return df.agg(F.count_distinct(value(df, name))).first()[0] < limit


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``column, type, unique, nulls, details`` per column.

    One aggregation gives nulls and number / time details. Most frequent values and distinct
    counts of categorical columns come from one shuffle of (column, key) counts, distinct counts
    of numbers and times from one of typed values; ``approximate`` takes the latter from sketches.
    """
    cells = []
    for i, f in enumerate(df.schema):
        v = value(df, f.name)
        if is_number(f.dataType):
            x = v.cast("double")
            text = F.format_string("min=%.2f, max=%.2f, mean=%.2f", F.min(x), F.max(x), F.avg(x))
            details = F.when(F.count(x) > 0, text)
        elif is_time(f.dataType):
            details = F.concat(F.min(v).cast("string"), F.lit(" → "), F.max(v).cast("string"))
        else:
            details = F.lit(None).cast("string")
        distinct = F.approx_count_distinct(v) if approximate else F.lit(None).cast("long")
        cells.append(
            F.struct(
                F.count_if(v.isNull()).alias("nulls"), details.alias("details"), distinct.alias("distinct")
            ).alias(f"s{i}")
        )
    stats = df.agg(*cells).first()
    ranged = {f.name: is_number(f.dataType) or is_time(f.dataType) for f in df.schema}
    frequent = most_frequent(df, [c for c in df.columns if not ranged[c]])
    distinct = {} if approximate else distinct_counts(df, [c for c in df.columns if ranged[c]])
    rows = []
    for f, s in zip(df.schema, stats):
        top = frequent.get(f.name) or Frequent(distinct.get(f.name, s.distinct))
        details = s.details if ranged[f.name] else f"top: {(top.value or '')[:40]}, freq: {top.n}"
        rows.append((f.name, f.dataType.simpleString(), top.distinct, s.nulls, details))
    return df.sparkSession.createDataFrame(
        rows, "column string, type string, unique bigint, nulls bigint, details string"
    )


PAIR_SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def _pair_sums(means: list[float], pairs: list[tuple[int, int]]):
    """Per task one row of sums for each pair: products of masked matrices, batch by batch."""
    left, right = (np.array([p[side] for p in pairs]) for side in (0, 1))
    centre = np.array(means)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(centre), len(centre)))
        for batch in batches:
            cells = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            known = np.isfinite(cells)
            x, known = np.where(known, cells, centre) - centre, known.astype(float)
            total += [known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x]
        n, x, xx, xy = total
        sums = [n[left, right], x[left, right], x[right, left], xx[left, right], xx[right, left], xy[left, right]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int32()), pa.array(right, pa.int32()), *[pa.array(s) for s in sums]],
            ["i", "j", *PAIR_SUMS],
        )

    return add


def correlation_pairs(df: DataFrame, cols: list[str] | None = None, diagonal: bool = False) -> DataFrame:
    """Pearson correlation ``a, b, r`` of each pair of columns over rows where both exist.

    Null where one of the two is constant in these rows; infinities count as missing. Rows are
    read twice, for the means and for sums of products about them; a task sends one row per pair.
    """
    names = cols or numeric_columns(df)
    pairs = list(combinations(range(len(names)), 2))
    if diagonal:
        pairs += [(i, i) for i in range(len(names))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    cells = df.select(*[value(df, n).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    finite = [F.avg(F.when(F.abs(c) < float("inf"), F.col(c))) for c in cells.columns]
    means = [m or 0.0 for m in cells.agg(*finite).first()]
    fields = ", ".join(f"{name} double" for name in PAIR_SUMS)
    sums = (
        cells.mapInArrow(_pair_sums(means, pairs), f"i int, j int, {fields}")
        .groupBy("i", "j")
        .agg(*[F.sum(name).alias(name) for name in PAIR_SUMS])
    )
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(at) + 1)

    def spread(square: str, plain: str, at: str) -> Column:
        """Sum of squares about the mean; null if no more than rounding is left of it."""
        found = F.col(square) - F.try_divide(F.col(plain) * F.col(plain), F.col("n"))
        noise = F.greatest(ROUNDING * F.col(square), F.col("n") * (ROUNDING * pick(means, at)) ** 2)
        return F.when(found > noise, found)

    together = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n"))
    r = F.try_divide(together, F.sqrt(spread("xx", "x", "i")) * F.sqrt(spread("yy", "y", "j")))
    r = F.when(F.isnan(r), r).when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)
    return sums.select(pick(names, "i").alias("a"), pick(names, "j").alias("b"), r.alias("r"))


def profile_correlations(df: DataFrame, k: int = 20) -> DataFrame:
    """The k strongest pairs by absolute correlation; perfect ones are left out."""
    strength = F.abs("r")
    return (
        correlation_pairs(df)
        .where((strength < PERFECT) & ~F.isnan("r"))
        .select("a", "b", F.round(strength, 3).alias("correlation"), strength.alias("_s"))
        .orderBy(F.desc("_s"), "a", "b")
        .limit(k)
        .drop("_s")
    )


def describe(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """``column, count, mean, std, min, p25, p50, p75, max`` for numeric columns."""
    names = cols or numeric_columns(df)
    probs = [0.25, 0.5, 0.75]
    if not names:
        fields = ["mean", "std", "min", "p25", "p50", "p75", "max"]
        schema = "column string, count bigint, " + ", ".join(f"{f} double" for f in fields)
        return df.sparkSession.createDataFrame([], schema)
    exact = {} if approximate else exact_quantiles(df, names, probs)
    aggs = []
    for i, c in enumerate(names):
        x = value(df, c).cast("double")
        if approximate:
            quartiles = F.percentile_approx(x, probs, 10000)
            q = [quartiles[j] for j in range(3)]
        else:
            q = [F.lit(v).cast("double") for v in exact[c]]
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                q[0].alias("p25"),
                q[1].alias("p50"),
                q[2].alias("p75"),
                F.max(x).alias("max"),
            ).alias(f"s{i}")
        )
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """All parts of the report."""
    return {
        "table": profile_table(df),
        "missing": profile_missing(df),
        "columns": profile_columns(df),
        "correlations": profile_correlations(df),
    }
