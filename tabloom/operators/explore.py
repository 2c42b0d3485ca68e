"""Numbers behind the exploration screens: frequencies, summaries, histograms, comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordering import last_rows, sample_rows
from tabloom.operators.profile import correlation_pairs, describe
from tabloom.operators.quantiles import approx_medians, exact_medians, exact_quantiles, grouped_quantiles
from tabloom.session import stage
from tabloom.types import col, is_number, numeric_columns, present, value

MIN_SUPPORT = 3  # a filtered summary needs at least this many rows


def row_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def frequencies(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """``value, n`` by falling count (equal counts by value); ``k`` keeps the top rows."""
    out = (
        df.where(present(df, column))
        .groupBy(col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
    )
    return out if k is None else out.limit(k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(present(df, column)).select(col(column).alias("value")).distinct()


def input_stats(df: DataFrame, features: Sequence[str], approximate: bool = False) -> DataFrame:
    """``column, kind, min, max, median`` per feature, for building input forms.

    Values of categorical features stay a distributed table: see ``distinct_values``.
    """
    present = [c for c in features if c in df.columns]
    numeric = [c for c in present if is_number(df.schema[c].dataType)]
    medians = (approx_medians if approximate else exact_medians)(df, numeric)
    nothing = F.lit(None).cast("double")
    cells = []
    for c in present:
        x = value(df, c).cast("double") if c in numeric else None
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit("numeric" if c in numeric else "categorical").alias("kind"),
                (F.min(x) if c in numeric else nothing).alias("min"),
                (F.max(x) if c in numeric else nothing).alias("max"),
                F.lit(medians.get(c)).cast("double").alias("median"),
            ).alias(f"s{len(cells)}")
        )
    wide = df.agg(*cells)
    return wide.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(cells))])))


def matching(df: DataFrame, conditions: dict) -> DataFrame:
    """Rows equal to every given value; conditions on absent columns are ignored."""
    tests = [col(k) == F.lit(v) for k, v in conditions.items() if k in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def conditional_summary(
    df: DataFrame, target: str, conditions: dict | None = None, top: int = 3
) -> DataFrame:
    """Summary of a target under equality conditions.

    Numeric targets: one row ``mean, median, min, max, count``. Other targets: the most
    common values ``value, n``. With conditions, nothing unless three rows match.
    """
    rows = matching(df, conditions or {}).where(present(df, target))
    least = MIN_SUPPORT if conditions else 1
    x = value(df, target)
    if not is_number(df.schema[target].dataType):
        enough = rows.agg(F.count("*") >= least)
        return frequencies(rows, target, top).where(enough.scalar())
    x = x.cast("double")
    median = exact_medians(rows, [target])[target]
    return rows.agg(
        F.avg(x).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.count(x).alias("count"),
    ).where(F.col("count") >= least)


def group_summary(df: DataFrame, by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per group: count of every column and mean (2 dp) of the numeric ones."""
    names = [c for c in columns or df.columns if c != by]
    aggs = []
    for c in names:
        v = value(df, c)
        aggs.append(F.count(v).alias(f"{c}_count"))
        if is_number(df.schema[c].dataType):
            aggs.append(F.round(F.avg(v.cast("double")), 2).alias(f"{c}_mean"))
    return df.groupBy(col(by).alias(by)).agg(*aggs)


def label_profile(df: DataFrame, label: str) -> DataFrame:
    """``value, n, share`` of the values of a label, most frequent first."""
    counts = frequencies(df, label)
    total = df.agg(F.count(value(df, label))).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), "value")


def histogram(
    df: DataFrame,
    column: str,
    bins: int = 20,
    by: str | None = None,
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """``bin, bin_start, bin_end, [by,] n``: equal-width bins, the maximum in the last one."""
    x = value(df, column).cast("double")
    if bounds is None:
        bounds = tuple(df.agg(F.min(x), F.max(x)).first())
    lo, hi = bounds
    keys = [] if by is None else [col(by).alias("_by")]
    schema_only = lo is None
    lo, hi = (0.0, 0.0) if schema_only else (float(lo), float(hi))
    width = (hi - lo) / bins if hi > lo else 1.0
    slot = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    inside = present(df, column) & x.between(lo, hi) & F.lit(not schema_only)
    start = F.lit(lo) + F.col("_bin") * width
    return (
        df.where(inside)
        .groupBy(slot.alias("_bin"), *keys)
        .agg(F.count("*").alias("n"))
        .select(
            F.col("_bin").alias("bin"),
            start.alias("bin_start"),
            (start + width).alias("bin_end"),
            *([] if by is None else [F.col("_by").alias(by)]),
            "n",
        )
    )


def box_stats(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """``[by,] q1, median, q3, whisker_low, whisker_high, outliers`` of a box plot.

    Whiskers end at the last values within 1.5 interquartile ranges of the box.
    """
    x = value(df, column).cast("double")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    whiskers = [
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    ]
    box = ["q1", "median", "q3"]
    if by is None:
        quartiles = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
        known = [F.lit(q).cast("double").alias(n) for q, n in zip(quartiles, box)]
        return df.where(present(df, column)).select(x.alias("x"), *known).groupBy(*box).agg(*whiskers)
    quartiles = (
        grouped_quantiles(df, [by], column, [0.25, 0.5, 0.75])
        .groupBy(col(by).alias("_box"))
        .pivot("p", [0.25, 0.5, 0.75])
        .agg(F.first("quantile"))
        .toDF("_box", *box)
    )
    # written, so that its true size decides whether the join broadcasts it
    quartiles = stage(quartiles)
    rows = df.where(present(df, column)).select(col(by).alias("_by"), x.alias("x"))
    return (
        rows.join(quartiles, F.col("_by").eqNullSafe(F.col("_box")))
        .groupBy(F.col("_by").alias(by), *box)
        .agg(*whiskers)
    )


def _cells(df: DataFrame, cols: Sequence[str], by: str | None, *extra) -> DataFrame:
    """``_column, _x, [_by,] ...`` for every present number; ``extra`` are lists of columns, one of each for every column."""
    own = [
        F.struct(F.lit(c).alias("_column"), F.when(present(df, c), value(df, c).cast("double")).alias("_x"), *[e[i] for e in extra])
        for i, c in enumerate(cols)
    ]
    group = [] if by is None else [col(by).alias("_by")]
    return df.select(*group, F.inline(F.array(*own))).where("_x is not null")


def histograms(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 20, by: str | None = None) -> DataFrame:
    """``column, bin, bin_start, bin_end, [by,] n`` of all numeric columns, or ``cols``, as ``histogram`` gives them one by one:
    one job for all bounds and one pass, combined before the shuffle, for all counts."""
    names = list(numeric_columns(df) if cols is None else cols)
    ends = df.agg(*[F.struct(F.min(x), F.max(x)) for x in (value(df, c).cast("double") for c in names)]).first() if names else []
    known = {c: (float(lo), float(hi)) for c, (lo, hi) in zip(names, ends) if lo is not None}
    if not known:
        known = {c: (0.0, 0.0) for c in names[:1]}  # the columns of an empty result
    if not known:
        raise ValueError("no numeric column to count")
    lows = [F.lit(lo).alias("_lo") for lo, _ in known.values()]
    widths = [F.lit((hi - lo) / bins if hi > lo else 1.0).alias("_width") for lo, hi in known.values()]
    slot = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_width")), F.lit(bins - 1)).cast("int")
    start = F.col("_lo") + F.col("bin") * F.col("_width")
    group = [] if by is None else ["_by"]
    counted = _cells(df, list(known), by, lows, widths).groupBy("_column", "_lo", "_width", slot.alias("bin"), *group).agg(F.count("*").alias("n"))
    shown = [] if by is None else [F.col("_by").alias(by)]
    return counted.select(
        F.col("_column").alias("column"), "bin", start.alias("bin_start"), (start + F.col("_width")).alias("bin_end"), *shown, "n"
    )


def boxes(df: DataFrame, cols: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """``column, [by,] q1, median, q3, whisker_low, whisker_high, outliers`` of all numeric columns, or ``cols``, as ``box_stats``
    gives them one by one: the quartiles of all columns and groups are found together, and one pass finds the whiskers."""
    names = list(numeric_columns(df) if cols is None else cols)
    if not names:
        raise ValueError("no numeric column to summarise")
    box = ["q1", "median", "q3"]
    if by is None:
        found = exact_quantiles(df, names, [0.25, 0.5, 0.75])
        quartiles = [[F.lit(found[c][i]).cast("double").alias(n) for c in names] for i, n in enumerate(box)]
        rows, group = _cells(df, names, by, *quartiles), ["_column"]
    else:
        group = ["_column", "_by"]
        cells = _cells(df, names, by)
        known = grouped_quantiles(cells, group, "_x", [0.25, 0.5, 0.75]).groupBy(*[F.col(g).alias(f"_of{g}") for g in group])
        known = known.pivot("p", [0.25, 0.5, 0.75]).agg(F.first("quantile")).toDF("_of_column", "_of_by", *box)
        known = stage(known)  # its true size decides whether the join broadcasts it
        rows = cells.join(known, [F.col("_column") == F.col("_of_column"), F.col("_by").eqNullSafe(F.col("_of_by"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_x").between(F.col("q1") - reach, F.col("q3") + reach)
    out = rows.groupBy(*group, *box).agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    shown = [] if by is None else [F.col("_by").alias(by)]
    return out.select(F.col("_column").alias("column"), *shown, *box, "whisker_low", "whisker_high", "outliers")


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Heat-map cells ``a, b, r`` for every ordered pair, diagonal included."""
    half = correlation_pairs(df, list(cols) if cols else None, diagonal=True)
    # one pass: the mirrored cell is made from the same row
    cells = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "r"))).otherwise(
        F.array(
            F.struct("a", "b", "r"),
            F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"),
        )
    )
    return half.select(F.inline(cells))


def scatter_data(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    by: str | None = None,
    key: str | None = None,
    n: int | None = None,
) -> DataFrame:
    """Points for a scatter matrix: the numeric columns, or ``cols``, and the colour column.

    All rows, or exactly ``n`` of them if that is asked for.
    """
    dims = list(cols or numeric_columns(df))
    wanted = [*dims, *([by] if by and by not in dims else [])]
    keep = [*wanted, *([key] if key and key not in wanted else [])]
    picked = df.select(*[col(c) for c in keep])
    picked = picked if n is None else sample_rows(picked, n, key=key)
    return picked.select(*[col(c) for c in wanted])


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and columns before and after, and the differences."""
    a, b = before.agg(F.count("*")).scalar(), after.agg(F.count("*")).scalar()
    one = before.sparkSession.range(1)
    return one.select(
        a.alias("rows_before"),
        b.alias("rows_after"),
        (b - a).alias("rows_delta"),
        F.lit(len(before.columns)).alias("columns_before"),
        F.lit(len(after.columns)).alias("columns_after"),
        F.lit(len(after.columns) - len(before.columns)).alias("columns_delta"),
    )


def removed_rows(before: DataFrame, after: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``before`` whose key is not in ``after``; null keys are equal. Only the key of ``after`` is read."""
    keys = [key] if isinstance(key, str) else list(key)
    seen = after.select(*[col(k).alias(f"_after_{i}") for i, k in enumerate(keys)])
    same = [col(k).eqNullSafe(F.col(f"_after_{i}")) for i, k in enumerate(keys)]
    return before.join(seen, same, "left_anti")


def prediction_summary(predictions: DataFrame, key: str, column: str = "prediction", last: int = 5) -> DataFrame:
    """One row: min, max, mean, population std and the last predictions in key order."""
    x = col(column).cast("double")
    tail = (
        last_rows(predictions.select(col(key).alias("k"), x.alias("v")), last, "k")
        .agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("t"))
        .select("t.v")
    )
    return predictions.agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")
    ).withColumn("last", tail.scalar())


def class_distribution(
    predictions: DataFrame, column: str = "prediction", probabilities: Sequence[str] = ()
) -> DataFrame:
    """``value, n`` per predicted class, and the range of its highest probability if given."""
    if not probabilities:
        return frequencies(predictions, column)
    best = F.array_max(F.array(*[col(p) for p in probabilities]))
    return (
        predictions.groupBy(col(column).alias("value"))
        .agg(F.count("*").alias("n"), F.min(best).alias("confidence_min"), F.max(best).alias("confidence_max"))
        .orderBy(F.desc("n"), "value")
    )


def explore(df: DataFrame, by: str | None = None, key: str | None = None) -> dict[str, DataFrame]:
    """Everything the exploration view shows, per numeric column where it applies.

    Histograms and boxes of all columns are counted together and written once: no column adds a job of its own
    (quartiles take a set of jobs for each ``COLUMNS_PER_PASS`` columns).
    """
    first = numeric_columns(df)
    out = {"describe": describe(df), "correlations": correlation_matrix(df)}
    if first:
        for name, all_columns in (("histogram", stage(histograms(df, first, by=by))), ("box", stage(boxes(df, first, by=by)))):
            out |= {f"{name}:{c}": all_columns.where(F.col("column") == c).drop("column") for c in first}
    if len(first) >= 2:
        out["scatter"] = scatter_data(df, first, by=by, key=key)
    return out
