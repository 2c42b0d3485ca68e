"""What a fitted recipe did to which cell, and why a row is gone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import snake_case
from tabloom.operators.clean import TRANSFORMS, FittedStep, beyond, empty_row
from tabloom.operators.profile import row_keys
from tabloom.plans.recipe import FittedRecipe
from tabloom.session import stage
from tabloom.types import col, is_number, value

_KEY, _CELLS, _GONE = "_trace_key", "_trace_cells", "_trace_gone"
_OWN = (_KEY, _CELLS, _GONE)
_CELL = "array<struct<step:int,op:string,column:string,before:string,after:string>>"
_ROW = "struct<step:int,op:string,reason:string,kept_key:{key}>"


@dataclass
class Trace:
    """``cells``: key, step, op, column, before, after. ``rows``: key, step, op, reason, kept_key."""

    cells: DataFrame
    rows: DataFrame
    result: DataFrame  # what the recipe makes of the table, with the key


def trace(recipe: FittedRecipe, df: DataFrame, key: str) -> Trace:
    """Apply ``recipe`` to ``df`` and keep, for every row, which steps changed or removed it.

    The changes of a row travel with it in one array, so that consecutive steps stay one
    projection; a removed row is marked and left alone by later steps. Only deduplication
    shuffles: the smallest row of each value is aggregated and joined back, without holding a value's
    rows together. The marked table is written once and backs all three results.

    ``key`` must tell the rows apart; it is no data, so deduplication of whole rows leaves it
    out and keeps the smallest key. Steps count from 1 as in the audit log, and ``column`` has
    the name that the cell had at that step. Cells are compared as values of their new type and
    given as text, nulls as nulls; a missing number (NaN) is no value. A cell that a step only gives another type (a whole number
    among imputed ones) has not changed, but text read as a time has. For outliers ``reason`` names the first column
    out of bounds; for copies ``kept_key`` is the row that stands for the removed one.
    Dropped and renamed columns are the same for all rows: see the audit log.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(
        "*",
        col(key).alias(_KEY),
        F.array().cast(_CELL).alias(_CELLS),
        F.lit(None).cast(_ROW.format(key=key_type)).alias(_GONE),
    )
    for number, step in enumerate(recipe.steps, 1):
        if step.op == "deduplicate":
            rows = _mark_copies(stage(rows) if number > 1 else rows, step, number, key)
        elif step.op in REASONS:
            rows = _mark(rows, step, number, REASONS[step.op](_data(rows), **step.params))
        elif step.op == "drop_high_null":
            rows = rows.drop(*[c for c in step.params["drop"] if c != key])
        elif step.op == "snake_case":
            rows, key = _rename(rows), snake_case(key)
        elif step.op in TRANSFORMS:
            rows = _change(rows, step, number)
        else:
            raise ValueError("a step given as code can't be followed cell by cell")
    marked = stage(rows)
    cells = marked.select(F.col(_KEY).alias("key"), F.inline(_CELLS))
    gone = marked.where(F.col(_GONE).isNotNull()).select(F.col(_KEY).alias("key"), f"{_GONE}.*")
    return Trace(cells, gone, marked.where(F.col(_GONE).isNull()).drop(*_OWN))


def _data(rows: DataFrame) -> DataFrame:
    return rows.drop(*_OWN)


def _bounds_left(df: DataFrame, bounds: list, z: float) -> Column:
    """The first column by which a row is out of bounds."""
    return F.coalesce(
        *[F.when(beyond(df, c, mean, std, z), c) for c, mean, std in bounds if c in df.columns],
        F.lit(None).cast("string"),
    )


def _no_value(df: DataFrame, subset: list[str] | None) -> Column:
    return F.when(empty_row(df, subset or df.columns), "no value")


#: Steps that remove rows one by one: why a row goes, null if it stays.
REASONS: dict[str, Callable[..., Column]] = {
    "remove_empty_rows": _no_value,
    "remove_outliers": _bounds_left,
}


def _mark(rows: DataFrame, step: FittedStep, number: int, reason: Column) -> DataFrame:
    kind = rows.schema[_GONE].dataType
    key_type = kind["kept_key"].dataType
    gone = F.struct(
        F.lit(number).alias("step"),
        F.lit(step.op).alias("op"),
        reason.alias("reason"),
        F.lit(None).cast(key_type).alias("kept_key"),
    ).cast(kind)
    fresh = F.col(_GONE).isNull() & reason.isNotNull()
    return rows.withColumn(_GONE, F.when(fresh, gone).otherwise(F.col(_GONE)))


def _mark_copies(rows: DataFrame, step: FittedStep, number: int, key: str) -> DataFrame:
    subset, order_by = step.params["subset"], step.params["order_by"]
    names = subset or [c for c in _data(rows).columns if c != key]
    keys = [k.alias(f"_trace_k{i}") for i, k in enumerate(row_keys(_data(rows), names))]
    least = F.min(_KEY)
    if subset and order_by != key:  # of equal places the smallest key
        least = F.min(F.struct(col(order_by).alias("place"), F.col(_KEY).alias("key")))["key"]
    there = rows.where(F.col(_GONE).isNull())
    first = there.groupBy(*keys).agg(least.alias("_trace_kept"))
    rows = rows.select("*", *keys)
    same = [rows[f"_trace_k{i}"].eqNullSafe(first[f"_trace_k{i}"]) for i in range(len(keys))]
    joined = rows.join(first, reduce(lambda a, b: a & b, same), "left").select(*[rows[c] for c in rows.columns], "_trace_kept")
    kind = rows.schema[_GONE].dataType
    gone = F.struct(
        F.lit(number).alias("step"),
        F.lit(step.op).alias("op"),
        F.lit("copy").alias("reason"),
        F.col("_trace_kept").alias("kept_key"),
    ).cast(kind)
    copy = F.col(_GONE).isNull() & (F.col(_KEY) != F.col("_trace_kept"))
    marked = joined.withColumn(_GONE, F.when(copy, gone).otherwise(F.col(_GONE)))
    return marked.drop("_trace_kept", *[f"_trace_k{i}" for i in range(len(keys))])


def _change(rows: DataFrame, step: FittedStep, number: int) -> DataFrame:
    """The step's own plan, run beside copies of the old columns under other names."""
    names = _data(rows).columns
    old = {c: f"_trace_b{i}" for i, c in enumerate(names)}
    # the hidden columns pass through: a step only touches the columns that it was fitted on
    after = step.transform(rows.select("*", *[col(c).alias(b) for c, b in old.items()]))
    cells = []
    for c in names:
        was, now = value(after, old[c]), value(after, c)
        before, kind = rows.schema[c].dataType, after.schema[c].dataType
        if before == kind:
            same = was.eqNullSafe(now)
        elif is_number(before):
            same = was.cast(kind).eqNullSafe(now)
        else:
            same = was.cast("string").eqNullSafe(now.cast("string"))
        cell = F.struct(
            F.lit(number).alias("step"),
            F.lit(step.op).alias("op"),
            F.lit(c).alias("column"),
            was.cast("string").alias("before"),
            now.cast("string").alias("after"),
        )
        cells.append(F.when(~same, cell))
    found = F.array_compact(F.array(*cells)).cast(_CELL)
    out = after.withColumn(_CELLS, F.when(F.col(_GONE).isNull(), F.concat(_CELLS, found)).otherwise(F.col(_CELLS)))
    return out.drop(*old.values())


def _rename(rows: DataFrame) -> DataFrame:
    """Snake-case names of the data; of names that become equal the first column stays."""
    first: dict[str, str] = {}
    for c in _data(rows).columns:
        first.setdefault(snake_case(c), c)
    return rows.select(*[col(c).alias(name) for name, c in first.items()], *_OWN)
