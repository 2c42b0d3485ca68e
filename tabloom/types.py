"""Column selectors by type, column roles and row keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column reference that also works for names with dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    return [
        f.name
        for f in df.schema
        if is_number(f.dataType) or (include_bool and isinstance(f.dataType, T.BooleanType))
    ]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_time(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is neither a number nor a point in time, booleans included."""
    return [f.name for f in df.schema if not is_number(f.dataType) and not is_time(f.dataType)]


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing, so that statistics skip it."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_float(df.schema[name].dataType) else c


def present(df: DataFrame, name: str) -> Column:
    """Whether the cell has a value, as a predicate that scans can use to skip data."""
    c = col(name)
    has = c.isNotNull()
    return has & ~F.isnan(c) if is_float(df.schema[name].dataType) else has


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if is_float(f.dataType)}
    if not floats:
        return df
    return df.select(*[value(df, n).alias(n) if n in floats else col(n) for n in df.columns])


def with_row_key(df: DataFrame, key: str = "_rid") -> DataFrame:
    """Stage ``df`` with a unique, increasing row number for tables that have no key.

    Row numbers depend on how the input is split, so the numbered table is written once
    and every later plan reads the written numbers.
    """
    from tabloom.session import stage

    return stage(df.withColumn(key, F.monotonically_increasing_id()))


@dataclass
class Roles:
    """Which columns are inputs, which are targets, and which to leave out."""

    features: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)

    @classmethod
    def all_columns(cls, df: DataFrame) -> "Roles":
        return cls(features=list(df.columns))
