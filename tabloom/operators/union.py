"""Union of tables whose columns differ in name, order and type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.text import snake_case
from tabloom.types import col

_WHOLE = ["tinyint", "smallint", "int", "bigint"]
_FLOAT = ["float", "double"]
#: Whole numbers that each floating type holds exactly.
_EXACT = {"float": _WHOLE[:2], "double": _WHOLE[:3]}


def common_type(a: str, b: str) -> str | None:
    """The smallest type that holds every value of both, None if only text does."""
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    for ladder in (_WHOLE, _FLOAT):
        if a in ladder and b in ladder:
            return max(a, b, key=ladder.index)
    whole, real = (a, b) if a in _WHOLE else (b, a)
    if whole in _WHOLE and real in _FLOAT:
        return next((f for f in _FLOAT[_FLOAT.index(real) :] if whole in _EXACT[f]), None)
    if {a, b} == {"date", "timestamp_ntz"}:
        return "timestamp_ntz"
    return None


def union_tables(tables: dict[str, DataFrame], source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of all tables, report). Columns match by their snake-case names; the first spelling stays.

    A column takes the smallest type that holds every value of its types, so that no value is lost: int and
    double give double, bigint and double, which doesn't hold all of them, give text, as do all types that have no
    common one. A table without a column has nulls there. The report has a row for each column and table: column, table,
    type (null if absent), result, note: "same", "widened", "as text" or "absent". ``source`` names a column
    for the table's name. Columns of one table whose names become equal raise. Narrow: no shuffle.
    """
    if not tables:
        raise ValueError("no tables")
    found: dict[str, dict[str, T.StructField]] = {}
    for name, df in tables.items():
        for f in df.schema:
            own = found.setdefault(snake_case(f.name), {})
            if name in own:
                raise ValueError(f"{name}: {own[name].name} and {f.name} are the same name")
            own[name] = f
    spelling = {c: next(iter(own.values())).name for c, own in found.items()}
    if source in spelling.values():
        raise ValueError(f"the tables already have a column {source}")
    result, report = {}, []
    for c, own in found.items():
        kinds = [f.dataType.simpleString() for f in own.values()]
        result[c] = reduce(lambda a, b: a and common_type(a, b), kinds) or "string"
        for name in tables:
            kind = own[name].dataType.simpleString() if name in own else None
            wider = all(common_type(k, result[c]) == result[c] for k in kinds)
            note = "absent" if kind is None else "same" if kind == result[c] else "widened" if wider else "as text"
            report.append((spelling[c], name, kind, result[c], note))
    parts = []
    for name, df in tables.items():
        cells = [(col(own[name].name) if name in own else F.lit(None)).cast(result[c]).alias(spelling[c]) for c, own in found.items()]
        parts.append(df.select(*([F.lit(name).alias(source)] if source else []), *cells))
    kind = "column string, table string, type string, result string, note string"
    return reduce(lambda a, b: a.unionAll(b), parts), next(iter(tables.values())).sparkSession.createDataFrame(report, kind)
