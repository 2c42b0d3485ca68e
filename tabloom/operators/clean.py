"""Cleaning steps as fit / transform pairs.

``fit(df)`` gathers what a step needs to know in as few aggregation jobs as it can and
returns a ``FittedStep``; ``FittedStep.transform(df)`` is a lazy plan of plain column
expressions (deduplication excepted, which shuffles once). Fitted steps serialise to JSON
and can be applied to other tables and to streams.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.text import is_placeholder, placeholder_to_null, snake_case, strip
from tabloom.operators.columns import rename_snake_case
from tabloom.operators.profile import duplicate_rows, fewer_values, most_frequent, row_keys
from tabloom.operators.quantiles import approx_medians, exact_medians
from tabloom.types import col, is_number, numeric_columns, present, text_columns, value

# Formats tried for text dates, in this order (month before day when both fit).
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "MM-dd-yyyy",
    "dd/MM/yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
    "yyyyMMdd",
    # one- and two-digit fields, clocks with AM and PM, fractions of any length, zone marks
    "yyyy-M-d",
    "yyyy-M-d H:mm[:ss]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSS][XXX]",
    "yyyy/M/d",
    "yyyy/M/d H:mm[:ss]",
    "M/d/yyyy",
    "M/d/yyyy H:mm[:ss]",
    "M/d/yyyy h:mm[:ss] a",
    "d/M/yyyy",
    "d/M/yyyy H:mm[:ss]",
    "d/M/yyyy h:mm[:ss] a",
    "M-d-yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "d.M.yyyy H:mm[:ss]",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
]


@dataclass
class FittedStep:
    op: str
    params: dict = field(default_factory=dict)
    changes: dict = field(default_factory=dict)  # metric -> count
    reason: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        return TRANSFORMS[self.op](df, **self.params)

    def to_json(self) -> str:
        return json.dumps(
            {"op": self.op, "params": self.params, "changes": self.changes, "reason": self.reason}
        )

    @classmethod
    def from_json(cls, text: str) -> "FittedStep":
        return cls(**json.loads(text))


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def _replace(df: DataFrame, new: dict) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def _counts(df: DataFrame, exprs: list) -> list[int]:
    return [int(v or 0) for v in df.agg(*exprs).first()] if exprs else []


def changes(step: FittedStep, df: DataFrame) -> tuple[str, Column] | None:
    """What a fitted step counts for the audit, as a metric and an aggregate over the rows it is given.

    None for steps whose changes are known from fitting. An aggregate of plain expressions, so
    that the counts of consecutive steps can be observed in one job.
    """
    if step.op == "remove_empty_rows":
        return "rows_removed", F.count_if(empty_row(df, step.params["subset"] or df.columns))
    if step.op == "remove_outliers":
        far = [beyond(df, c, mean, std, step.params["z"]) for c, mean, std in step.params["bounds"] if c in df.columns]
        return "rows_removed", F.count_if(reduce(lambda a, b: a | b, far, F.lit(False)))
    if step.op not in CHANGED_CELLS:
        return None
    metric, changed = CHANGED_CELLS[step.op]
    counts = [F.count_if(changed(col(c))) for c in _present(df, step.params["columns"])]
    return metric, reduce(lambda a, b: a + b, counts, F.lit(0))


def note(step: FittedStep, metric: str, number: int) -> None:
    step.changes[metric] = number
    if step.op == "replace_placeholder_nulls":
        step.reason = f"{number} cells only stood for a missing value"
    elif step.op == "remove_outliers":
        step.reason = f"{number} rows lie beyond {step.params['z']} deviations"


def _audited(step: FittedStep, df: DataFrame, audit: bool) -> FittedStep:
    if audit and (found := changes(step, df)):
        note(step, found[0], _counts(df, [found[1].alias("n")])[0])
    return step


# --- columns that are mostly missing -------------------------------------------------------


def fit_drop_high_null(df: DataFrame, threshold: float = 0.5) -> FittedStep:
    """Keep a column only if its null share is below the threshold (equal is dropped)."""
    row = df.agg(
        F.count("*"), *[F.count_if(value(df, c).isNull()) for c in df.columns]
    ).first()
    keep = [c for c, nulls in zip(df.columns, row[1:]) if row[0] and nulls / row[0] < threshold]
    drop = [c for c in df.columns if c not in keep]
    return FittedStep(
        "drop_high_null",
        {"drop": drop},
        {"cols_removed": len(drop)},
        f"null share of {threshold:.0%} or more: {len(drop)} columns",
    )


def _drop_columns(df: DataFrame, drop: list[str]) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c not in drop])


# --- duplicate and empty rows --------------------------------------------------------------


def fit_deduplicate(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    order_by: str | None = None,
    audit: bool = True,
) -> FittedStep:
    """Full-row duplicates, or the row with the smallest ``order_by`` per subset value."""
    if subset and not order_by:
        raise ValueError("keep-first on a subset needs order_by, the column that orders the rows")
    step = FittedStep(
        "deduplicate",
        {"subset": list(subset) if subset else None, "order_by": order_by},
        reason="one row kept of each set of equals",
    )
    if audit:
        # counted by the keys alone, without moving whole rows
        step.changes["rows_removed"] = duplicate_rows(df, subset).first()["duplicates"]
    return step


def _deduplicate(df: DataFrame, subset: list[str] | None, order_by: str | None) -> DataFrame:
    if df.isStreaming:
        raise ValueError("copies in a stream need a watermark: use streaming.apply.clean_stream")
    if not subset:
        return df.distinct()  # hashed, and combined before the shuffle
    # a limit on row_number is applied before the shuffle too, so that every map task sends
    # one row per value and a value held by a third of the table does not load one reducer;
    # long text is compared by its digest
    keys = row_keys(df, subset)
    first = Window.partitionBy(*keys).orderBy(col(order_by))
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def fit_remove_empty_rows(
    df: DataFrame, subset: Sequence[str] | None = None, audit: bool = True
) -> FittedStep:
    step = FittedStep(
        "remove_empty_rows",
        {"subset": list(subset) if subset else None},
        reason="rows without any value",
    )
    return _audited(step, df, audit)


def empty_row(df: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [~present(df, c) for c in names]) if names else F.lit(False)


def _remove_empty_rows(df: DataFrame, subset: list[str] | None) -> DataFrame:
    return df.dropna(how="all", subset=subset)


# --- missing values ------------------------------------------------------------------------


def fit_replace_placeholder_nulls(df: DataFrame, audit: bool = True) -> FittedStep:
    return _audited(FittedStep("replace_placeholder_nulls", {"columns": text_columns(df)}), df, audit)


def _replace_placeholder_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {c: placeholder_to_null(col(c)) for c in _present(df, columns)})


def exact_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column as text, the smallest of equals, nulls skipped."""
    return {c: top.value for c, top in most_frequent(df, list(cols)).items()}


def fit_impute(df: DataFrame, approximate: bool = False, fill_all: bool = False) -> FittedStep:
    """Numbers get their median, everything else its mode ('' for text without values).

    Only columns with missing cells are examined unless ``fill_all`` asks for fill values
    of every column (as rows need that were not seen here). Numbers without gaps here keep their
    type; where another table has gaps in them, whole numbers take the rounded median.
    """
    nulls = dict(zip(df.columns, _counts(df, [F.count_if(value(df, c).isNull()) for c in df.columns])))
    wanted = [c for c in df.columns if fill_all or nulls[c]]
    numeric = [c for c in wanted if is_number(df.schema[c].dataType)]
    other = [c for c in wanted if c not in numeric]
    medians = (approx_medians if approximate else exact_medians)(df, numeric)
    modes = exact_modes(df, other)
    for c in other:
        if modes[c] is None and isinstance(df.schema[c].dataType, T.StringType):
            modes[c] = ""
    total = sum(nulls.values())
    params = {"medians": medians, "modes": modes}
    if fill_all:
        params["complete"] = [c for c in numeric if not nulls[c]]
    return FittedStep(
        "impute",
        params,
        {"imputed_cells": total},
        f"{total} gaps filled with median or mode",
    )


def _impute(df: DataFrame, medians: dict, modes: dict, complete: Sequence[str] = ()) -> DataFrame:
    new = {}
    for c in _present(df, medians):
        dtype = df.schema[c].dataType
        if c in complete:
            fill = F.lit(medians[c]).cast("double")
            whole = isinstance(dtype, T.IntegralType)
            new[c] = F.coalesce(value(df, c), (F.round(fill) if whole else fill).cast(dtype))
            continue
        x = value(df, c).cast("double")
        new[c] = x if medians[c] is None else F.coalesce(x, F.lit(float(medians[c])))
    for c in _present(df, modes):
        if modes[c] is not None:
            new[c] = F.coalesce(col(c), F.lit(modes[c]).cast(df.schema[c].dataType))
    return _replace(df, new)


# --- text ----------------------------------------------------------------------------------


def _fit_text(op: str, reason: str):
    def fit(df: DataFrame, audit: bool = True) -> FittedStep:
        return _audited(FittedStep(op, {"columns": text_columns(df)}, reason=reason), df, audit)

    return fit


fit_strip_whitespace = _fit_text("strip_whitespace", "blanks cut at both ends")
fit_lowercase_text = _fit_text("lowercase_text", "letters made lower case")

#: What steps on single cells count: their metric and whether they change a cell.
CHANGED_CELLS = {
    "replace_placeholder_nulls": ("nulled_cells", is_placeholder),
    "strip_whitespace": ("stripped_cells", lambda c: strip(c) != c),
    "lowercase_text": ("lowercased_cells", lambda c: F.lower(c) != c),
}


def _strip_whitespace(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {c: strip(col(c)) for c in _present(df, columns)})


def _lowercase_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {c: F.lower(col(c)) for c in _present(df, columns)})


# --- dates ---------------------------------------------------------------------------------


def fit_parse_dates(
    df: DataFrame, formats: Sequence[str] = DATE_FORMATS, min_share: float = 0.5
) -> FittedStep:
    """A text column becomes a timestamp if one format reads all its values and more than
    half of all rows have a value.

    Every value must fit, so a format that fails on any row is out: a first look at a few
    rows removes nearly all (column, format) pairs before the job over the whole table.
    """
    names = text_columns(df)
    pairs = [(c, f) for c in names for f in formats]

    def failures(c: str, f: str):
        return F.count_if(col(c).isNotNull() & F.try_to_timestamp(col(c), F.lit(f)).isNull())

    look = df.select(*[col(c) for c in names]).limit(200) if names else df
    pairs = [p for p, bad in zip(pairs, _counts(look, [failures(*p) for p in pairs])) if not bad]
    chosen: dict[str, str] = {}
    if pairs:
        live = list(dict.fromkeys(c for c, _ in pairs))
        row = _counts(
            df, [F.count("*"), *[F.count(col(c)) for c in live], *[failures(*p) for p in pairs]]
        )
        filled = dict(zip(live, row[1:]))
        for (c, f), bad in zip(pairs, row[1 + len(live) :]):
            if not bad and filled[c] > min_share * row[0]:
                chosen.setdefault(c, f)
    return FittedStep(
        "parse_dates",
        {"formats": chosen},
        {"parsed_columns": len(chosen)},
        f"{len(chosen)} columns read as points in time",
    )


def _parse_dates(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    new = {
        c: F.try_to_timestamp(col(c), F.lit(formats[c])).cast("timestamp_ntz")
        for c in _present(df, formats)
    }
    return _replace(df, new)


# --- outliers ------------------------------------------------------------------------------

MIN_DISTINCT = 5


def _spread(df: DataFrame, c: str) -> list:
    x = value(df, c).cast("double")
    return [F.avg(x), F.stddev_samp(x), F.approx_count_distinct(x)]


def beyond(df: DataFrame, c: str, mean: float, std: float, z: float) -> Column:
    distance = F.abs((value(df, c).cast("double") - F.lit(mean)) / F.lit(std))
    return F.coalesce(distance > z, F.lit(False))


def fit_remove_outliers(
    df: DataFrame, z_threshold: float = 3.0, one_pass: bool = False, audit: bool = True
) -> FittedStep:
    """Bounds |x - mean| / std <= z for numeric columns with more than five values.

    Columns are taken in order and each sees the rows the earlier ones left, which needs
    one aggregation per column over a scan with literal filters. ``one_pass`` uses the
    statistics of the unfiltered table for every column and needs one aggregation in all.
    """
    names = numeric_columns(df)
    bounds: list[list] = []
    rows = df
    if one_pass and names:
        stats = df.agg(*[F.struct(*_spread(df, c)).alias(f"s{i}") for i, c in enumerate(names)]).first()
        spreads = [tuple(s) for s in stats]
    for i, c in enumerate(names):
        mean, std, estimate = spreads[i] if one_pass else rows.agg(*_spread(rows, c)).first()
        if not std or std != std or fewer_values(df if one_pass else rows, c, MIN_DISTINCT + 1, estimate):
            continue
        bounds.append([c, mean, std])
        rows = rows.where(~beyond(rows, c, mean, std, z_threshold))
    return _audited(FittedStep("remove_outliers", {"bounds": bounds, "z": z_threshold}), df, audit)


def _remove_outliers(df: DataFrame, bounds: list, z: float) -> DataFrame:
    for c, mean, std in bounds:
        if c in df.columns:
            df = df.where(~beyond(df, c, mean, std, z))
    return df


# --- names ---------------------------------------------------------------------------------


def fit_snake_case(df: DataFrame) -> FittedStep:
    renamed = [c for c in df.columns if snake_case(c) != c]
    return FittedStep(
        "snake_case",
        {},
        {"renamed_columns": len(renamed)},
        f"{len(renamed)} names made lower case with underscores",
    )


TRANSFORMS: dict[str, Callable[..., DataFrame]] = {
    "drop_high_null": _drop_columns,
    "deduplicate": _deduplicate,
    "remove_empty_rows": _remove_empty_rows,
    "replace_placeholder_nulls": _replace_placeholder_nulls,
    "impute": _impute,
    "strip_whitespace": _strip_whitespace,
    "lowercase_text": _lowercase_text,
    "parse_dates": _parse_dates,
    "remove_outliers": _remove_outliers,
    "snake_case": rename_snake_case,
}


def _direct(fit: Callable[..., FittedStep], name: str):
    def clean(df: DataFrame, *args, **kwargs) -> tuple[DataFrame, dict]:
        step = fit(df, *args, **kwargs)
        return step.transform(df), {**step.changes, "reason": step.reason}

    clean.__name__ = name
    clean.__doc__ = f"{fit.__doc__ or ''}\n\nFits and applies the step: (cleaned, changes)."
    return clean


drop_high_null = _direct(fit_drop_high_null, "drop_high_null")
deduplicate = _direct(fit_deduplicate, "deduplicate")
remove_empty_rows = _direct(fit_remove_empty_rows, "remove_empty_rows")
replace_placeholder_nulls = _direct(fit_replace_placeholder_nulls, "replace_placeholder_nulls")
impute_missing = _direct(fit_impute, "impute_missing")
strip_whitespace = _direct(fit_strip_whitespace, "strip_whitespace")
lowercase_text = _direct(fit_lowercase_text, "lowercase_text")
parse_dates = _direct(fit_parse_dates, "parse_dates")
remove_outliers = _direct(fit_remove_outliers, "remove_outliers")
rename_to_snake_case = _direct(fit_snake_case, "rename_to_snake_case")
