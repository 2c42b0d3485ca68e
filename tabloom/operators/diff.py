"""What differs between two versions of a table.

Rows are compared by a digest first. Equal rows of the two versions cancel each other out in one
aggregation, and only what is left is looked up again, so that the cost of comparing cells follows from
the differences and not from the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import stage
from tabloom.types import col, is_float

#: Points in time in full precision.
_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def row_digest(cells: Sequence[Column]) -> Column:
    """SHA-256 of the cells with their places, so that nulls and borders can't be confused."""
    whole = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    return F.unhex(F.sha2(F.to_json(whole, _JSON).cast("binary"), 256))


@dataclass
class TableDiff:
    """``rows``: the key columns, change, n_old, n_new. ``cells``: the key columns, column, before, after.
    ``columns``: column, change, type_before, type_after."""

    rows: DataFrame
    cells: DataFrame
    columns: DataFrame


def _columns(old: DataFrame, new: DataFrame) -> DataFrame:
    before, after = ({f.name: f.dataType.simpleString() for f in d.schema} for d in (old, new))
    found = []
    for c in dict.fromkeys([*before, *after]):
        a, b = before.get(c), after.get(c)
        if a != b:
            found.append((c, "added" if a is None else "removed" if b is None else "retyped", a, b))
    kind = "column string, change string, type_before string, type_after string"
    return old.sparkSession.createDataFrame(found, kind)


def _cells(df: DataFrame, names: Sequence[str], other: DataFrame) -> list[Column]:
    """Cells as they are compared: -0.0 as 0.0, and as text where the types differ."""
    out = []
    for c in names:
        kind = df.schema[c].dataType
        cell = col(c) + F.lit(0.0).cast(kind) if is_float(kind) else col(c)
        out.append(cell.cast("string") if kind != other.schema[c].dataType else cell)
    return out


def _counted(old: DataFrame, new: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(k0, k1, ..., digest, n_old, n_new) of rows that the versions don't have equally often."""
    sides = []
    for side, df, other in ((1, old, new), (0, new, old)):
        cells = _cells(df, [*keys, *names], other)
        own = [c.alias(f"k{i}") for i, c in enumerate(cells[: len(keys)])]
        sides.append(df.select(*own, row_digest(cells).alias("digest"), F.lit(side).alias("old")))
    both = sides[0].unionAll(sides[1])
    group = both.groupBy(*[f"k{i}" for i in range(len(keys))], "digest")
    counts = group.agg(F.sum("old").alias("n_old"), F.sum(1 - F.col("old")).alias("n_new"))
    return counts.where("n_old != n_new")


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in names])


def diff_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that one version has more often: the common columns of the old version's types, change, n.

    For tables without a key: ``change`` is "added" or "removed" and ``n`` the number of rows that were, so
    that repeated rows count. Nulls are equal to nulls, NaN to NaN and -0.0 to 0.0. Columns that only
    one version has are not compared. Empty tables are no special case.
    """
    names = [c for c in old.columns if c in new.columns]
    if not names:
        raise ValueError("the versions have no column in common")
    found = stage(_counted(old, new, [], names))
    parts = []
    for df, other, change, more in ((old, new, "removed", "n_old > n_new"), (new, old, "added", "n_new > n_old")):
        wanted = found.where(more).select("digest", F.abs(F.col("n_old") - F.col("n_new")).alias("_n"))
        digest = row_digest(_cells(df, names, other)).alias("_digest")
        rows = df.select(*[col(c) for c in names], digest)
        rows = rows.join(wanted, rows["_digest"] == wanted["digest"]).dropDuplicates(["_digest"])
        as_old = [col(c).cast(old.schema[c].dataType).alias(c) for c in names]
        parts.append(rows.select(*as_old, F.lit(change).alias("change"), F.col("_n").alias("n")))
    return parts[0].unionAll(parts[1])


def diff_tables(old: DataFrame, new: DataFrame, key: str | Sequence[str]) -> TableDiff:
    """Added, removed and changed rows by key, and the cells that changed.

    A key with exactly one differing row on each side is "changed", and its differing cells are
    listed as text. A key may repeat: equal rows of both versions cancel each other out first, and what is
    left of a key with several rows is "removed" (n_old rows) and "added" (n_new rows), since nothing says which
    belong together. A null key is a value like others. Nulls are equal to nulls, NaN to NaN, -0.0 to 0.0;
    columns that only one version has are listed in ``columns`` and not compared, and a column whose type
    differs is compared as text. A key with many rows is spread by their digests and only counted.
    """
    keys = [key] if isinstance(key, str) else list(key)
    for name, df in (("old", old), ("new", new)):
        if missing := [c for c in keys if c not in df.columns]:
            raise ValueError(f"the {name} version has no column {missing[0]}")
    names = [c for c in old.columns if c in new.columns and c not in keys]
    ks = [f"k{i}" for i in range(len(keys))]
    found = stage(_counted(old, new, keys, names))
    left, right = F.greatest(F.col("n_old") - F.col("n_new"), F.lit(0)), F.greatest(F.col("n_new") - F.col("n_old"), F.lit(0))
    by_key = found.groupBy(*ks).agg(F.sum(left).alias("n_old"), F.sum(right).alias("n_new"))
    by_key = stage(by_key)
    pair = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    change = F.when(pair, F.array(F.lit("changed"))).otherwise(
        F.array_compact(F.array(F.when(F.col("n_old") > 0, "removed"), F.when(F.col("n_new") > 0, "added")))
    )
    rows = by_key.select(*ks, F.explode(change).alias("change"), "n_old", "n_new")
    rows = rows.select(
        *[F.col(k).alias(c) for k, c in zip(ks, keys)],
        "change",
        F.when(F.col("change") != "added", F.col("n_old")).otherwise(0).alias("n_old"),
        F.when(F.col("change") != "removed", F.col("n_new")).otherwise(0).alias("n_new"),
    )
    changed = by_key.where(pair).select(*ks)
    digests = found.join(changed, _same(found, changed, ks), "left_semi")
    sides = []
    for df, other, more in ((old, new, "n_old > n_new"), (new, old, "n_new > n_old")):
        cells = _cells(df, [*keys, *names], other)
        # the compared cells and their digests; one of each is enough of equal rows
        own = df.select(*[c.alias(f"_k{i}") for i, c in enumerate(cells[: len(keys)])], *[c.alias(f"v{i}") for i, c in enumerate(cells[len(keys) :])], row_digest(cells).alias("_digest"))
        wanted = digests.where(more).select(*ks, "digest")
        own = own.join(wanted, own["_digest"] == wanted["digest"]).dropDuplicates(["_digest"])
        sides.append(own.select(*ks, *[f"v{i}" for i in range(len(names))]))
    a, b = sides[0].alias("a"), sides[1].alias("b")
    joined = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ks]))
    cell = [
        F.when(
            ~F.col(f"a.v{i}").eqNullSafe(F.col(f"b.v{i}")),
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"a.v{i}").cast("string").alias("before"),
                F.col(f"b.v{i}").cast("string").alias("after"),
            ),
        )
        for i, c in enumerate(names)
    ]
    none = F.array().cast("array<struct<column:string,before:string,after:string>>")
    cells = joined.select(*[F.col(f"a.{k}").alias(c) for k, c in zip(ks, keys)], F.inline(F.array_compact(F.array(*cell)) if cell else none))
    return TableDiff(rows, cells, _columns(old, new))
