"""Provenance of cells and rows, differences of versions."""

import pytest
from pyspark.ml.feature import SQLTransformer

from tabloom.operators.diff import diff_rows, diff_tables
from tabloom.plans.provenance import trace
from tabloom.plans.recipe import CleanRecipe

ALL = CleanRecipe(
    subset=["name"], order_by="day", remove_empty_rows=True, replace_placeholder_nulls=True, lowercase_text=True, remove_outliers=True, snake_case=True, z_threshold=2.0
)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_trace_follows_the_recipe(spark):
    rows = [(k, f" N{k} ", float(k % 6), k % 4, "2024-01-0%d" % (1 + k % 7), None) for k in range(1, 13)]
    rows += [(13, " N1 ", 2.0, 1, "2024-01-01", None), (14, " n/a", float("nan"), None, "2024-01-02", None), (15, "Far", 900.0, 2, "2024-01-03", None)]
    df = spark.createDataFrame(rows, "id long, name string, `A value` double, whole int, day string, empty string")
    fitted, want = ALL.fit_transform(df)
    got = trace(fitted, df, "id")
    assert rows_of(got.result) == rows_of(want) and got.result.columns == want.columns
    steps = {s.op: n for n, s in enumerate(fitted.steps, 1)}
    cells = rows_of(got.cells)
    of = [c[2:] for c in cells if c[0] == 14]
    assert ("name", " n/a", None) in [c[1:] for c in of] and ("A value", None, "3.0") in [c[1:] for c in of]
    # whole numbers that stay the same number are no change, though the column became double
    assert [c[0] for c in cells if c[3] == "whole"] == [14]
    assert sorted(c[0] for c in cells if c[2] == "strip_whitespace") == [*range(2, 13), 13, 14]
    gone = {r["key"]: tuple(r)[1:] for r in got.rows.collect()}
    assert gone[1] == (steps["deduplicate"], "deduplicate", "copy", 13)  # of the earlier day
    assert gone[15][:3] == (steps["remove_outliers"], "remove_outliers", "A value")
    # a removed row has no changes from later steps
    assert not [c for c in cells if c[0] == 1]
    assert fitted.audit_log(spark).where("metric = 'rows_removed'").agg({"value": "sum"}).first()[0] == len(gone)


def test_trace_of_whole_row_copies_and_empty_rows(spark):
    rows = [(1, "a", None), (2, "a", None), (3, None, None), (4, None, None), (5, "b", 1.0)]
    df = spark.createDataFrame(rows, "id long, x string, y double")
    recipe = CleanRecipe(drop_high_null=False, impute=False, parse_dates=False, remove_empty_rows=True)
    got = trace(recipe.fit(df.drop("id")), df, "id")
    assert {r["key"]: r["kept_key"] for r in got.rows.where("op = 'deduplicate'").collect()} == {2: 1, 4: 3}
    # the key is data to the step that looks for empty rows: it has a value
    assert rows_of(got.result) == [(1, "a", None), (3, None, None), (5, "b", 1.0)]
    assert trace(recipe.fit(df), df.limit(0), "id").cells.collect() == []
    step = SQLTransformer(statement="SELECT * FROM __THIS__")
    with pytest.raises(ValueError):
        trace(recipe.fit(df, [step]), df, "id")


def test_trace_adds_no_scan_per_step(spark, tmp_path):
    df = spark.createDataFrame([(k, f" x{k % 9} ", float(k)) for k in range(90)], "id long, x string, y double")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    fitted = CleanRecipe(deduplicate=False, lowercase_text=True, replace_placeholder_nulls=True, remove_outliers=True).fit(df)
    plans = []
    import tabloom.plans.provenance as provenance

    kept, provenance.stage = provenance.stage, lambda d: plans.append(d) or kept(d)
    try:
        trace(fitted, df, "id")
    finally:
        provenance.stage = kept
    assert len(plans) == 1
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


OLD = [(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (None, "n", 4.0), (5, "r", 1.0), (5, "r", 1.0), (5, "s", 2.0), (6, "t", 0.0), (7, "u", float("nan"))]
NEW = [(1, "a", 1.0), (2, "B", None), (4, "d", 4.0), (None, "m", 4.0), (5, "r", 1.0), (5, "x", 2.0), (5, "y", 2.0), (6, "t", -0.0), (7, "u", float("nan"))]
DDL = "k long, x string, y double"


def test_diff_by_key(spark):
    got = diff_tables(spark.createDataFrame(OLD, DDL), spark.createDataFrame(NEW, DDL), "k")
    assert rows_of(got.rows) == sorted(
        [(2, "changed", 1, 1), (3, "removed", 1, 0), (4, "added", 0, 1), (None, "changed", 1, 1), (5, "removed", 2, 0), (5, "added", 0, 2)], key=repr
    )
    assert rows_of(got.cells) == sorted([(2, "x", "b", "B"), (2, "y", "2.0", None), (None, "x", "n", "m")], key=repr)
    assert got.columns.collect() == []


def test_diff_of_columns_and_types(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k long, x int, gone string")
    new = spark.createDataFrame([(1, "5", 1), (2, "7", 1)], "k long, x string, come int")
    got = diff_tables(old, new, ["k"])
    assert rows_of(got.cells) == [(2, "x", "6", "7")]
    assert rows_of(got.columns) == sorted([("x", "retyped", "int", "string"), ("gone", "removed", "string", None), ("come", "added", None, "int")])
    assert rows_of(diff_tables(old.limit(0), old, "k").rows) == [(1, "added", 0, 1), (2, "added", 0, 1)]
    assert diff_tables(old, old, "k").rows.collect() == []
    with pytest.raises(ValueError):
        diff_tables(old, new, "gone")


def test_diff_without_key(spark):
    old, new = spark.createDataFrame(OLD, DDL), spark.createDataFrame(NEW, DDL)
    got = rows_of(diff_rows(old, new))
    assert (5, "r", 1.0, "removed", 1) in got and (4, "d", 4.0, "added", 1) in got and (2, "B", None, "added", 1) in got
    assert sum(n for *_, change, n in got if change == "removed") == 5 and len(got) == 10
    assert diff_rows(old, old.repartition(5)).collect() == []
    # a row held by a third of the table is one group
    many = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) AS k", "'x' AS x")
    assert rows_of(diff_rows(many, many.where("k is not null"))) == [(None, "x", "removed", 1000)]
