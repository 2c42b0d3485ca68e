"""Cleaning steps and the recipe on small hand-made frames."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions.text import WHITESPACE, snake_case
from tabloom.operators import clean
from tabloom.operators.clean import FittedStep
from tabloom.operators.quantiles import exact_quantiles, grouped_quantiles
from tabloom.plans.recipe import CleanRecipe, FittedRecipe


def rows(df):
    return [tuple(r) for r in df.collect()]


def pandas_quantile(values, p):
    values = sorted(values)
    pos = p * (len(values) - 1)
    low, high = math.floor(pos), math.ceil(pos)
    if values[low] == values[high]:
        return values[low]
    return values[low] + (values[high] - values[low]) * (pos - low)


@pytest.mark.parametrize("kind", ["uniform", "heavy", "ties", "tiny", "inf"])
def test_exact_quantiles_against_sorting(spark, kind):
    rnd = random.Random(7)
    n = 20000
    values = {
        "uniform": lambda: [rnd.uniform(-5, 5) for _ in range(n)],
        "heavy": lambda: [rnd.choice([-1, 1]) * math.exp(rnd.gauss(0, 12)) for _ in range(n)],
        "ties": lambda: [3.0] * (n // 3) + [float(rnd.randrange(50)) for _ in range(n)],
        "tiny": lambda: [2.0, 1.0],
        "inf": lambda: [float("inf")] * 5 + [-float("inf")] * 3 + [1.0, 2.0, 3.0, 4.0],
    }[kind]()
    df = spark.createDataFrame(
        [(v,) for v in values] + [(None,), (float("nan"),)], "x double"
    ).repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["x"], probs)["x"]
    assert got == pytest.approx([pandas_quantile(values, p) for p in probs], rel=1e-12, nan_ok=True)


def test_exact_quantiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [1.0]}


def test_grouped_quantiles_with_a_hot_group(spark):
    rnd = random.Random(3)
    data = [("hot", rnd.gauss(0, 100)) for _ in range(9000)]
    data += [("b", float(rnd.randrange(5))) for _ in range(300)] + [(None, 7.0), ("c", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(4)
    got = {(r.g, r.p): r.quantile for r in grouped_quantiles(df, ["g"], "x", [0.25, 0.5, 0.9]).collect()}
    for g in ("hot", "b", None):
        values = [x for k, x in data if k == g and x is not None]
        for p in (0.25, 0.5, 0.9):
            assert got[g, p] == pytest.approx(pandas_quantile(values, p))
    assert len(got) == 9


def test_drop_high_null_at_the_threshold(spark):
    df = spark.createDataFrame(
        [(1, None, None, float("nan")), (2, 1, None, float("nan"))],
        "a int, half int, gone int, nan double",
    )
    out, change = clean.drop_high_null(df)
    assert out.columns == ["a"] and change["cols_removed"] == 3
    assert clean.drop_high_null(df.limit(0))[0].columns == []


def test_deduplicate_full_row_and_subset(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, "a"), (3, None), (4, None), (4, None)], "id int, t string"
    )
    assert clean.deduplicate(df)[1]["rows_removed"] == 1
    out, change = clean.deduplicate(df, subset=["t"], order_by="id")
    assert sorted(r.id for r in out.collect()) == [1, 3] and change["rows_removed"] == 3
    with pytest.raises(ValueError):
        clean.deduplicate(df, subset=["t"])


def test_subset_dedup_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 2)
    plan = clean.deduplicate(df, subset=["k"], order_by="id")[0]
    text = plan._jdf.queryExecution().executedPlan().toString()
    below_exchange = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in below_exchange


def test_impute(spark):
    df = spark.createDataFrame(
        [
            (1, 1.0, "b", True, None, None),
            (2, float("nan"), "a", True, None, None),
            (None, 3.0, "b", None, None, None),
            (5, None, "a", False, None, None),
            (None, 4.0, None, None, None, None),
        ],
        "i int, f double, s string, b boolean, n double, e string",
    )
    out, change = clean.impute_missing(df)
    assert rows(out)[4] == (2.0, 4.0, "a", True, None, "")
    assert [r.f for r in out.collect()] == [1.0, 3.0, 3.0, 3.0, 4.0]
    assert change["imputed_cells"] == 2 + 2 + 1 + 2 + 5 + 5
    assert dict(out.dtypes)["i"] == "double"


def test_impute_leaves_complete_tables_alone(spark):
    df = spark.createDataFrame([(1, "x")], "i int, s string")
    step = clean.fit_impute(df)
    assert step.params == {"medians": {}, "modes": {}} and dict(step.transform(df).dtypes)["i"] == "int"


def test_text_steps(spark):
    df = spark.createDataFrame(
        [(WHITESPACE + "Ab c" + WHITESPACE,), (" N/A ",), ("--",), (None,), ("nan",), ("ok",)], "s string"
    )
    out, change = clean.strip_whitespace(df)
    assert [r.s for r in out.collect()] == ["Ab c", "N/A", "--", None, "nan", "ok"]
    assert change["stripped_cells"] == 2
    out, change = clean.replace_placeholder_nulls(df)
    assert [r.s is None for r in out.collect()] == [False, True, True, True, False, False]
    assert change["nulled_cells"] == 2
    out, change = clean.lowercase_text(df)
    assert out.collect()[1].s == " n/a " and change["lowercased_cells"] == 2


def test_remove_empty_rows(spark):
    df = spark.createDataFrame(
        [(1, None), (None, None), (None, float("nan")), (None, 2.0)], "a int, b double"
    )
    out, change = clean.remove_empty_rows(df)
    assert out.count() == 2 and change["rows_removed"] == 2
    assert clean.remove_empty_rows(df, subset=["a"])[0].count() == 1


def test_parse_dates(spark):
    df = spark.createDataFrame(
        [
            ("2024-01-31", "2024-01-31", "31/01/2024", None, "x", "2024-01-31 10:00:00"),
            ("2024-02-01", "oops", "01/02/2024", "2024-01-01", "y", None),
            ("2024-02-02", "2024-02-02", "2/2/24", None, "z", "2024-01-31 11:30:00"),
        ],
        "ok string, bad string, mixed string, sparse string, text string, ts string",
    )
    out, change = clean.parse_dates(df)
    types = dict(out.dtypes)
    assert types["ok"] == types["ts"] == "timestamp_ntz"
    assert [types[c] for c in ("bad", "mixed", "sparse", "text")] == ["string"] * 4
    assert change["parsed_columns"] == 2
    assert out.collect()[0].ok == dt.datetime(2024, 1, 31)


def test_parse_dates_sees_rows_beyond_the_first_look(spark):
    df = spark.range(0, 3000, 1, 4).select(
        F.when(F.col("id") == 2999, "never").otherwise("2024-01-01").alias("d")
    )
    assert dict(clean.parse_dates(df)[0].dtypes) == {"d": "string"}


def test_outliers_in_sequence_and_in_one_pass(spark):
    a = [float(i % 7) for i in range(60)] + [1000.0, 3.0]
    b = [float(i % 9) for i in range(60)] + [5000.0, 40.0]
    df = spark.createDataFrame(list(zip(range(62), a, b)), "id string, a double, b double")

    def keep(values, live):
        xs = [values[i] for i in live]
        m = sum(xs) / len(xs)
        s = math.sqrt(sum((x - m) ** 2 for x in xs) / (len(xs) - 1))
        return [i for i in live if not abs((values[i] - m) / s) > 3]

    everything = list(range(62))
    in_turn = keep(b, keep(a, everything))
    at_once = sorted(set(keep(a, everything)) & set(keep(b, everything)))
    assert in_turn != at_once
    out, change = clean.remove_outliers(df)
    assert sorted(int(r.id) for r in out.collect()) == in_turn
    assert change["rows_removed"] == 62 - len(in_turn)
    out, _ = clean.remove_outliers(df, one_pass=True)
    assert sorted(int(r.id) for r in out.collect()) == at_once


def test_outliers_skip_columns_with_few_values_and_keep_nulls(spark):
    df = spark.createDataFrame(
        [(1.0, None)] * 100 + [(50.0, 1.0)], "few double, nulls double"
    )
    out, change = clean.remove_outliers(df)
    assert out.count() == 101 and change["rows_removed"] == 0


def test_snake_case(spark):
    assert snake_case(" Sepal Length (cm) ") == "sepal_length_cm"
    assert snake_case("__A--b__c.d") == "a_b_c_d" and snake_case("%%%") == ""
    df = spark.createDataFrame([(1, 2, 3)], "` a ` int, A int, `x.y` int")
    out, change = clean.rename_to_snake_case(df)
    assert out.columns == ["a", "x_y"] and rows(out) == [(1, 3)] and change["renamed_columns"] == 3


def test_recipe_order_audit_and_reuse(spark):
    df = spark.createDataFrame(
        [
            (1, " A ", "n/a", None, "2024-01-01"),
            (1, " A ", "n/a", None, "2024-01-01"),
            (2, "b", "x", None, "2024-01-02"),
            (3, "b", "x", 1.0, "2024-01-03"),
            (None, "c", "y", None, "2024-01-04"),
        ],
        "Id int, Name string, tag string, sparse double, day string",
    )
    recipe = CleanRecipe(
        replace_placeholder_nulls=True, lowercase_text=True, remove_empty_rows=True,
        remove_outliers=True, snake_case=True,
    )
    fitted, out = CleanRecipe.from_json(recipe.to_json()).fit_transform(df)
    assert [s.op for s in fitted.steps] == [
        "drop_high_null", "deduplicate", "remove_empty_rows", "replace_placeholder_nulls", "impute",
        "strip_whitespace", "lowercase_text", "parse_dates", "remove_outliers", "snake_case",
    ]
    got = sorted(rows(out))
    day = dt.datetime
    assert got == [
        (1.0, "a", "x", day(2024, 1, 1)),
        (2.0, "b", "x", day(2024, 1, 2)),
        (2.0, "c", "y", day(2024, 1, 4)),
        (3.0, "b", "x", day(2024, 1, 3)),
    ]
    again = FittedRecipe.from_json(fitted.to_json()).transform(df)
    assert sorted(rows(again)) == got
    log = {(r.op, r.metric): r.value for r in fitted.audit_log(spark).collect()}
    assert log["deduplicate", "rows_removed"] == 1 and log["drop_high_null", "cols_removed"] == 1
    assert log["impute", "imputed_cells"] == 2 and log["replace_placeholder_nulls", "nulled_cells"] == 1


def test_recipe_on_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, s string")
    fitted, out = CleanRecipe(drop_high_null=False, remove_outliers=True).fit_transform(df)
    assert out.count() == 0 and out.columns == ["a", "s"]


def test_step_json_round_trip(spark):
    step = clean.fit_impute(spark.createDataFrame([(None, "a"), (2.0, None)], "x double, s string"))
    assert FittedStep.from_json(step.to_json()) == step


def test_recipe_fitted_on_a_clean_table_fills_a_dirty_one(spark):
    fitted = CleanRecipe(deduplicate=False).fit(spark.createDataFrame([(1, 1.5, "a"), (4, 2.5, "a"), (9, 3.0, "b")], "i int, x double, s string"))
    dirty = spark.createDataFrame([(None, None, None), (7, 1.0, "c")], "i int, x double, s string")
    out = FittedRecipe.from_json(fitted.to_json()).transform(dirty)
    assert sorted(map(tuple, out.collect())) == [(4, 2.5, "a"), (7, 1.0, "c")]
    assert dict(out.dtypes)["i"] == "int"


def test_everyday_dates(spark):
    rows = [("1/5/2024", "5/1/2024 3:04 PM", "2024-01-05T10:00:00.123Z", "25/1/2024", "5.1.2024"),
            ("12/31/2023", "12/31/2023 11:59 AM", "2024-01-05T10:00:00Z", "1/2/2024", "31.12.2023")]
    out = clean.parse_dates(spark.createDataFrame(rows, "a string, b string, c string, d string, e string"))[0]
    assert {t for _, t in out.dtypes} == {"timestamp_ntz"}
    first = out.orderBy(F.desc("a")).first()
    assert [str(v) for v in first] == [
        "2024-01-05 00:00:00", "2024-05-01 15:04:00", "2024-01-05 10:00:00.123000", "2024-01-25 00:00:00", "2024-01-05 00:00:00",
    ]


def test_copies_in_a_stream_need_a_watermark(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="watermark"):
        clean.FittedStep("deduplicate", {"subset": None, "order_by": None}).transform(stream)


def test_audit_of_a_recipe_equals_the_audits_of_its_steps(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, None if i % 9 == 0 else f" V{i % 4} " if i % 5 else "n/a", None if i % 7 == 0 else float(i % 13 if i != 50 else 9999)) for i in range(200)]
        + [(None, None, None)] * 3,
        "id long, t string, x double",
    )
    recipe = CleanRecipe(
        remove_empty_rows=True, replace_placeholder_nulls=True, lowercase_text=True, remove_outliers=True, snake_case=True, impute=False
    )
    fitted, cleaned = recipe.fit_transform(rows)
    df, expected = rows, {}
    for step in (
        clean.drop_high_null, clean.deduplicate, clean.remove_empty_rows, clean.replace_placeholder_nulls, clean.strip_whitespace,
        clean.lowercase_text, clean.parse_dates, clean.remove_outliers, clean.rename_to_snake_case,
    ):
        df, expected[step.__name__] = step(df)
    got = {s.op: {**s.changes, "reason": s.reason} for s in fitted.steps}
    assert got == {("snake_case" if n == "rename_to_snake_case" else n): c for n, c in expected.items()}
    assert got["remove_empty_rows"]["rows_removed"] == 1 and got["remove_outliers"]["rows_removed"] == 1
    assert got["replace_placeholder_nulls"]["nulled_cells"] > 0 and got["strip_whitespace"]["stripped_cells"] > 0
    assert sorted(cleaned.collect()) == sorted(df.collect())


def test_audit_of_empty_tables(spark):
    recipe = CleanRecipe(drop_high_null=False, deduplicate=False, remove_empty_rows=True, lowercase_text=True, remove_outliers=True)
    empty = spark.createDataFrame([], "id long, t string")
    for df in (empty, spark.createDataFrame([(1, "a")], empty.schema).where("id > 5")):
        fitted = recipe.fit(df)
        assert [s.changes for s in fitted.steps if s.op in ("remove_empty_rows", "lowercase_text", "remove_outliers")] == [
            {"rows_removed": 0}, {"lowercased_cells": 0}, {"rows_removed": 0}
        ]


def test_audit_counts_in_one_job(spark, sf_dir):
    """Only drop_high_null, dates and the observation scan the table: text steps add no job of their own."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name", "c_mktsegment")
    tracker = spark.sparkContext.statusTracker()

    def jobs(**chosen):
        group = f"audit-{len(chosen)}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            CleanRecipe(drop_high_null=False, deduplicate=False, impute=False, parse_dates=False, **chosen).fit(rows)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    one = jobs(strip_whitespace=True)
    assert jobs(strip_whitespace=True, lowercase_text=True, replace_placeholder_nulls=True, remove_empty_rows=True) == one
