"""Recipes over many tables: failures, restarts, changes of sources and outputs."""

import os

import pytest

from tabloom.plans.many import Source, clean_tables, entry, fitted_recipe, read_cleaned
from tabloom.plans.recipe import CleanRecipe


def states(report):
    return {r.table: r.state for r in report.collect()}


@pytest.fixture
def sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1, x \n1, x \n2,\n3, x \n")
    (tmp_path / "bad.csv").write_text("")
    spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "k int, v double").write.parquet(str(tmp_path / "p.parquet"))
    return {
        "a": Source(str(tmp_path / "a.csv")),
        "p": Source(str(tmp_path / "p.parquet"), recipe=CleanRecipe(impute=False)),
        "bad": Source(str(tmp_path / "missing.parquet")),
    }


def test_a_failing_table_fails_alone_and_is_done_by_the_next_run(spark, tmp_path, sources):
    out = str(tmp_path / "out")
    first = clean_tables(spark, sources, out, at_once=2)
    assert states(first) == {"a": "done", "p": "done", "bad": "failed"}
    assert "missing.parquet" in first.where("table = 'bad'").first().error
    assert sorted(map(tuple, read_cleaned(spark, out, "a").collect())) == [(1, "x"), (2, "x"), (3, "x")]
    assert sorted(map(tuple, read_cleaned(spark, out, "p").collect())) == [(1, 2.0), (2, None), (3, 4.0)]
    assert entry(spark, out, "bad") is None
    with pytest.raises(ValueError, match="has not been cleaned"):
        read_cleaned(spark, out, "bad")

    spark.range(5).write.parquet(str(tmp_path / "missing.parquet"))
    paths = {n: entry(spark, out, n)["path"] for n in ("a", "p")}
    second = clean_tables(spark, sources, out)
    assert states(second) == {"a": "skipped", "p": "skipped", "bad": "done"}
    assert {r.table: r.rows for r in second.collect()} == {"a": 3, "p": 3, "bad": 5}
    assert {n: entry(spark, out, n)["path"] for n in ("a", "p")} == paths


def test_a_changed_source_or_recipe_is_done_again(spark, tmp_path, sources):
    out = str(tmp_path / "out")
    del sources["bad"]
    clean_tables(spark, sources, out)
    opened = read_cleaned(spark, out, "a")
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n3,z\n4,z\n")
    assert states(clean_tables(spark, sources, out)) == {"a": "done", "p": "skipped"}
    assert opened.count() == 3 and read_cleaned(spark, out, "a").count() == 4
    assert states(clean_tables(spark, sources, out, CleanRecipe(snake_case=True))) == {"a": "done", "p": "skipped"}
    assert len(os.listdir(f"{out}/a")) == 2 and len(os.listdir(f"{out}/p")) == 1


def test_an_interrupted_table_is_not_seen(spark, tmp_path, sources):
    out = str(tmp_path / "out")
    spark.range(3).write.parquet(f"{out}/p/half")
    assert entry(spark, out, "p") is None
    assert states(clean_tables(spark, {"p": sources["p"]}, out)) == {"p": "done"}
    assert not os.path.exists(f"{out}/p/half")


def test_a_failure_leaves_the_earlier_output(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(1,), (1,)], "k int")

    def broken(session):
        raise RuntimeError("no such source")

    assert states(clean_tables(spark, {"t": Source(load=lambda s: rows, version="1")}, out)) == {"t": "done"}
    later = clean_tables(spark, {"t": Source(load=broken, version="2")}, out)
    assert later.first().error == "RuntimeError: no such source"
    assert [tuple(r) for r in read_cleaned(spark, out, "t").collect()] == [(1,)]


def test_odd_tables_and_names(spark, tmp_path):
    out = str(tmp_path / "out")
    assert clean_tables(spark, {}, out).count() == 0
    empty = Source(load=lambda s: s.createDataFrame([], "a int, `b.c` string"), version="1", recipe=CleanRecipe(drop_high_null=False))
    nulls = Source(load=lambda s: s.createDataFrame([(None, None)] * 3, "a int, b string"), version="1")
    assert states(clean_tables(spark, {"empty": empty, "nulls": nulls}, out))["empty"] == "done"
    assert read_cleaned(spark, out, "empty").columns == ["a", "b.c"]
    with pytest.raises(ValueError, match="can't name a folder"):
        clean_tables(spark, {"../x": empty}, out)
    unversioned = clean_tables(spark, {"x": Source(load=lambda s: s.range(1))}, out)
    assert "needs a version" in unversioned.first().error


def test_the_fitted_recipe_applies_to_later_rows(spark, tmp_path, sources):
    out = str(tmp_path / "out")
    clean_tables(spark, {"a": sources["a"]}, out)
    later = spark.createDataFrame([(9, None), (8, " q ")], "id int, name string")
    assert sorted(map(tuple, fitted_recipe(spark, out, "a").transform(later).collect())) == [(8, "q"), (9, "x")]
