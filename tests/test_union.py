"""Unions of tables with differing columns."""

import itertools

import pytest

from tabloom.operators.union import common_type, union_tables


def test_widening_never_loses_a_value(spark):
    limits = {"tinyint": 127, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1, "float": 16777217.0, "double": 0.1}
    for a, b in itertools.product(limits, limits):
        kind = common_type(a, b)
        assert kind == common_type(b, a)
        if kind:
            row = spark.sql(f"SELECT cast(cast({limits[a]!r} AS {a}) AS {kind}) AS x, cast({limits[a]!r} AS {a}) AS y").first()
            assert row.x == row.y
    assert common_type("bigint", "double") is None and common_type("int", "float") == "double"
    assert common_type("date", "timestamp_ntz") == "timestamp_ntz" and common_type("boolean", "int") is None


def test_report_and_rows(spark):
    a = spark.createDataFrame([(1, "x", 2**60)], "`My Key` int, only string, big long")
    b = spark.createDataFrame([(0.5, 2**40)], "big double, my_key long")
    c = spark.sql("SELECT null AS my_key")
    rows, report = union_tables({"a": a, "b": b, "c": c}, "src")
    assert rows.columns == ["src", "My Key", "only", "big"]
    assert sorted(map(tuple, rows.collect())) == [("a", 1, "x", str(2**60)), ("b", 2**40, None, "0.5"), ("c", None, None, None)]
    notes = {(r["column"], r["table"]): (r["result"], r["note"]) for r in report.collect()}
    assert notes["My Key", "a"] == ("bigint", "widened") and notes["My Key", "b"] == ("bigint", "same")
    assert notes["big", "a"] == ("string", "as text") and notes["only", "c"] == ("string", "absent")
    assert union_tables({"a": a.limit(0)})[0].collect() == []
    with pytest.raises(ValueError):
        union_tables({"a": spark.sql("SELECT 1 AS `A b`, 2 AS a_b")})
    with pytest.raises(ValueError):
        union_tables({"a": b}, "big")
