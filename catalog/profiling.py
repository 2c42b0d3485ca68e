from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog import query, rounded, table
from catalog.dirt import DIRTY_EVENTS, DIRTY_LINEITEM, dirty_events, dirty_lineitem, duck
from tabloom.operators import profile

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    """
WITH t AS (SELECT count(*) AS n, sum(strlen(event_type)) + sum(strlen(props)) AS chars FROM events),
     b AS (SELECT n, CAST(n * 32 + chars AS BIGINT) AS data_bytes FROM t)
SELECT n AS rows, CAST(6 AS INTEGER) AS columns, data_bytes,
       CASE WHEN data_bytes < 1024 THEN printf('%.1f bytes', data_bytes::DOUBLE)
            WHEN data_bytes < 1024 * 1024 THEN printf('%.1f KB', data_bytes / 1024.0::DOUBLE)
            WHEN data_bytes < 1024 * 1024 * 1024 THEN printf('%.1f MB', data_bytes / 1048576.0::DOUBLE)
            ELSE printf('%.1f GB', data_bytes / 1073741824.0::DOUBLE) END AS data_size,
       n - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS duplicates
FROM b"""
)
def profile_table(spark, folder):
    return profile.profile_table(table(spark, folder, "events"))


@query(
    f"""
WITH t AS {duck(DIRTY_LINEITEM)},
     m AS (
       SELECT 'l_quantity' AS "column", count(*) - count(l_quantity) AS missing, count(*) AS n FROM t
       UNION ALL SELECT 'l_extendedprice', count(*) - count(l_extendedprice), count(*) FROM t
       UNION ALL SELECT 'l_returnflag', count(*) - count(l_returnflag), count(*) FROM t
       UNION ALL SELECT 'l_orderkey', count(*) - count(l_orderkey), count(*) FROM t
       UNION ALL SELECT 'l_partkey', count(*) - count(l_partkey), count(*) FROM t)
SELECT "column", missing, round(100.0::DOUBLE * missing / n, 1) AS percent FROM m WHERE missing > 0"""
)
def profile_missing(spark, folder):
    return profile.profile_missing(dirty_lineitem(spark, folder))


def _column_sql(name: str, type_: str, details: str, source: str) -> str:
    return f"""SELECT '{name}' AS "column", '{type_}' AS type, count(DISTINCT {name}) AS "unique",
       count(*) - count({name}) AS nulls, {details} AS details FROM {source}"""


def _number(c: str) -> str:
    return (
        f"printf('min=%.2f, max=%.2f, mean=%.2f', min({c})::DOUBLE, max({c})::DOUBLE, avg({c})::DOUBLE)"
    )


def _frequent(c: str, source: str) -> str:
    top = f"SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 1"
    return f"(SELECT concat('top: ', substr(v, 1, 40), ', freq: ', n) FROM ({top}))"


@query(
    f"WITH t AS {duck(DIRTY_EVENTS)}\n"
    + "\nUNION ALL ".join(
        [
            _column_sql("event_id", "bigint", _number("event_id"), "t"),
            _column_sql("ts", "timestamp_ntz", "concat(min(ts)::VARCHAR, ' → ', max(ts)::VARCHAR)", "t"),
            _column_sql("user_id", "bigint", _number("user_id"), "t"),
            _column_sql("event_type", "string", _frequent("event_type", "t"), "t"),
            _column_sql("value", "double", _number("value"), "t"),
            _column_sql("sparse", "double", _number("sparse"), "t"),
            _column_sql("half", "double", _number("half"), "t"),
            _column_sql("day", "string", _frequent("day", "t"), "t"),
        ]
    )
)
def profile_columns(spark, folder):
    return profile.profile_columns(dirty_events(spark, folder))


@query(
    "\nUNION ALL ".join(
        [
            _column_sql("doc_id", "bigint", _number("doc_id"), "documents"),
            _column_sql("text", "string", _frequent("text", "documents"), "documents"),
            _column_sql("lang", "string", _frequent("lang", "documents"), "documents"),
            _column_sql("source", "string", _frequent("source", "documents"), "documents"),
            _column_sql("n_chars", "bigint", _number("n_chars"), "documents"),
        ]
    )
)
def profile_columns_text(spark, folder):
    return profile.profile_columns(table(spark, folder, "documents"))


@query(
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS duplicates
FROM events"""
)
def profile_duplicates(spark, folder):
    return profile.duplicate_rows(table(spark, folder, "events"), ["user_id", "event_type"])


@query(
    "SELECT a, b, correlation FROM (\n"
    + "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 3) AS correlation FROM lineitem"
        for a, b in combinations(
            ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS], 2
        )
    )
    + ") ORDER BY correlation DESC, a, b LIMIT 28"
)
def profile_correlations(spark, folder):
    # k covers all 28 pairs: a cut at 20 could fall between two pairs that round to one value
    return profile.profile_correlations(table(spark, folder, "lineitem"), k=28)


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50,
       quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c})::DOUBLE AS max FROM t"""
        if i
        else f"""WITH t AS {duck(DIRTY_LINEITEM)}
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50,
       quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c})::DOUBLE AS max FROM t"""
        for i, c in enumerate(["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"])
    )
)
def describe_numeric(spark, folder):
    out = profile.describe(dirty_lineitem(spark, folder))
    return out.select("column", "count", rounded("mean"), rounded("std"), "min", "p25", "p50", "p75", "max")


@query(
    "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, "
        + (f"CASE WHEN count({a}) > 1 THEN 1.0::DOUBLE END" if a == b else f"round(corr({a}, {b}), 6)")
        + " AS r FROM lineitem"
        for a in LINE_NUMBERS
        for b in LINE_NUMBERS
    )
)
def correlation_matrix(spark, folder):
    from tabloom.operators.explore import correlation_matrix as matrix

    return matrix(table(spark, folder, "lineitem"), LINE_NUMBERS).select("a", "b", F.round("r", 6).alias("r"))
