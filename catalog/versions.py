"""Provenance, differences of versions, drift and mergeable profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query, rounded, table
from catalog.cleaning import SPACES, TOKENS
from catalog.dirt import DIRTY_EVENTS, DIRTY_LINEITEM, dirty_events, dirty_lineitem, duck
from tabloom.operators import drift, partials
from tabloom.operators.diff import diff_rows, diff_tables
from tabloom.operators.union import union_tables
from tabloom.plans.provenance import trace
from tabloom.plans.recipe import CleanRecipe
from tabloom.session import checkpoint_dir
from tabloom.streaming.monitor import monitor, window_scores

#: Every step but the dropping of columns and the renaming, on events with one row per user and type.
RECIPE = CleanRecipe(
    subset=["user_id", "event_type"],
    order_by="event_id",
    replace_placeholder_nulls=True,
    lowercase_text=True,
    remove_outliers=True,
    audit=False,
)
TRACED = f"""WITH t AS {duck(DIRTY_EVENTS)},
 d AS (SELECT event_id, ts, user_id, event_type, value, day, min(event_id) OVER (PARTITION BY user_id, event_type) AS kept_key FROM t),
 k AS (SELECT * FROM d WHERE event_id = kept_key),
 p AS (SELECT *, CASE WHEN lower(trim(event_type, {SPACES})) IN ({TOKENS}) THEN NULL ELSE event_type END AS e4 FROM k),
 i AS (SELECT *, coalesce(e4, (SELECT e4 FROM p WHERE e4 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS e5,
   coalesce(value, (SELECT quantile_cont(value, 0.5) FROM p)) AS v5 FROM p),
 c AS (SELECT *, trim(e5, {SPACES}) AS e6, lower(trim(e5, {SPACES})) AS e7 FROM i)"""


@query(
    f"""{TRACED}
SELECT event_id AS key, 3 AS step, 'replace_placeholder_nulls' AS op, 'event_type' AS "column", event_type AS before, e4 AS after FROM c WHERE event_type IS DISTINCT FROM e4
UNION ALL SELECT event_id, 4, 'impute', 'event_type', e4, e5 FROM c WHERE e4 IS DISTINCT FROM e5
UNION ALL SELECT event_id, 4, 'impute', 'value', value::VARCHAR, v5::VARCHAR FROM c WHERE value IS DISTINCT FROM v5
UNION ALL SELECT event_id, 5, 'strip_whitespace', 'event_type', e5, e6 FROM c WHERE e5 <> e6
UNION ALL SELECT event_id, 6, 'lowercase_text', 'event_type', e6, e7 FROM c WHERE e6 <> e7
UNION ALL SELECT event_id, 7, 'parse_dates', 'day', day, day || ' 00:00:00' FROM c"""
)
def traced_cells(spark, folder):
    rows = dirty_events(spark, folder)
    return trace(RECIPE.fit(rows), rows, "event_id").cells


@query(
    f"""{TRACED},
 s1 AS (SELECT avg(event_id) AS m, stddev_samp(event_id) AS s FROM c),
 x1 AS (SELECT c.*, abs(event_id - m) / s > 3 AS out1 FROM c, s1),
 s2 AS (SELECT avg(user_id) AS m, stddev_samp(user_id) AS s FROM x1 WHERE NOT out1),
 x2 AS (SELECT x1.*, NOT out1 AND abs(user_id - m) / s > 3 AS out2 FROM x1, s2),
 s3 AS (SELECT avg(v5) AS m, stddev_samp(v5) AS s FROM x2 WHERE NOT out1 AND NOT out2),
 x3 AS (SELECT x2.*, NOT out1 AND NOT out2 AND abs(v5 - m) / s > 3 AS out3 FROM x2, s3)
SELECT event_id AS key, 2 AS step, 'deduplicate' AS op, 'copy' AS reason, kept_key FROM d WHERE event_id <> kept_key
UNION ALL SELECT event_id, 8, 'remove_outliers', CASE WHEN out1 THEN 'event_id' WHEN out2 THEN 'user_id' ELSE 'value' END, NULL FROM x3 WHERE out1 OR out2 OR out3"""
)
def traced_rows(spark, folder):
    rows = dirty_events(spark, folder)
    return trace(RECIPE.fit(rows), rows, "event_id").rows


@query(
    f"""WITH t AS {duck(DIRTY_LINEITEM)}, n AS (SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag FROM t),
 g AS (SELECT *, count(*) AS k FROM n GROUP BY ALL)
SELECT sum(k - 1)::BIGINT AS copies, count(*) AS kept FROM g"""
)
def traced_copies(spark, folder):
    """Copies of whole rows in a table without a key."""
    from tabloom.types import with_row_key

    rows = with_row_key(dirty_lineitem(spark, folder), "row")
    found = trace(CleanRecipe(impute=False, strip_whitespace=False, parse_dates=False, audit=False).fit(rows), rows, "row")
    copies = found.rows.where("kept_key < key").agg(F.count("*").alias("copies"))
    return copies.crossJoin(found.result.agg(F.count("*").alias("kept")))


def _versions(spark, folder):
    """Two versions of the orders: prices and states changed, orders removed, added and re-keyed."""
    old = table(spark, folder, "orders")
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    state = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    new = old.where("o_orderkey % 11 != 0").withColumns({"o_totalprice": price, "o_orderstatus": state})
    added = old.where("o_orderkey % 13 = 0").withColumn("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey")))
    return old, new.unionByName(added)


VERSIONS = """WITH o AS (SELECT * FROM orders),
 n AS (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
   CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus) FROM o WHERE o_orderkey % 11 <> 0
   UNION ALL SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey END AS o_orderkey) FROM o WHERE o_orderkey % 13 = 0)"""


@query(
    f"""{VERSIONS},
 c AS (SELECT o_orderkey, count(*) FILTER (side = 1) AS n_old, count(*) FILTER (side = 2) AS n_new
   FROM ((SELECT *, 1 AS side FROM (FROM o EXCEPT ALL FROM n)) UNION ALL (SELECT *, 2 AS side FROM (FROM n EXCEPT ALL FROM o))) GROUP BY 1)
SELECT o_orderkey, 'changed' AS change, n_old, n_new FROM c WHERE n_old = 1 AND n_new = 1
UNION ALL SELECT o_orderkey, 'removed', n_old, 0 FROM c WHERE n_old > 0 AND NOT (n_old = 1 AND n_new = 1)
UNION ALL SELECT o_orderkey, 'added', 0, n_new FROM c WHERE n_new > 0 AND NOT (n_old = 1 AND n_new = 1)"""
)
def version_rows(spark, folder):
    return diff_tables(*_versions(spark, folder), "o_orderkey").rows


@query(
    f"""{VERSIONS},
 j AS (SELECT o.o_orderkey, o.o_totalprice AS p1, n.o_totalprice AS p2, o.o_orderstatus AS s1, n.o_orderstatus AS s2 FROM o JOIN n USING (o_orderkey))
SELECT o_orderkey, 'o_totalprice' AS "column", p1::VARCHAR AS before, p2::VARCHAR AS after FROM j WHERE p1 <> p2
UNION ALL SELECT o_orderkey, 'o_orderstatus', s1, s2 FROM j WHERE s1 IS DISTINCT FROM s2"""
)
def version_cells(spark, folder):
    return diff_tables(*_versions(spark, folder), "o_orderkey").cells


@query(
    """WITH o AS (SELECT user_id % 50 AS u, event_type FROM events), n AS (SELECT user_id % 50 AS u, event_type FROM events WHERE event_id % 3 <> 0
   UNION ALL SELECT user_id % 7, 'new' FROM events WHERE event_id % 10 = 0)
SELECT u, event_type, 'removed' AS change, count(*) AS n FROM (FROM o EXCEPT ALL FROM n) GROUP BY ALL
UNION ALL SELECT u, event_type, 'added', count(*) FROM (FROM n EXCEPT ALL FROM o) GROUP BY ALL"""
)
def version_rows_keyless(spark, folder):
    events = table(spark, folder, "events")
    pick = lambda rows, by: rows.select((F.col("user_id") % by).alias("u"), "event_type")
    new = pick(events.where("event_id % 3 != 0"), 50)
    new = new.unionAll(pick(events.where("event_id % 10 = 0").withColumn("event_type", F.lit("new")), 7))
    return diff_rows(pick(events, 50), new)


def _moved(spark, folder):
    """Line items before 1995 in the order of their keys, and later ones with gaps, dearer and with an unlisted flag."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    later = rows.where("l_orderkey % 3 != 0").select(
        F.when(F.col("l_orderkey") % 10 != 1, F.col("l_quantity")).alias("l_quantity"),
        (F.col("l_extendedprice") * 1.5).alias("l_extendedprice"),
        F.when(F.col("l_orderkey") % 4 == 0, F.lit("new")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
    )
    return rows.where("l_orderkey % 3 = 0").drop("l_orderkey"), later


MOVED = """a AS (SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem WHERE l_orderkey % 3 = 0),
 b AS (SELECT CASE WHEN l_orderkey % 10 <> 1 THEN l_quantity END AS l_quantity, l_extendedprice * 1.5 AS l_extendedprice,
   CASE WHEN l_orderkey % 4 = 0 THEN 'new' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_orderkey % 3 <> 0)"""
SCORES = """round(sum((p - q) * ln(p / q)), 6) AS psi"""


@query(
    f"""WITH {MOVED},
 x AS (SELECT 'l_quantity' AS c, 1 AS side, l_quantity AS x FROM a UNION ALL SELECT 'l_quantity', 2, l_quantity FROM b
   UNION ALL SELECT 'l_extendedprice', 1, l_extendedprice FROM a UNION ALL SELECT 'l_extendedprice', 2, l_extendedprice FROM b),
 e AS (SELECT DISTINCT c, unnest(quantile_cont(x, [i / 10.0 FOR i IN range(1, 10)])) AS e FROM x WHERE side = 1 GROUP BY c),
 n AS (SELECT c, side, CASE WHEN x IS NULL THEN -1 ELSE (SELECT count(*) FROM e WHERE e.c = x.c AND e.e < x.x) END AS bin, count(*) AS n FROM x GROUP BY ALL),
 w AS (SELECT c, bin, coalesce(max(n) FILTER (side = 1), 0) AS old, coalesce(max(n) FILTER (side = 2), 0) AS new FROM n GROUP BY ALL),
 s AS (SELECT *, greatest(old / sum(old) OVER (PARTITION BY c), 1e-4) AS p, greatest(new / sum(new) OVER (PARTITION BY c), 1e-4) AS q,
   sum(old) FILTER (bin >= 0) OVER (PARTITION BY c ORDER BY bin) / sum(old) FILTER (bin >= 0) OVER (PARTITION BY c)
   - sum(new) FILTER (bin >= 0) OVER (PARTITION BY c ORDER BY bin) / sum(new) FILTER (bin >= 0) OVER (PARTITION BY c) AS apart FROM w)
SELECT c AS "column", {SCORES}, round(max(abs(apart)) FILTER (bin >= 0), 6) AS ks,
 CASE WHEN sum((p - q) * ln(p / q)) < 0.1 THEN 'stable' WHEN sum((p - q) * ln(p / q)) < 0.25 THEN 'moderate' ELSE 'major' END AS level,
 round(sum(new) FILTER (bin = -1) / sum(new), 6) AS missing_after, sum(new)::BIGINT AS n_after FROM s GROUP BY c"""
)
def drift_numbers(spark, folder):
    before, after = _moved(spark, folder)
    bins = drift.fit_bins(before, ["l_quantity", "l_extendedprice"], bins=10)
    found = drift.drift(after, drift.DriftBins.from_json(bins.to_json()))
    missing = F.nullif(F.round("missing_after", 6), F.lit(0.0)).alias("missing_after")
    return found.select("column", rounded("psi"), rounded("ks"), "level", missing, "n_after")


@query(
    f"""WITH {MOVED}, n AS (SELECT 1 AS side, l_returnflag AS v FROM a UNION ALL SELECT 2, CASE WHEN l_returnflag IN (SELECT l_returnflag FROM a) THEN l_returnflag ELSE '(unlisted)' END FROM b),
 w AS (SELECT v, count(*) FILTER (side = 1) AS old, count(*) FILTER (side = 2) AS new FROM n GROUP BY v),
 s AS (SELECT *, greatest(old / sum(old) OVER (), 1e-4) AS p, greatest(new / sum(new) OVER (), 1e-4) AS q FROM w)
SELECT 'l_returnflag' AS "column", {SCORES}, round(sum(new) FILTER (v = '(unlisted)') / sum(new), 6) AS unlisted_after FROM s"""
)
def drift_categories(spark, folder):
    before, after = _moved(spark, folder)
    bins = drift.fit_bins(before, ["l_returnflag"])
    return drift.drift(after, bins).select("column", rounded("psi"), rounded("unlisted_after"))


@query(
    """WITH t AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount, l_returnflag, l_shipdate FROM lineitem)
SELECT c AS "column", type, rows, nulls, mean, std, min, max, first, last FROM (
 SELECT 'l_quantity' AS c, 'number' AS type, count(*) AS rows, count(*) - count(l_quantity) AS nulls, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std,
  min(l_quantity) AS min, max(l_quantity) AS max, NULL AS first, NULL AS last FROM t
 UNION ALL SELECT 'l_extendedprice', 'number', count(*), count(*) - count(l_extendedprice), round(avg(l_extendedprice), 6), round(stddev_samp(l_extendedprice), 6), min(l_extendedprice), max(l_extendedprice), NULL, NULL FROM t
 UNION ALL SELECT 'l_discount', 'number', count(*), count(*) - count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), max(l_discount), NULL, NULL FROM t
 UNION ALL SELECT 'l_returnflag', 'text', count(*), count(*) - count(l_returnflag), NULL, NULL, NULL, NULL, min(l_returnflag), max(l_returnflag) FROM t
 UNION ALL SELECT 'l_shipdate', 'time', count(*), count(*) - count(l_shipdate), NULL, NULL, NULL, NULL, min(l_shipdate)::VARCHAR, max(l_shipdate)::VARCHAR FROM t)"""
)
def merged_profile(spark, folder):
    """The exact figures of a profile merged from the states of three parts."""
    gap = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")).alias("l_discount")
    rows = table(spark, folder, "lineitem")
    pick = lambda k: rows.where(F.col("l_orderkey") % 3 == k).select("l_quantity", "l_extendedprice", gap, "l_returnflag", "l_shipdate")
    parts = [partials.partial_profile(pick(k)) for k in range(3)]
    whole = partials.merge_profiles(parts[0].unionAll(parts[1]).unionAll(parts[2]))
    return partials.read_profile(whole).select("column", "type", "rows", "nulls", rounded("mean"), rounded("std"), "min", "max", "first", "last")


@query(
    """WITH a AS (SELECT o_totalprice AS x, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS y FROM orders WHERE o_orderstatus = 'F'),
 b AS (SELECT o_totalprice * 2 AS x, o_orderpriority AS y FROM orders WHERE o_orderstatus = 'O')
SELECT 'price' AS "column", (SELECT count(*) FROM a) AS rows_before, (SELECT count(*) FROM b) AS rows_after, 0.0::DOUBLE AS null_share_change,
 round(((SELECT avg(x) FROM b) - (SELECT avg(x) FROM a)) / (SELECT stddev_samp(x) FROM a), 6) AS mean_shift, true AS distinct_close
UNION ALL SELECT 'priority', (SELECT count(*) FROM a), (SELECT count(*) FROM b), round(-(SELECT 1 - count(y) / count(*) FROM a), 6), NULL, true"""
)
def compared_profiles(spark, folder):
    orders = table(spark, folder, "orders")
    gap = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority")
    before = orders.where("o_orderstatus = 'F'").select(F.col("o_totalprice").alias("price"), gap)
    after = orders.where("o_orderstatus = 'O'").select((F.col("o_totalprice") * 2).alias("price"), F.col("o_orderpriority").alias("priority"))
    both = partials.compare_profiles(partials.partial_profile(before), partials.partial_profile(after))
    exact = after.agg(F.count_distinct("price").alias("price"), F.count_distinct("priority").alias("priority"))
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in exact.columns])))
    close = (F.abs(F.col("distinct_after") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("distinct_close")
    return both.join(exact, "column").select("column", "rows_before", "rows_after", rounded("null_share_change"), rounded("mean_shift"), close)


def _differing(spark, folder):
    """Customers, suppliers and parts, with columns of other names, orders and types."""
    customer = table(spark, folder, "customer").selectExpr("c_custkey AS `Key`", "c_name AS name", "c_acctbal AS balance", "c_nationkey AS place")
    supplier = table(spark, folder, "supplier").selectExpr("cast(s_nationkey AS string) AS place", "cast(s_suppkey AS int) AS key", "cast(s_suppkey AS int) AS balance")
    part = table(spark, folder, "part").selectExpr("p_partkey AS key", "p_name AS name", "cast(p_size AS smallint) AS balance")
    return {"customer": customer, "supplier": supplier, "part": part}


@query(
    """SELECT 'customer' AS source, c_custkey AS "Key", c_name AS name, c_acctbal AS balance, c_nationkey::VARCHAR AS place FROM customer
UNION ALL SELECT 'supplier', s_suppkey, NULL, s_suppkey::DOUBLE, s_nationkey::VARCHAR FROM supplier
UNION ALL SELECT 'part', p_partkey, p_name, p_size::DOUBLE, NULL FROM part"""
)
def union_of_tables(spark, folder):
    return union_tables(_differing(spark, folder), "source")[0]


@query(
    f"""WITH a AS (SELECT event_type, value FROM events WHERE event_id % 3 = 0),
 t AS (SELECT ts, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS w, event_type, CASE WHEN event_id % 5 <> 1 THEN value END AS value
   FROM events WHERE event_id % 3 <> 0),
 g AS (SELECT w FROM t GROUP BY w HAVING (w + 1) * 604800 <= (SELECT epoch(max(ts)) - 86400 FROM t)),
 b AS (SELECT * FROM t WHERE w IN (SELECT w FROM g)),
 e AS (SELECT DISTINCT unnest(quantile_cont(value, [i / 10.0 FOR i IN range(1, 10)])) AS e FROM a),
 x AS (SELECT w, 'value' AS c, 1 AS side, value AS x, NULL AS v FROM a, g UNION ALL SELECT w, 'value', 2, value, NULL FROM b
   UNION ALL SELECT w, 'event_type', 1, 0, event_type FROM a, g UNION ALL SELECT w, 'event_type', 2, 0, event_type FROM b),
 n AS (SELECT w, c, v, side, CASE WHEN x IS NULL THEN -1 WHEN c = 'event_type' THEN 0 ELSE (SELECT count(*) FROM e WHERE e < x) END AS bin,
   count(*) AS n FROM x GROUP BY ALL),
 k AS (SELECT w, c, v, bin, coalesce(max(n) FILTER (side = 1), 0) AS old, coalesce(max(n) FILTER (side = 2), 0) AS new FROM n GROUP BY ALL),
 s AS (SELECT *, greatest(old / sum(old) OVER (PARTITION BY w, c), 1e-4) AS p, greatest(new / sum(new) OVER (PARTITION BY w, c), 1e-4) AS q,
   sum(old) FILTER (bin >= 0) OVER (PARTITION BY w, c ORDER BY bin) / sum(old) FILTER (bin >= 0) OVER (PARTITION BY w, c)
   - sum(new) FILTER (bin >= 0) OVER (PARTITION BY w, c ORDER BY bin) / sum(new) FILTER (bin >= 0) OVER (PARTITION BY w, c) AS apart FROM k)
SELECT make_timestamp(w * 604800 * 1000000)::DATE AS week, c AS "column", {SCORES},
 CASE WHEN c = 'value' THEN round(max(abs(apart)) FILTER (bin >= 0), 6) END AS ks,
 round(coalesce(sum(new) FILTER (bin = -1), 0) / sum(new), 6) AS missing_after, sum(new)::BIGINT AS n_after FROM s GROUP BY w, c"""
)
def stream_monitor(spark, folder):
    """Drift of a stream of events by week, against every third event; weeks that are still open a day before the last event are left out."""
    events = table(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    bins = drift.fit_bins(events.where("event_id % 3 = 0"), ["event_type", "value"], bins=10)
    base = f"{checkpoint_dir(spark).rstrip('/')}/monitor-{uuid.uuid4().hex}"
    arriving = events.where("event_id % 3 <> 0").withColumn("value", F.when(F.col("event_id") % 5 != 1, F.col("value")))
    arriving.write.parquet(f"{base}/in")
    source = spark.readStream.schema(arriving.schema).parquet(f"{base}/in")
    monitor(source, bins, "ts", f"{base}/out", f"{base}/progress", "7 days", "1 day", once=True).awaitTermination()
    found = window_scores(spark, f"{base}/out", bins)
    week = F.col("window_start").cast("timestamp_ntz").cast("date").alias("week")
    return found.select(week, "column", rounded("psi"), rounded("ks"), rounded("missing_after"), "n_after")
