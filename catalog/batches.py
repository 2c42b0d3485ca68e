"""One recipe over many tables, with a failure, a restart and the rows as readers find them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from catalog import query, table
from catalog.cleaning import DEFAULT_SQL
from catalog.dirt import DIRTY_EVENTS, DIRTY_LINEITEM, dirty_events, dirty_lineitem, duck
from tabloom.plans.many import Source, clean_tables, read_cleaned
from tabloom.session import checkpoint_dir


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/many-{uuid.uuid4().hex}"


def _sources(folder: str, late: str) -> dict[str, Source]:
    return {
        "events": Source(load=lambda s: dirty_events(s, folder), version=folder),
        "lineitem": Source(load=lambda s: dirty_lineitem(s, folder), version=folder),
        "customer": Source(os.path.join(folder, "customer.parquet"), columns=["c_custkey", "c_mktsegment"]),
        "orders": Source(late, fmt="parquet"),
    }


@query(
    f"""SELECT 'events' AS "table", 'done' AS first_state, 'skipped' AS second_state, count(*) AS "rows", 6::INTEGER AS "columns"
  FROM (SELECT DISTINCT event_id, ts, user_id, event_type, value, day FROM {duck(DIRTY_EVENTS)})
UNION ALL SELECT 'lineitem', 'done', 'skipped', count(*), 5 FROM (SELECT DISTINCT * FROM {duck(DIRTY_LINEITEM)})
UNION ALL SELECT 'customer', 'done', 'skipped', count(*), 2 FROM (SELECT DISTINCT c_custkey, c_mktsegment FROM customer)
UNION ALL SELECT 'orders', 'failed', 'done', count(*), 3 FROM (SELECT DISTINCT o_orderkey, o_custkey, o_totalprice FROM orders)"""
)
def many_tables_report(spark, folder):
    """The orders arrive after the first run, which fails for them alone; the second does only them."""
    base = _scratch(spark)
    sources = _sources(folder, f"{base}/orders")
    first = clean_tables(spark, sources, f"{base}/out")
    table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.parquet(f"{base}/orders")
    second = clean_tables(spark, sources, f"{base}/out")
    states = first.select("table", F.col("state").alias("first_state"))
    return states.join(second.withColumnRenamed("state", "second_state"), "table").select(
        "table", "first_state", "second_state", "rows", "columns"
    )


@query(DEFAULT_SQL)
def many_tables_rows(spark, folder):
    base = _scratch(spark)
    sources = _sources(folder, "")
    clean_tables(spark, {name: sources[name] for name in ("events", "lineitem")}, base, at_once=2)
    return read_cleaned(spark, base, "events")
