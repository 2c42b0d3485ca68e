"""Deterministic dirt, in expressions that read the same in both engines."""

DIRTY_EVENTS = """
SELECT event_id, ts, user_id,
       CASE WHEN event_id % 5 = 0 THEN ' N/A ' WHEN event_id % 11 = 0 THEN NULL
            ELSE concat('  ', upper(event_type), ' ') END AS event_type,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
       CASE WHEN event_id % 4 <> 0 THEN NULL ELSE value END AS sparse,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS half,
       substr(CAST(ts AS {text}), 1, 10) AS day
FROM events
"""

DIRTY_LINEITEM = """
SELECT l_orderkey, l_partkey,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag
FROM lineitem
"""

LABELLED_DOCUMENTS = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def duck(sql: str) -> str:
    return "(" + sql.format(text="VARCHAR").strip() + ")"


def spark_view(spark, folder: str, sql: str, *tables: str):
    """The same statement over the given tables, without naming any view globally."""
    from catalog import table

    frames = {t: table(spark, folder, t) for t in tables}
    for t in tables:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t}", "JOIN {" + t + "}")
    return spark.sql(sql.replace("{text}", "STRING"), **frames)


def dirty_events(spark, folder):
    return spark_view(spark, folder, DIRTY_EVENTS, "events")


def dirty_lineitem(spark, folder):
    return spark_view(spark, folder, DIRTY_LINEITEM, "lineitem")


def labelled_documents(spark, folder):
    return spark_view(spark, folder, LABELLED_DOCUMENTS, "documents", "labels")
