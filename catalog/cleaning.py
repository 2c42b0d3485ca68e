from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from catalog.dirt import (
    DIRTY_EVENTS,
    DIRTY_LINEITEM,
    LABELLED_DOCUMENTS,
    dirty_events,
    dirty_lineitem,
    duck,
    labelled_documents,
)
from tabloom.functions.text import PLACEHOLDERS, WHITESPACE
from tabloom.operators import clean, columns, explore
from tabloom.plans.recipe import CleanRecipe
from tabloom.sources.files import rounded
from tabloom.types import Roles

TOKENS = ", ".join(f"'{t}'" for t in PLACEHOLDERS)
SPACES = " || ".join(["' '"] + [f"chr({ord(c)})" for c in WHITESPACE if c != " "])


@query(
    f"""WITH t AS {duck(DIRTY_EVENTS)}
SELECT event_id, ts, user_id, event_type, value, day FROM t"""
)
def clean_drop_high_null(spark, folder):
    return clean.drop_high_null(dirty_events(spark, folder))[0]


@query("SELECT DISTINCT user_id, event_type FROM events")
def clean_dedup_rows(spark, folder):
    return clean.deduplicate(table(spark, folder, "events").select("user_id", "event_type"))[0]


@query(
    """SELECT doc_id, text, lang, source, n_chars FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)"""
)
def clean_dedup_subset(spark, folder):
    step = clean.fit_deduplicate(table(spark, folder, "documents"), ["text"], "doc_id", audit=False)
    return step.transform(table(spark, folder, "documents"))


@query(
    f"""WITH t AS {duck(DIRTY_LINEITEM)}
SELECT * FROM t WHERE l_quantity IS NOT NULL OR l_returnflag IS NOT NULL"""
)
def clean_empty_rows(spark, folder):
    return clean.remove_empty_rows(dirty_lineitem(spark, folder), ["l_quantity", "l_returnflag"])[0]


@query(
    f"""WITH t AS {duck(DIRTY_EVENTS)}
SELECT event_id, CASE WHEN lower(trim(event_type, {SPACES})) IN ({TOKENS}) THEN NULL ELSE event_type END AS event_type, day
FROM t"""
)
def clean_placeholders(spark, folder):
    return clean.replace_placeholder_nulls(dirty_events(spark, folder).select("event_id", "event_type", "day"))[0]


@query(
    f"""WITH t AS {duck(DIRTY_LINEITEM)}
SELECT l_orderkey, l_partkey,
       coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS l_quantity,
       coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM t)) AS l_extendedprice,
       coalesce(l_returnflag, (SELECT l_returnflag FROM t WHERE l_returnflag IS NOT NULL
                               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag
FROM t"""
)
def clean_impute_median(spark, folder):
    return clean.impute_missing(dirty_lineitem(spark, folder))[0]


@query(
    f"""WITH t AS {duck(DIRTY_EVENTS)}
SELECT event_id, coalesce(event_type, (SELECT event_type FROM t WHERE event_type IS NOT NULL
                                       GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type
FROM t"""
)
def clean_impute_mode(spark, folder):
    return clean.impute_missing(dirty_events(spark, folder).select("event_id", "event_type"))[0]


@query(
    f"""WITH t AS {duck(LABELLED_DOCUMENTS)}
SELECT doc_id, text, lang, source, n_chars,
       coalesce(quality::DOUBLE, (SELECT quantile_cont(quality::DOUBLE, 0.5) FROM t)) AS quality,
       coalesce(toxic::DOUBLE, (SELECT quantile_cont(toxic::DOUBLE, 0.5) FROM t)) AS toxic
FROM t"""
)
def clean_impute_joined(spark, folder):
    return clean.impute_missing(labelled_documents(spark, folder))[0]


@query(
    f"""SELECT doc_id, trim(text, {SPACES}) AS text, trim(lang, {SPACES}) AS lang,
       trim(source, {SPACES}) AS source, n_chars FROM documents"""
)
def clean_strip(spark, folder):
    return clean.strip_whitespace(table(spark, folder, "documents"))[0]


@query("SELECT conv_id, turn, lower(role) AS role, lower(text) AS text FROM conversations")
def clean_lower(spark, folder):
    return clean.lowercase_text(table(spark, folder, "conversations"))[0]


@query(
    """SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day,
       date_trunc('second', ts)::TIMESTAMP AS full_time, event_type,
       CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%Y-%m-%d') END AS mixed
FROM events"""
)
def clean_parse_dates(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("full_time"),
        "event_type",
        F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd/MM/yyyy"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
        .alias("mixed"),
    )
    return clean.parse_dates(events)[0]


def _z(c: str, source: str) -> str:
    stats = f"SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {source}"
    return f"(SELECT * FROM {source} WHERE NOT coalesce(abs({c} - (SELECT m FROM ({stats}))) / (SELECT s FROM ({stats})) > 3, FALSE))"


@query(
    f"""WITH t AS (SELECT e.event_id, e.value, e.value * e.value AS squared, e.user_id FROM events e),
  a AS {_z("event_id", "t")}, b AS {_z("value", "a")}, c AS {_z("squared", "b")}, d AS {_z("user_id", "c")}
SELECT event_id, value, squared, user_id FROM d"""
)
def clean_outliers(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "value", (F.col("value") * F.col("value")).alias("squared"), "user_id"
    )
    return clean.remove_outliers(events)[0]


@query(
    f"""WITH t AS {duck(DIRTY_EVENTS)}, s AS (
  SELECT avg(value) AS vm, stddev_samp(value) AS vs, avg(sparse) AS sm, stddev_samp(sparse) AS ss FROM t)
SELECT event_id, value, sparse FROM t, s
WHERE NOT coalesce(abs(value - vm) / vs > 3, FALSE) AND NOT coalesce(abs(sparse - sm) / ss > 3, FALSE)"""
)
def clean_outliers_one_pass(spark, folder):
    events = dirty_events(spark, folder).select("event_id", "value", "sparse")
    return clean.remove_outliers(events, one_pass=True)[0]


@query(
    """SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS brand_name, p_type AS p_type,
       p_size AS size_cm, p_retailprice AS retail_price_usd FROM part"""
)
def clean_snake_case(spark, folder):
    part = table(spark, folder, "part").toDF(
        " Part Key", "part  name", "Brand-Name", "P_TYPE", "Size (cm)", "__Retail Price [USD]"
    )
    # the last name repeats the second one after renaming and is dropped
    return clean.rename_to_snake_case(part.withColumn("PART.NAME", F.lit(1)))[0]


DEFAULT_SQL = f"""WITH t AS {duck(DIRTY_EVENTS)},
 kept AS (SELECT DISTINCT event_id, ts, user_id, event_type, value, day FROM t),
 filled AS (
  SELECT event_id, ts, user_id,
         coalesce(event_type, (SELECT event_type FROM kept WHERE event_type IS NOT NULL
                               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type,
         coalesce(value, (SELECT quantile_cont(value, 0.5) FROM kept)) AS value, day FROM kept)
SELECT event_id, ts, user_id, trim(event_type, {SPACES}) AS event_type, value,
       strptime(day, '%Y-%m-%d')::TIMESTAMP AS day FROM filled"""


@query(DEFAULT_SQL)
def clean_recipe_default(spark, folder):
    return CleanRecipe(audit=False).fit_transform(dirty_events(spark, folder))[1]


FULL_SQL = f"""WITH t AS {duck(DIRTY_EVENTS)},
 kept AS (SELECT DISTINCT event_id, ts, user_id, event_type, value, day FROM t),
 nulled AS (SELECT event_id, ts, user_id,
    CASE WHEN lower(trim(event_type, {SPACES})) IN ({TOKENS}) THEN NULL ELSE event_type END AS event_type,
    value, day FROM kept),
 filled AS (
  SELECT event_id, ts, user_id,
         coalesce(event_type, (SELECT event_type FROM nulled WHERE event_type IS NOT NULL
                               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type,
         coalesce(value, (SELECT quantile_cont(value, 0.5) FROM nulled)) AS value, day FROM nulled),
 text AS (SELECT event_id, ts, user_id, lower(trim(event_type, {SPACES})) AS event_type, value,
       strptime(day, '%Y-%m-%d')::TIMESTAMP AS day FROM filled),
 a AS {_z("event_id", "text")}, b AS {_z("user_id", "a")}, c AS {_z("value", "b")}
SELECT event_id, ts, user_id, event_type, value, day FROM c"""


def _full_recipe() -> CleanRecipe:
    return CleanRecipe(
        remove_empty_rows=True,
        replace_placeholder_nulls=True,
        lowercase_text=True,
        remove_outliers=True,
        snake_case=True,
    )


@query(FULL_SQL)
def clean_recipe_full(spark, folder):
    return _full_recipe().fit_transform(dirty_events(spark, folder))[1]


@query(
    f"""WITH t AS {duck(DIRTY_EVENTS)}, done AS ({FULL_SQL}),
 nulls AS (SELECT count(*) - count(value) + count(*) - count(CASE WHEN lower(trim(event_type, {SPACES})) IN ({TOKENS})
   THEN NULL ELSE event_type END) AS n FROM t)
SELECT 'drop_high_null' AS op, 'cols_removed' AS metric, 2::BIGINT AS value
UNION ALL SELECT 'deduplicate', 'rows_removed', 0
UNION ALL SELECT 'remove_empty_rows', 'rows_removed', 0
UNION ALL SELECT 'replace_placeholder_nulls', 'nulled_cells',
   (SELECT count(*) FROM t WHERE lower(trim(event_type, {SPACES})) IN ({TOKENS}))
UNION ALL SELECT 'impute', 'imputed_cells', (SELECT n FROM nulls)
UNION ALL SELECT 'parse_dates', 'parsed_columns', 1
UNION ALL SELECT 'remove_outliers', 'rows_removed', (SELECT count(*) FROM t) - (SELECT count(*) FROM done)
UNION ALL SELECT 'snake_case', 'renamed_columns', 0
UNION ALL SELECT 'strip_whitespace', 'stripped_cells', (SELECT count(*) FROM t)
UNION ALL SELECT 'lowercase_text', 'lowercased_cells', (SELECT count(*) FROM t)"""
)
def clean_audit(spark, folder):
    fitted = _full_recipe().fit(dirty_events(spark, folder))
    return fitted.audit_log(spark).select("op", "metric", "value")


@query(
    f"""WITH kept AS {_z("value", "events")}
SELECT event_id, ts, user_id, event_type, value, props FROM events
WHERE event_id NOT IN (SELECT event_id FROM kept)"""
)
def removed_rows(spark, folder):
    events = table(spark, folder, "events")
    step = clean.fit_remove_outliers(events.select("value"), audit=False)
    return explore.removed_rows(events, step.transform(events), "event_id")


@query(
    """SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_after,
       count(DISTINCT text) - count(*) AS rows_delta, 5::INTEGER AS columns_before,
       4::INTEGER AS columns_after, -1::INTEGER AS columns_delta FROM documents"""
)
def before_after(spark, folder):
    documents = table(spark, folder, "documents")
    step = clean.fit_deduplicate(documents, ["text"], "doc_id", audit=False)
    return explore.compare(documents, step.transform(documents).drop("source"))


@query(
    """SELECT c_mktsegment, c_nationkey, c_acctbal AS account_balance, round(c_acctbal, 1) AS shown FROM customer"""
)
def roles_projection(spark, folder):
    """Roles chosen before cleaning, followed through a rename, then selected and rounded."""
    customer = table(spark, folder, "customer").withColumnRenamed("c_acctbal", "Account Balance")
    roles = Roles(["c_mktsegment", "c_nationkey", "Account Balance"], ["absent"], drop=["c_name", "absent"])
    kept = columns.apply_roles(customer, roles)
    renamed = columns.rename_snake_case(kept)
    now = columns.reconcile_roles(roles, kept.columns, renamed.columns)
    chosen = columns.select_roles(renamed, columns.validate_roles(now, renamed.columns))
    return rounded(chosen.withColumn("shown", F.col("account_balance")), 1, ["shown"])


@query("SELECT event_id, event_type, value, value * 2 AS twice FROM events WHERE value > 10")
def clean_custom_steps(spark, folder):
    """Steps of the caller, a function and a Spark ML transformer, at the end of a recipe."""
    from pyspark.ml.feature import SQLTransformer

    rows = table(spark, folder, "events").select("event_id", "event_type", "value")
    extra = [lambda df: df.where("value > 10"), SQLTransformer(statement="SELECT *, value * 2 AS twice FROM __THIS__")]
    recipe = CleanRecipe(deduplicate=False, impute=False, strip_whitespace=False, parse_dates=False, audit=False)
    fitted, _ = recipe.fit_transform(rows, extra)
    return fitted.transform(rows)
