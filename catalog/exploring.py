from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, rounded, table
from catalog.dirt import DIRTY_EVENTS, LABELLED_DOCUMENTS, dirty_events, duck, labelled_documents
from tabloom.functions import intent
from tabloom.operators import explore, metrics, ordering
from tabloom.plans import card, questions
from tabloom.plans.readiness import assess
from tabloom.types import Roles


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def value_counts_topk(spark, folder):
    return explore.frequencies(table(spark, folder, "part"), "p_brand", 10)


@query("SELECT DISTINCT lang AS value FROM documents")
def distinct_values(spark, folder):
    return explore.distinct_values(table(spark, folder, "documents"), "lang")


@query(
    f"""WITH t AS {duck(DIRTY_EVENTS)}
SELECT 'value' AS "column", 'numeric' AS kind, min(value) AS min, max(value) AS max, quantile_cont(value, 0.5) AS median FROM t
UNION ALL SELECT 'event_type', 'categorical', NULL, NULL, NULL
UNION ALL SELECT 'user_id', 'numeric', min(user_id)::DOUBLE, max(user_id)::DOUBLE, quantile_cont(user_id::DOUBLE, 0.5) FROM t"""
)
def input_stats(spark, folder):
    return explore.input_stats(dirty_events(spark, folder), ["value", "event_type", "user_id", "absent"])


@query(
    """SELECT round(avg(l_extendedprice), 4) AS mean, quantile_cont(l_extendedprice, 0.5) AS median,
       min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS count
FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'"""
)
def conditional_summary(spark, folder):
    out = explore.conditional_summary(
        table(spark, folder, "lineitem"), "l_extendedprice", {"l_returnflag": "R", "l_linestatus": "O"}
    )
    return out.select(rounded("mean", 4), "median", "min", "max", "count")


@query(
    """SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
GROUP BY 1 ORDER BY n DESC, value LIMIT 3"""
)
def conditional_top_values(spark, folder):
    return explore.conditional_summary(
        table(spark, folder, "orders"), "o_orderpriority", {"o_orderstatus": "F"}
    )


@query(
    """SELECT l_returnflag, count(l_quantity) AS l_quantity_count, round(avg(l_quantity), 2) AS l_quantity_mean,
       count(l_extendedprice) AS l_extendedprice_count, round(avg(l_extendedprice), 2) AS l_extendedprice_mean,
       count(l_linestatus) AS l_linestatus_count
FROM lineitem GROUP BY 1"""
)
def group_summary(spark, folder):
    return explore.group_summary(
        table(spark, folder, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_linestatus"]
    )


@query(
    f"""WITH t AS {duck(DIRTY_EVENTS)}
SELECT event_type AS value, count(*) AS n,
       round(count(*) / (SELECT count(event_type) FROM t)::DOUBLE, 6) AS share
FROM t WHERE event_type IS NOT NULL GROUP BY 1"""
)
def label_profile(spark, folder):
    out = explore.label_profile(dirty_events(spark, folder), "event_type")
    return out.select("value", "n", rounded("share"))


@query(
    f"""WITH t AS {duck(LABELLED_DOCUMENTS)}, s AS (SELECT count(*) AS r, count(quality) AS n, count(DISTINCT quality) AS k FROM t),
 m AS (SELECT max(c) AS top FROM (SELECT count(*) AS c FROM t WHERE quality IS NOT NULL GROUP BY quality))
SELECT TRUE AS ready, 'classification' AS task_type, CASE WHEN k = 2 THEN 'binary_classification' END AS recommendation,
       r AS row_count, 2::INTEGER AS feature_count, k AS label_cardinality, n AS label_samples,
       round(top / n::DOUBLE, 6) AS majority_share,
       CASE WHEN top / n::DOUBLE > 0.8 THEN 'class_dominates' ELSE '' END AS warnings FROM s, m"""
)
def label_readiness(spark, folder):
    found = assess(labelled_documents(spark, folder), Roles(["n_chars", "lang"], ["quality"]))
    return found.to_frame(spark).select(
        "ready", "task_type", "recommendation", "row_count", "feature_count", "label_cardinality",
        "label_samples", rounded("majority_share"), F.array_join("warnings", ",").alias("warnings"),
    )


HISTOGRAM = """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events),
 t AS (SELECT least(floor((value - lo) / w), 19)::INTEGER AS bin, lo, w, event_type FROM events, b)"""


@query(
    f"""{HISTOGRAM}
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + bin * w + w, 6) AS bin_end, count(*) AS n
FROM t GROUP BY bin, lo, w"""
)
def histogram(spark, folder):
    out = explore.histogram(table(spark, folder, "events"), "value", 20)
    return out.select("bin", rounded("bin_start"), rounded("bin_end"), "n")


@query(
    f"""{HISTOGRAM}
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + bin * w + w, 6) AS bin_end, event_type, count(*) AS n
FROM t GROUP BY bin, lo, w, event_type"""
)
def histogram_by_label(spark, folder):
    out = explore.histogram(table(spark, folder, "events"), "value", 20, by="event_type")
    return out.select("bin", rounded("bin_start"), rounded("bin_end"), "event_type", "n")


def _box_sql(by: str | None) -> str:
    key, group, on = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON TRUE")
    return f"""WITH q AS (SELECT {key}quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
   quantile_cont(value, 0.75) AS q3 FROM events {group})
SELECT {key}round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM events JOIN q {on} GROUP BY {key}q1, median, q3"""


BOX = ["q1", "median", "q3"]


@query(_box_sql(None))
def box_stats(spark, folder):
    out = explore.box_stats(table(spark, folder, "events"), "value")
    return out.select(*[rounded(c) for c in BOX], "whisker_low", "whisker_high", "outliers")


@query(_box_sql("event_type"))
def box_stats_by_label(spark, folder):
    out = explore.box_stats(table(spark, folder, "events"), "value", "event_type")
    return out.select("event_type", *[rounded(c) for c in BOX], "whisker_low", "whisker_high", "outliers")


PRICED = ["l_quantity", "l_extendedprice", "l_discount"]
LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", l_returnflag, {c}::DOUBLE AS x FROM lineitem" for c in PRICED) + ")"


@query(
    f"""WITH x AS {LONG}, b AS (SELECT "column", min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM x GROUP BY 1),
 t AS (SELECT "column", l_returnflag, lo, w, least(floor((x - lo) / w), 19)::INTEGER AS bin FROM x JOIN b USING ("column"))
SELECT "column", bin, round(lo + bin * w, 6) AS bin_start, round(lo + bin * w + w, 6) AS bin_end, l_returnflag, count(*) AS n
FROM t GROUP BY ALL"""
)
def histograms_of_all(spark, folder):
    out = explore.histograms(table(spark, folder, "lineitem"), PRICED, 20, by="l_returnflag")
    return out.select("column", "bin", rounded("bin_start"), rounded("bin_end"), "l_returnflag", "n")


@query(
    f"""WITH x AS {LONG}, q AS (SELECT "column", l_returnflag, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
   quantile_cont(x, 0.75) AS q3 FROM x GROUP BY 1, 2)
SELECT "column", l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(x) FILTER (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(x) FILTER (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
FROM x JOIN q USING ("column", l_returnflag) GROUP BY "column", l_returnflag, q1, median, q3"""
)
def boxes_of_all(spark, folder):
    out = explore.boxes(table(spark, folder, "lineitem"), PRICED, by="l_returnflag")
    return out.select("column", "l_returnflag", *[rounded(c) for c in BOX], "whisker_low", "whisker_high", "outliers")


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem")
def scatter_data(spark, folder):
    return explore.scatter_data(
        table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], by="l_returnflag"
    )


@query("SELECT least(count(*), 5000) AS rows, least(count(*), 5000) AS keys, 0::BIGINT AS strangers FROM orders")
def sample_rows(spark, folder):
    """Facts of an exact sample: its size, its distinct keys, and rows that are not in the table."""
    orders = table(spark, folder, "orders")
    picked = ordering.sample_rows(orders, key="o_orderkey")
    strangers = picked.join(orders, orders.columns, "left_anti").agg(F.count("*"))
    return picked.agg(
        F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("keys"), strangers.scalar().alias("strangers")
    )


@query(
    """SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 100"""
)
def head_rows(spark, folder):
    return ordering.head(table(spark, folder, "events").select("event_id", "event_type", "value"), 100, "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def last_rows(spark, folder):
    return ordering.last_rows(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 5, "o_orderkey")


GAPS = """CASE WHEN event_id < 20 OR event_id % 3 <> 0 THEN NULL ELSE event_type END"""


@query(
    f"""WITH t AS (SELECT event_id, {GAPS} AS label FROM events),
 f AS (SELECT event_id, last_value(label IGNORE NULLS) OVER (ORDER BY event_id) AS label FROM t)
SELECT event_id, coalesce(label, (SELECT arg_min(label, event_id) FROM t WHERE label IS NOT NULL), '0') AS label FROM f"""
)
def label_ffill(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.expr(GAPS).alias("label"))
    return ordering.fill_gaps(events, "label", "event_id", rows_per_bucket=2000)


PREDICTED = "l_extendedprice * 0.9 + l_quantity * 30"


@query(
    f"""WITH p AS (SELECT event_id, value * 0.8 + user_id * 0.1 AS prediction FROM events)
SELECT round(min(prediction), 6) AS min, round(max(prediction), 6) AS max, round(avg(prediction), 6) AS mean,
       round(stddev_pop(prediction), 6) AS std,
       (SELECT round(sum(prediction), 6) FROM (SELECT prediction FROM p ORDER BY event_id DESC LIMIT 5)) AS last_sum
FROM p"""
)
def prediction_summary(spark, folder):
    predicted = table(spark, folder, "events").select(
        "event_id", (F.col("value") * 0.8 + F.col("user_id") * 0.1).alias("prediction")
    )
    out = explore.prediction_summary(predicted, "event_id")
    last = F.aggregate("last", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        *[rounded(c) for c in ("min", "max", "mean", "std")], F.round(last, 6).alias("last_sum")
    )


@query(
    f"""WITH p AS (SELECT l_extendedprice AS y, {PREDICTED} AS p FROM lineitem),
 m AS (SELECT avg(y) AS mean FROM p)
SELECT count(*) AS n, round(1 - sum((y - p) * (y - p)) / sum((y - mean) * (y - mean)), 6) AS r2,
       round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
       round(avg(abs(y - p)), 4) AS mae FROM p, m"""
)
def regression_metrics(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("y"), F.expr(PREDICTED).alias("p")
    )
    out = metrics.regression_metrics(rows, "y", "p")
    return out.select("n", rounded("r2"), rounded("mse", 2), rounded("rmse", 4), rounded("mae", 4))


GUESS = "CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'X' END"


@query(
    f"""WITH p AS (SELECT l_returnflag AS y, {GUESS} AS p FROM lineitem),
 names AS (SELECT y AS class FROM p UNION SELECT p FROM p),
 c AS (SELECT class, (SELECT count(*) FROM p WHERE y = class) AS support, (SELECT count(*) FROM p WHERE p = class) AS predicted,
   (SELECT count(*) FROM p WHERE p = class AND y = class) AS hits FROM names),
 r AS (SELECT class, support, hits, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE hits / predicted::DOUBLE END AS precision,
   CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hits / support::DOUBLE END AS recall FROM c),
 s AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r),
 o AS (SELECT class, precision, recall, f1, support FROM s
   UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s
   UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
      sum(f1 * support) / sum(support), sum(support) FROM s
   UNION ALL SELECT 'accuracy', sum(hits) / sum(support)::DOUBLE, sum(hits) / sum(support)::DOUBLE,
      sum(hits) / sum(support)::DOUBLE, sum(support) FROM s)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM o"""
)
def classification_report(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("y"), F.expr(GUESS).alias("p")
    )
    out = metrics.classification_report(rows, "y", "p")
    return out.select("class", rounded("precision"), rounded("recall"), rounded("f1"), "support")


WORDS = "|".join(intent.PREDICTION_WORDS)


@query(
    f"""SELECT conv_id, turn, regexp_matches(lower(text), '{WORDS}') AS intent FROM conversations
UNION ALL SELECT doc_id, -1, regexp_matches(lower(text), '{WORDS}') FROM documents"""
)
def intent_tag(spark, folder):
    said = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    written = table(spark, folder, "documents").select(
        F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), "text"
    )
    return said.unionAll(written).select(
        "conv_id", "turn", intent.is_prediction_question(F.col("text")).alias("intent")
    )


# questions written from the rows of part, so that the values to find are known
ASKED = """SELECT p_partkey,
  CASE WHEN p_partkey % 4 = 0 THEN concat('Predict p_retailprice when p_size = ', p_size, ' and p_brand is ', p_brand)
       WHEN p_partkey % 4 = 1 THEN concat('What will be the P_Size for P Type ', p_type, '?')
       WHEN p_partkey % 4 = 2 THEN concat(p_size, ' p_size and ', lower(p_brand), ' of p_brand please')
       ELSE concat('Tell me about ', p_name) END AS question
FROM part"""


def _asked(spark, folder):
    return spark.sql(ASKED.replace("FROM part", "FROM {part}"), part=table(spark, folder, "part"))


@query(
    f"""SELECT p_partkey, question, p_partkey % 4 < 2 AS intent,
  CASE p_partkey % 4 WHEN 0 THEN 'p_retailprice' WHEN 1 THEN 'p_size' ELSE 'p_name' END AS target FROM ({ASKED})"""
)
def question_routing(spark, folder):
    columns = ["p_type", "p_size", "p_retailprice"]
    return questions.route_questions(_asked(spark, folder), "question", columns, default="p_name")


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 2) THEN p_size::DOUBLE END AS p_size,
   CASE WHEN p_partkey % 4 IN (0, 2) THEN p_brand END AS p_brand,
   CASE WHEN p_partkey % 4 = 1 THEN p_type END AS p_type,
   CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::INTEGER AS given FROM part"""
)
def question_inputs(spark, folder):
    part = table(spark, folder, "part")
    found = intent.extract_inputs(
        _asked(spark, folder), "question", "p_partkey", part, ["p_size", "p_brand", "p_type"]
    )
    return found.drop("question")


@query(
    """WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, quantile_cont(l_extendedprice, 0.5) AS price FROM lineitem),
 f AS (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
 m AS (SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT q AS l_quantity, price AS l_extendedprice, l_returnflag, l_linestatus
FROM (SELECT unnest([lo, (lo + hi) / 2, hi]) AS q, price FROM s), f, m"""
)
def what_if_grid(spark, folder):
    features = ["l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
    return questions.what_if_grid(table(spark, folder, "lineitem"), features, ["l_quantity", "l_returnflag"])


@query(
    """WITH s AS (SELECT round(max(l_quantity), 4)::VARCHAR AS q, round(quantile_cont(l_quantity, 0.5), 4)::VARCHAR AS q_mid,
   round(max(l_tax), 4)::VARCHAR AS t, round(quantile_cont(l_tax, 0.5), 4)::VARCHAR AS t_mid FROM lineitem),
 f AS (SELECT l_returnflag AS top FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT 'Estimate l_extendedprice for ' || unnest(['l_quantity = ' || q, 'l_tax = ' || t, 'l_quantity = ' || q_mid,
   'l_tax = ' || t_mid, 'l_returnflag = ' || top, 'l_quantity = ' || q || ' and l_tax = ' || t]) AS question FROM s, f"""
)
def suggested_questions(spark, folder):
    asked = questions.suggested_questions(
        table(spark, folder, "lineitem"), ["l_quantity", "l_tax", "l_returnflag"], "l_extendedprice", "regression"
    )
    return spark.createDataFrame([(q,) for q in asked], "question string")


@query(
    """WITH c AS (SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY 2
   UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*) FROM events GROUP BY 2)
SELECT "column", rank::INTEGER AS rank, value, n FROM (
   SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 5"""
)
def card_top_values(spark, folder):
    return card.top_values(table(spark, folder, "events"), ["event_type", "user_id"])


@query(
    """WITH c AS (SELECT event_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1)
SELECT 'classification' AS task, (SELECT count(*) FROM events) AS rows, (SELECT round(avg(value), 4) FROM events) AS value_mean,
   (SELECT max(user_id)::DOUBLE FROM events) AS user_max, (SELECT min(event_id) FROM events) IS NOT NULL AS sampled,
   value, n, rank::INTEGER AS rank FROM c WHERE rank <= 5"""
)
def dataset_card(spark, folder):
    """The card read back: one row per listed category, beside the figures of the table."""
    roles = Roles(["value", "user_id", "event_type"], ["event_type"])
    made = card.dataset_card(table(spark, folder, "events"), roles, "classification", "event_id")
    number = "struct<column:string,mean:double,max:double>"
    category = "struct<column:string,rank:int,value:string,n:bigint>"
    fields = f"task string, rows bigint, numeric array<{number}>, categories array<{category}>, sample array<struct<user_id:bigint>>"
    read = made.select(F.from_json("card", fields).alias("c")).select("c.*")
    of = lambda name: F.filter("numeric", lambda x: x["column"] == name)[0]
    return read.select(
        "task",
        "rows",
        F.round(of("value")["mean"], 4).alias("value_mean"),
        of("user_id")["max"].alias("user_max"),
        (F.size("sample") == F.least(F.col("rows"), F.lit(5))).alias("sampled"),
        F.explode("categories").alias("x"),
    ).select("*", "x.value", "x.n", "x.rank").drop("x")
