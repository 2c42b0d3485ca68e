"""Models on tables where SQL can state the answer: closed forms, rules to be found, and invariants."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import query, rounded, table
from catalog.dirt import DIRTY_LINEITEM, dirty_lineitem, duck
from tabloom.operators import features
from tabloom.operators.metrics import flatten_metrics
from tabloom.plans import ensemble, questions
from tabloom.plans.ensemble import train
from tabloom.session import checkpoint_dir
from tabloom.streaming.apply import score_stream, write_stream
from tabloom.types import Roles

FOREST = {"n_estimators": 20, "max_depth": 5}


def _order_lines(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    return lines.withColumn("charge", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query(
    f"""WITH t AS {duck(DIRTY_LINEITEM)},
 f AS (SELECT l_orderkey, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS q,
   coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM t)) AS e FROM t),
 s AS (SELECT avg(q) AS qm, stddev_pop(q) AS qs, avg(e) AS em, stddev_pop(e) AS es FROM f)
SELECT l_orderkey, round((q - qm) / qs, 6) AS quantity, round((e - em) / es, 6) AS price FROM f, s"""
)
def features_numeric(spark, folder):
    out = features.standardised(
        dirty_lineitem(spark, folder), ["l_quantity", "l_extendedprice"], keep=["l_orderkey"]
    )
    return out.select(
        "l_orderkey",
        F.round(F.col("vector")[0], 6).alias("quantity"),
        F.round(F.col("vector")[1], 6).alias("price"),
    )


@query(
    """SELECT event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'],
   coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END,
     (SELECT event_type FROM events WHERE event_id % 3 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)))::INTEGER AS slot,
   1.0::DOUBLE AS total FROM events"""
)
def features_onehot(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type")
    )
    fitted = features.fit_features(events, ["event_type"])
    v = vector_to_array(F.col(features.VECTOR))
    return fitted.transform(events).select(
        "event_id",
        F.array_position(v, F.lit(1.0)).cast("int").alias("slot"),
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@query(
    """WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS a, regr_intercept(o_totalprice, o_custkey) AS b FROM orders)
SELECT o_orderkey, round(a * o_custkey + b, 2) AS prediction FROM orders, m"""
)
def train_linear(spark, folder):
    orders = table(spark, folder, "orders")
    fitted = train(
        orders, Roles(["o_custkey"], ["o_totalprice"]), {"algo": "LinearRegression"}, task="regression", full=True
    )
    return fitted["o_totalprice"].predict(orders).select("o_orderkey", rounded("prediction", 2))


@query(
    """WITH c AS (SELECT o_orderkey, o_custkey - (SELECT avg(o_custkey) FROM orders) AS x,
   o_totalprice / 100 - (SELECT avg(o_totalprice / 100) FROM orders) AS y FROM orders),
 v AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM c),
 e AS (SELECT b, a, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS big FROM v),
 u AS (SELECT b / sqrt(b * b + (big - a) * (big - a)) AS ux, (big - a) / sqrt(b * b + (big - a) * (big - a)) AS uy FROM e)
SELECT o_orderkey, round(abs(x * ux + y * uy), 3) AS pc1, round(abs(y * ux - x * uy), 3) AS pc2 FROM c, u"""
)
def pca_2d(spark, folder):
    orders = table(spark, folder, "orders").withColumn("price", F.col("o_totalprice") / 100)
    out = features.principal_components(orders, ["o_custkey", "price"], keep=["o_orderkey"])
    return out.select(
        "o_orderkey", F.round(F.abs("PC1"), 3).alias("pc1"), F.round(F.abs("PC2"), 3).alias("pc2")
    )


@query(
    """SELECT label, count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered FROM embeddings GROUP BY label"""
)
def pca_embeddings(spark, folder):
    """Components have no closed form; what SQL can state is that they are centred, uncorrelated and
    in falling order of variance."""
    e = table(spark, folder, "embeddings")
    wide = e.select("vec_id", "label", *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    out = features.principal_components(wide, [f"e{i}" for i in range(64)], keep=["vec_id", "label"])
    facts = out.agg(
        F.greatest(F.abs(F.avg("PC1")), F.abs(F.avg("PC2"))) < 1e-6,
        F.abs(F.covar_pop("PC1", "PC2")) < 1e-6 * F.var_pop("PC1"),
        F.var_pop("PC1") >= F.var_pop("PC2"),
    ).toDF("centred", "uncorrelated", "ordered")
    return out.groupBy("label").agg(F.count("*").alias("n")).select(
        "label", "n", *[facts.select(c).scalar().alias(c) for c in facts.columns]
    )


@query(
    """SELECT (l_linestatus = 'F')::INTEGER AS finished, (l_linestatus = 'F')::INTEGER AS prediction, count(*) AS n,
   1.0::DOUBLE AS accuracy FROM lineitem GROUP BY 1, 2"""
)
def train_classifier(spark, folder):
    """A label that follows from one of three features: the forest must find the rule."""
    lines = _order_lines(spark, folder).withColumn("finished", (F.col("l_linestatus") == "F").cast("int"))
    roles = Roles(["l_quantity", "l_tax", "l_linestatus"], ["finished"])
    fitted = train(lines, roles, {"algo": "RandomForestClassifier", "params": FOREST}, full=True)
    scored = fitted["finished"].predict(lines.select("l_quantity", "l_tax", "l_linestatus", "finished"))
    return scored.groupBy("finished", "prediction").agg(
        F.count("*").alias("n"), F.lit(fitted.metrics["finished"]["accuracy"]).alias("accuracy")
    )


@query(
    """SELECT l_linestatus, CASE l_linestatus WHEN 'F' THEN 250.5::DOUBLE ELSE 80.25::DOUBLE END AS prediction, count(*) AS n FROM lineitem GROUP BY 1"""
)
def train_regressor(spark, folder):
    """A number that follows from a category: every tree of the forest must give it exactly."""
    lines = _order_lines(spark, folder).withColumn("fee", F.when(F.col("l_linestatus") == "F", 250.5).otherwise(80.25))
    spec = {"algo": "RandomForestRegressor", "params": FOREST}
    fitted = train(lines, Roles(["l_linestatus"], ["fee"]), spec, task="regression", full=True)
    scored = fitted["fee"].predict(lines.select("l_linestatus"))
    return scored.groupBy("l_linestatus", rounded("prediction", 6)).agg(F.count("*").alias("n"))


@query(
    "".join(
        f" UNION ALL SELECT '{c}' AS target, round(avg({sql}), 2) AS mean, true AS explained FROM lineitem"
        for c, sql in (("l_extendedprice", "l_extendedprice"), ("l_discount", "l_discount"), ("l_tax", "l_tax"),
                       ("charge", "l_extendedprice * (1 - l_discount)"))
    ).removeprefix(" UNION ALL")
)
def train_ensemble(spark, folder):
    """Every other column is a label, so one model is trained for each on shared features. The mean
    prediction of a regression tree is the mean label, and r2 follows from its errors."""
    lines = _order_lines(spark, folder).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "charge")
    labels = ["l_extendedprice", "l_discount", "l_tax", "charge"]
    fitted = train(lines, Roles([], labels), {"algo": "DecisionTreeRegressor", "params": {"max_depth": 5}}, task="regression", full=True)
    scored = lines
    for c in labels:
        scored = fitted[c].predict(scored, f"{c}_")
    cells = []
    for c in labels:
        guess, m = F.col(f"{c}_prediction"), fitted.metrics[c]
        error = F.avg((F.col(c) - guess) * (F.col(c) - guess)) / F.var_pop(c)
        same = (F.abs(1 - error - m["r2_score"]) < 1e-6).alias("explained")
        cells.append(F.struct(F.lit(c).alias("target"), F.round(F.avg(guess), 2).alias("mean"), same))
    return scored.agg(F.array(*cells).alias("all")).select(F.inline("all"))


@query(
    """SELECT (l_linestatus = 'F')::INTEGER AS finished, (l_linestatus = 'F')::INTEGER AS prediction, count(*) AS n,
   (SELECT count(*) > 5000 FROM lineitem) AS sampled FROM lineitem GROUP BY 1, 2"""
)
def train_sampled(spark, folder):
    """A classifier fitted on 5,000 labelled rows, as asked for (100 trees of depth 10), applied to all."""
    lines = _order_lines(spark, folder).withColumn("finished", (F.col("l_linestatus") == "F").cast("int"))
    roles = Roles(["l_quantity", "l_discount", "l_linestatus"], ["finished"])
    fitted = train(lines, roles, full=False, max_rows=5000)
    scored = fitted["finished"].predict(lines.select("l_quantity", "l_discount", "l_linestatus", "finished"))
    return scored.groupBy("finished", "prediction").agg(F.count("*").alias("n"), F.lit(fitted.sampled).alias("sampled"))


def _segments(spark, folder):
    customer = table(spark, folder, "customer")
    roles = Roles(["c_acctbal", "c_nationkey"], ["c_mktsegment"])
    spec = {"algo": "LogisticRegression", "params": {"C": 1.0, "class_weight": "balanced"}}
    return customer, train(customer, roles, spec, full=True)


@query("SELECT c_custkey, c_acctbal, 1.0::DOUBLE AS total, true AS likeliest FROM customer")
def predict_bulk(spark, folder):
    """Probabilities sum to one and the prediction is the class of the highest."""
    customer, fitted = _segments(spark, folder)
    # one feature is absent here and is filled with its training median
    scored = fitted["c_mktsegment"].predict(customer.select("c_custkey", "c_acctbal"))
    names = [c for c in scored.columns if c.startswith("prob_")]
    chosen = F.coalesce(*[F.when(F.col("prediction") == c.removeprefix("prob_"), F.col(c)) for c in names])
    return scored.select(
        "c_custkey",
        "c_acctbal",
        F.round(sum((F.col(c) for c in names), F.lit(0.0)), 6).alias("total"),
        (chosen == F.greatest(*names)).alias("likeliest"),
    )


@query(
    """SELECT CASE column_name WHEN 'l_linestatus' THEN 'l_linestatus' ELSE column_name END AS feature,
   CASE column_name WHEN 'l_linestatus' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance
FROM (SELECT unnest(['l_linestatus', 'l_quantity', 'l_discount', 'l_tax']) AS column_name)"""
)
def feature_importance(spark, folder):
    """A label that follows from one of four features: all importance is its own."""
    lines = _order_lines(spark, folder).withColumn("fee", F.when(F.col("l_linestatus") == "F", 250.5).otherwise(80.25))
    roles = Roles(["l_quantity", "l_linestatus", "l_discount", "l_tax"], ["fee"])
    spec = {"algo": "DecisionTreeRegressor", "params": {"max_depth": 6}}
    importance = train(lines, roles, spec, task="regression", full=True)["fee"].importance(spark)
    return importance.select("feature", rounded("importance", 6))


@query(
    """SELECT l_orderkey, l_linenumber, l_linestatus AS cluster FROM lineitem"""
)
def kmeans_clusters(spark, folder):
    """Two groups of equal rows: they are the clusters, named here by the value all their rows have."""
    lines = _order_lines(spark, folder)
    spec = {"algo": "KMeans", "params": {"n_clusters": 2, "random_state": 42}}
    scored = train(lines, Roles(["l_linestatus"]), spec, full=True).first.predict(lines)
    names = scored.groupBy("cluster").agg(F.min("l_linestatus").alias("low"), F.max("l_linestatus").alias("high"))
    mixed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed")
    named = scored.join(F.broadcast(names.select("cluster", mixed.alias("name"))), "cluster")  # two rows
    return named.select("l_orderkey", "l_linenumber", F.col("name").alias("cluster"))


@query(
    """SELECT count(*) AS rows, round(avg(l_quantity), 2) AS l_quantity_mean, round(avg(l_tax), 2) AS l_tax_mean,
   count(l_returnflag) AS l_returnflag_count FROM lineitem GROUP BY l_linestatus"""
)
def cluster_summary(spark, folder):
    lines = _order_lines(spark, folder)
    spec = {"algo": "KMeans", "params": {"n_clusters": 2, "random_state": 42}}
    fitted = train(lines, Roles(["l_linestatus"]), spec, full=True)
    out = ensemble.cluster_summary(fitted.first, lines)
    return out.select(F.col("l_orderkey_count").alias("rows"), "l_quantity_mean", "l_tax_mean", "l_returnflag_count")


@query(
    """SELECT 3::BIGINT AS clusters, count(*) AS rows, true AS filled FROM lineitem"""
)
def kmeans_default(spark, folder):
    """The clustering that is trained when nothing is asked for: three clusters, none empty."""
    lines = _order_lines(spark, folder)
    fitted = train(lines, Roles(["l_quantity", "l_extendedprice", "l_returnflag"]), full=True)
    sizes = fitted.first.predict(lines).groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("clusters"), F.sum("n").alias("rows"), (F.min("n") > 0).alias("filled")
    )


@query("SELECT c_custkey, true AS same, true AS as_likely FROM customer")
def model_round_trip(spark, folder):
    """The model read back predicts what the saved one does, with the same probabilities."""
    customer, fitted = _segments(spark, folder)
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    fitted.save(spark, path)
    again = ensemble.Ensemble.load(spark, path)["c_mktsegment"]
    both = again.predict(fitted["c_mktsegment"].predict(customer, "a_"), "b_")
    gaps = [F.abs(F.col(f"a_prob_{c}") - F.col(f"b_prob_{c}")) for c in again.classes]
    return both.select(
        "c_custkey",
        (F.col("a_prediction") == F.col("b_prediction")).alias("same"),
        (F.greatest(*gaps) < 1e-9).alias("as_likely"),
    )


@query(
    """SELECT event_id, 'value' AS target, (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)::INTEGER AS given,
   round(CASE event_id % 3 WHEN 0 THEN avg(value) OVER (PARTITION BY event_type) WHEN 1 THEN avg(value) OVER () END, 3) AS answer,
   CASE event_id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'bulk' ELSE 'none' END AS source FROM events"""
)
def answered_questions(spark, folder):
    """Questions with inputs, without inputs, and sentences that ask for nothing."""
    events = table(spark, folder, "events")
    asked = events.select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Predict value when event_type is "), "event_type"))
        .when(F.col("event_id") % 3 == 1, "What would you guess?")
        .otherwise("Thank you.")
        .alias("question"),
    )
    data = events.select("event_type", "value")
    spec = {"algo": "DecisionTreeRegressor", "params": {"max_depth": 5}}
    fitted = train(data, Roles(["event_type"], ["value"]), spec, task="regression", full=True)
    out = questions.answer_questions(asked, "question", "event_id", data, fitted)
    return out.withColumn("answer", F.round(F.col("answer").cast("double"), 3))


@query(
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem),
 p AS (SELECT a * l_quantity + b AS p FROM lineitem, m)
SELECT round(min(p), 3) AS min, round(max(p), 3) AS max, round(avg(p), 3) AS mean, round(stddev_pop(p), 3) AS std FROM p"""
)
def bulk_summary(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    spec = {"algo": "LinearRegression"}
    fitted = train(lines, Roles(["l_quantity"], ["l_extendedprice"]), spec, task="regression", full=True)
    out = fitted["l_extendedprice"].summary(lines, "l_orderkey")
    return out.select(*[rounded(c, 3) for c in ("min", "max", "mean", "std")])


@query(
    """WITH m AS (SELECT regr_slope(c_acctbal, c_nationkey) AS a, regr_intercept(c_acctbal, c_nationkey) AS b FROM customer)
SELECT c_custkey::VARCHAR AS c_custkey, round(a * c_nationkey + b, 3) AS prediction FROM customer, m"""
)
def predict_csv(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    spec = {"algo": "LinearRegression"}
    fitted = train(customer, Roles(["c_nationkey"], ["c_acctbal"]), spec, task="regression", full=True)
    base = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    customer.drop("c_acctbal").write.csv(f"{base}/in", header=True)
    fitted["c_acctbal"].predict_csv(spark, f"{base}/in", f"{base}/out")
    back = spark.read.csv(f"{base}/out", header=True, schema="c_custkey string, c_nationkey int, prediction double")
    return back.select("c_custkey", rounded("prediction", 3))


def _tree_per_type(spark, folder):
    """A regression tree that is deep enough to give every event type its own leaf."""
    events = table(spark, folder, "events")
    spec = {"algo": "DecisionTreeRegressor", "params": {"max_depth": 5}}
    # every other column is a label, so both are targets of one ensemble
    fitted = train(
        events.select("event_type", "value", "user_id"),
        Roles(["event_type"], ["value", "user_id"]),
        spec,
        task="regression",
        full=True,
    )
    return events, fitted


@query(
    """SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 4) AS value_prediction,
       round(avg(user_id) OVER (PARTITION BY event_type), 4) AS user_prediction FROM events"""
)
def train_tree_means(spark, folder):
    events, fitted = _tree_per_type(spark, folder)
    scored = fitted["value"].predict(events.select("event_id", "event_type"))
    scored = scored.withColumnRenamed("prediction", "value_prediction")
    scored = fitted["user_id"].predict(scored).withColumnRenamed("prediction", "user_prediction")
    return scored.select("event_id", rounded("value_prediction", 4), rounded("user_prediction", 4))


@query(
    """WITH p AS (SELECT value::DOUBLE AS v, avg(value) OVER (PARTITION BY event_type) AS vp,
   user_id::DOUBLE AS u, avg(user_id) OVER (PARTITION BY event_type) AS up FROM events),
 m AS (SELECT 'value' AS target, avg((v - vp) * (v - vp)) AS mse, var_pop(v) AS var FROM p
   UNION ALL SELECT 'user_id', avg((u - up) * (u - up)), var_pop(u) FROM p)
SELECT target, 'mse' AS metric, round(mse, 4) AS value FROM m
UNION ALL SELECT target, 'rmse', round(sqrt(mse), 4) FROM m
UNION ALL SELECT target, 'r2_score', round(1 - mse / var, 4) FROM m"""
)
def train_tree_metrics(spark, folder):
    return flatten_metrics(spark, _tree_per_type(spark, folder)[1].metrics)


@query("SELECT round(avg(value), 4) AS prediction FROM events WHERE event_type = 'click'")
def predict_single(spark, folder):
    fitted = _tree_per_type(spark, folder)[1]
    return fitted["value"].predict_one(spark, {"event_type": "click"}).select(rounded("prediction", 4))


@query(
    """SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 4) AS prediction FROM events"""
)
def stream_scores(spark, folder):
    """The model applied to the same events as they arrive as a stream."""
    events, fitted = _tree_per_type(spark, folder)
    base = f"{checkpoint_dir(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
    events.select("event_id", "event_type").write.parquet(f"{base}/in")
    source = spark.readStream.schema("event_id bigint, event_type string").parquet(f"{base}/in")
    scored = score_stream(source, fitted["value"])
    write_stream(scored, f"{base}/out", f"{base}/progress", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", rounded("prediction", 4))


@query(
    """SELECT event_id, round(avg(user_id) OVER (PARTITION BY event_type), 4) AS prediction FROM events"""
)
def saved_model_scores(spark, folder):
    events, fitted = _tree_per_type(spark, folder)
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    fitted.save(spark, path)
    again = ensemble.Ensemble.load(spark, path)["user_id"]
    return again.predict(events.select("event_id", "event_type")).select("event_id", rounded("prediction", 4))


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'value' ELSE 'user_id' END AS target, 1::INTEGER AS given,
   round(CASE WHEN event_id % 2 = 0 THEN avg(value) OVER (PARTITION BY event_type)
              ELSE avg(user_id) OVER (PARTITION BY event_type) END, 4) AS answer FROM events"""
)
def answers_per_target(spark, folder):
    """Questions about two targets, each answered by the model of its target."""
    events, fitted = _tree_per_type(spark, folder)
    asked = events.select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Predict value when event_type is "), "event_type"))
        .otherwise(F.concat(F.lit("Please estimate user_id, "), F.upper("event_type"), F.lit(" as event_type")))
        .alias("question"),
    )
    data = events.select("value", "user_id", "event_type")
    out = questions.answer_questions(asked, "question", "event_id", data, fitted)
    return out.select("event_id", "target", "given", F.round(F.col("answer").cast("double"), 4).alias("answer"))


CONDITIONS = """q AS (SELECT event_id, event_id % 4 AS k, event_type, user_id % 40 AS grp FROM events),
 d AS (SELECT event_type, user_id % 40 AS grp, round(value) AS value, event_type || (user_id % 3) AS kind FROM events)"""


def _asked(spark, folder):
    events = table(spark, folder, "events")
    sentence = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Predict value when grp is "), F.col("user_id") % 40))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("What is the value if event_type is "), "event_type", F.lit(" and grp is "), F.col("user_id") % 40))
        .when(F.col("event_id") % 4 == 2, F.lit("Estimate value"))
        .otherwise(F.concat(F.lit("What will be the value for grp = 4"), F.col("user_id") % 40 + 100))
    )
    data = events.select("event_type", (F.col("user_id") % 40).alias("grp"), F.round("value").alias("value"))
    return events.select("event_id", sentence.alias("question")), data


@query(
    f"""WITH {CONDITIONS}, a AS (SELECT event_type, grp, avg(value) AS m, count(value) AS n FROM d GROUP BY ALL), b AS (SELECT grp, avg(value) AS m, count(value) AS n FROM d GROUP BY ALL)
SELECT event_id, 'value' AS target, CASE k WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS given,
 round(CASE WHEN k = 0 AND b.n >= 3 THEN b.m WHEN k = 1 AND a.n >= 3 THEN a.m ELSE (SELECT avg(value) FROM d) END, 4) AS answer,
 CASE WHEN k = 0 AND b.n >= 3 OR k = 1 AND a.n >= 3 THEN 'conditional' ELSE 'data' END AS source
FROM q LEFT JOIN a USING (event_type, grp) LEFT JOIN b ON b.grp = q.grp"""
)
def conditional_questions(spark, folder):
    """Questions about a column without a model: statistics of the rows that equal what they give, if three do."""
    asked, data = _asked(spark, folder)
    fitted = train(data, Roles(["grp"], ["event_type"]), {"algo": "DecisionTreeClassifier", "params": {"max_depth": 2}})
    out = questions.answer_questions(asked, "question", "event_id", data, fitted, conditional=True)
    return out.withColumn("answer", F.round(F.col("answer").cast("double"), 4))


@query(
    f"""WITH {CONDITIONS}, n AS (SELECT event_type, grp, kind, count(*) AS n FROM d GROUP BY ALL),
 t AS (SELECT event_type, grp, sum(n) AS matched, min_by(kind, (-n, kind)) AS answer FROM n GROUP BY ALL),
 m AS (SELECT event_type, sum(n) AS matched, min_by(kind, (-n, kind)) AS answer FROM (SELECT event_type, kind, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL)
SELECT event_id, coalesce(CASE WHEN k < 2 THEN t.matched ELSE m.matched END, 0)::BIGINT AS matched,
 CASE WHEN k < 2 AND t.matched >= 3 THEN t.answer WHEN k >= 2 THEN m.answer END AS answer
FROM q JOIN t USING (event_type, grp) JOIN m USING (event_type)"""
)
def conditional_classes(spark, folder):
    """The most frequent value of a text column for many sets of conditions in one pass."""
    events = table(spark, folder, "events")
    grp = (F.col("user_id") % 40).alias("grp")
    data = events.select("event_type", grp, F.concat("event_type", F.col("user_id") % 3).alias("kind"))
    asked = events.select("event_id", "event_type", F.when(F.col("event_id") % 4 < 2, F.col("user_id") % 40).alias("grp"))
    return questions.conditional_answers(asked, "event_id", data, "kind", ["event_type", "grp"])


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS prediction FROM customer"""
)
def train_boolean_label(spark, folder):
    """A true / false label becomes the classes 1 and 0."""
    rows = table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") > 5000).alias("rich"), F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("side"))
    fitted = train(rows, Roles(["side"], ["rich"]), {"algo": "DecisionTreeClassifier", "params": {"max_depth": 2}})
    return fitted["rich"].predict(rows).select("c_custkey", F.col("prediction").cast("int").alias("prediction"))


@query(
    """SELECT s_suppkey, 'LinearRegression' AS asked, 'RandomForestRegressor' AS used, true AS told FROM supplier"""
)
def train_fallback(spark, folder):
    """A specification that can't be trained falls back to the default model and says so."""
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    spec = {"algo": "LinearRegression", "params": {"positive": True}}
    fitted = train(rows, Roles(["s_nationkey"], ["s_acctbal"]), spec, task="regression")
    trained = fitted["s_acctbal"]
    told = any("using the default model" in line for line in fitted.log)
    return trained.predict(rows).where("prediction is not null").select(
        "s_suppkey", F.lit("LinearRegression").alias("asked"), F.lit(trained.algo).alias("used"), F.lit(told).alias("told")
    )


@query(
    """SELECT 'model' AS section, 'target' AS name, 'l_extendedprice' AS value UNION ALL SELECT 'model', 'task', 'regression'
UNION ALL SELECT 'model', 'algorithm', 'LinearRegression' UNION ALL SELECT 'model', 'probabilities', 'False'
UNION ALL SELECT 'feature', 'l_quantity', 'double'
UNION ALL SELECT 'metric', 'r2_score', round(regr_r2(l_extendedprice, l_quantity), 3)::VARCHAR FROM lineitem"""
)
def model_card(spark, folder):
    """The card of a regression on one column; its fit is the squared correlation."""
    rows = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice")
    fitted = train(rows, Roles(["l_quantity"], ["l_extendedprice"]), {"algo": "LinearRegression", "params": {}}, task="regression")
    card = fitted["l_extendedprice"].card_table(spark)
    shown = F.when(F.col("section") == "metric", F.round(F.col("value").cast("double"), 3).cast("string")).otherwise(F.col("value"))
    return card.where("section in ('model', 'feature') or name = 'r2_score'").withColumn("value", shown)
