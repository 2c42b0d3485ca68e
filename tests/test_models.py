"""Models by invariants: metrics recomputed, fills, unseen values, save/load, streams."""

import json

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import features, metrics, models
from tabloom.operators.columns import (
    drop_duplicate_names, missing_roles, reconcile_roles, resolve_features, resolve_targets, validate_roles,
)
from tabloom.plans import card, ensemble, questions
from tabloom.plans.ensemble import Ensemble, train
from tabloom.plans.readiness import assess
from tabloom.types import Roles

MEANS = {"setosa": (5.0, 3.4, 1.5, 0.2), "versicolor": (5.9, 2.8, 4.3, 1.3), "virginica": (6.6, 3.0, 5.6, 2.0)}
COLS = ["sepal_l", "sepal_w", "petal_l", "petal_w"]


@pytest.fixture(scope="module")
def flowers(spark):
    rows = [
        (i * 3 + j, s, *[m + 0.05 * ((i * (k + 3)) % 7 - 3) for k, m in enumerate(MEANS[s])])
        for i in range(10)
        for j, s in enumerate(MEANS)
    ]
    return spark.createDataFrame(rows, "id bigint, species string, " + ", ".join(f"{c} double" for c in COLS)).cache()


@pytest.fixture(scope="module")
def forest(flowers):
    return train(flowers, Roles(COLS, ["species"]), spec={"algo": "RandomForestClassifier", "params": {"n_estimators": 10, "max_depth": 5}})


def test_features_are_standardised_like_population_statistics(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, None, 5.0), (4, 9.0, 5.0)], "id int, x double, c double")
    got = [r.vector for r in features.standardised(df, ["x", "c"], ["id"]).orderBy("id").collect()]
    xs = [1.0, 2.0, 2.0, 9.0]
    m = sum(xs) / 4
    s = (sum((x - m) ** 2 for x in xs) / 4) ** 0.5
    assert [v[0] for v in got] == pytest.approx([(x - m) / s for x in xs])
    assert [v[1] for v in got] == [0.0] * 4


def test_unseen_and_missing_categories(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b's \\",)], "s string")
    fm = features.fit_features(df, ["s"])
    score = spark.createDataFrame([(1, "a"), (2, "z"), (3, None), (4, "b's \\")], "id int, s string")
    rows = fm.transform(score).orderBy("id").select(vector_to_array(features.VECTOR).alias("v")).collect()
    assert [r.v for r in rows] == [[1.0, 0.0], [0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    assert fm.slots == ["s", "s"]


def test_many_categories_are_hashed(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("s"), (F.col("id") * 1.0).alias("x"))
    with pytest.raises(ValueError, match="s has 50 values"):
        features.fit_features(df, ["s", "x"], max_categories=10)
    fm = features.fit_features(df, ["s", "x"], max_categories=10, encoding="hash")
    assert fm.transform(df).count() == 50 and len(fm.slots) == features.HASHED_SLOTS + 1


def test_all_null_text_feature(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "s string, x double")
    assert features.fit_features(df, ["s", "x"]).transform(df).count() == 2


def test_forest_and_probabilities(spark, flowers, forest):
    t = forest["species"]
    assert forest.metrics["species"]["accuracy"] == 1.0 and t.task == "classification"
    assert t.classes == sorted(MEANS)
    out = t.predict(flowers)
    assert out.columns == [*flowers.columns, "prediction", "prob_setosa", "prob_versicolor", "prob_virginica"]
    assert out.count() == 30 and out.where("prediction = species").count() == 30
    assert out.select(F.expr("abs(prob_setosa + prob_versicolor + prob_virginica - 1) < 1e-9").alias("ok")).distinct().first().ok


def test_prediction_fills_absent_and_missing_features(spark, flowers, forest):
    t = forest["species"]
    medians = t.features.fills
    part = spark.createDataFrame([(None, 0.2)], "sepal_l double, petal_w double")
    full = spark.createDataFrame([(medians["sepal_l"], medians["sepal_w"], medians["petal_l"], 0.2)], ", ".join(f"{c} double" for c in COLS))
    assert t.predict(part).first().prediction == t.predict(full).first().prediction
    spark.sparkContext.setJobGroup("single prediction", "")
    one = t.predict_one(spark, {"petal_l": 1.5, "petal_w": 0.2, "nonsense": 1}).first()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("single prediction")  # scored while planning
    spark.sparkContext.setJobGroup("", "")
    table = t.predict(spark.createDataFrame([(1.5, 0.2)], "petal_l double, petal_w double")).first()
    assert one.asDict() == table.asDict()
    assert one.prediction == "setosa"


def test_importance_is_summed_per_source_column(spark, flowers, forest):
    got = forest["species"].importance(spark).collect()
    assert {r.feature for r in got} == set(COLS) and sum(r.importance for r in got) == pytest.approx(1.0)
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)
    info = forest["species"].card(spark)
    assert info["algorithm"] == "RandomForestClassifier" and len(info["top_features"]) == 4 and info["metrics"] == {"accuracy": 1.0}


def test_save_and_load(spark, flowers, forest, tmp_path):
    forest.save(spark, str(tmp_path / "m"))
    again = Ensemble.load(spark, str(tmp_path / "m"))
    a = forest["species"].predict(flowers).orderBy("id").collect()
    assert again["species"].predict(flowers).orderBy("id").collect() == a
    assert ensemble.model_info(spark, str(tmp_path / "m"))["targets"][0]["algo"] == "RandomForestClassifier"
    clusters = train(flowers, Roles(COLS))
    clusters.save(spark, str(tmp_path / "c"))
    assert Ensemble.load(spark, str(tmp_path / "c")).first.predict(flowers).select("cluster").distinct().count() == 3


@pytest.mark.parametrize(
    "spec, algo, note",
    [
        ({"algo": "LogisticRegression", "params": {"C": 1.0, "bogus": 3, "solver": "lbfgs"}}, "LogisticRegression", "dropped unknown parameter bogus"),
        ({"algo": "DecisionTreeClassifier", "params": {"max_depth": 4, "class_weight": "balanced"}}, "DecisionTreeClassifier", None),
        ({"algo": "SVC", "params": {"kernel": "linear"}}, "SVC", None),
        ({"algo": "SVC", "params": {"kernel": "rbf"}}, "RandomForestClassifier", "only the linear kernel"),
        ({"algo": "Oracle"}, "RandomForestClassifier", "unknown model Oracle"),
        ({"algo": "LinearRegression"}, "RandomForestClassifier", "does not fit"),
    ],
)
def test_classifier_specs(flowers, monkeypatch, spec, algo, note):
    monkeypatch.setitem(models.DEFAULTS["classification"]["params"], "n_estimators", 5)
    got = train(flowers, Roles(COLS, ["species"]), spec=spec)
    assert got["species"].algo == algo and got.metrics["species"]["accuracy"] > 0.8
    assert note is None or any(note in line for line in got.log)


def test_regression_specs_and_several_targets(spark, flowers, monkeypatch):
    monkeypatch.setitem(models.DEFAULTS["regression"]["params"], "n_estimators", 5)
    wide = flowers.select(*COLS, (F.col("petal_l") * 2 + F.col("id") / 1000).alias("y"))
    got = train(wide, Roles(COLS, ["y"]), spec={"algo": "LinearRegression", "params": {"fit_intercept": True}})
    assert got["y"].task == "regression" and got.metrics["y"]["r2_score"] > 0.99
    assert len(got["y"].importance(spark).collect()) == 4
    got = train(wide, Roles([], ["y"]), spec={"algo": "SVR"}, task="regression", holdout=0.3)
    assert got["y"].algo == "RandomForestRegressor" and "holdout" in got.metrics["y"]
    many = train(flowers.drop("species"), Roles(["id"], COLS), task="regression", spec={"algo": "DecisionTreeRegressor"})
    assert list(many.targets) == COLS and {r.target for r in metrics.flatten_metrics(spark, many.metrics).collect()} == set(COLS)


def test_kmeans_restarts_keep_the_best(flowers):
    got = train(flowers, Roles(COLS), spec={"algo": "KMeans", "params": {"n_clusters": 3, "n_init": 3, "init": "random"}})
    assert got.first.task == "clustering" and got.metrics["cluster"]["clusters"] == 3
    summary = ensemble.cluster_summary(got.first, flowers).collect()
    assert sum(r.id_count for r in summary) == 30 and summary[0].species_count > 0


def test_labels_with_gaps(spark, flowers):
    gaps = flowers.withColumn("species", F.when(F.col("id") % 3 != 1, F.col("species")))
    with pytest.raises(ValueError, match="key"):
        train(gaps, Roles(COLS, ["species"]), spec={"algo": "DecisionTreeClassifier"})
    got = train(gaps, Roles(COLS, ["species"]), spec={"algo": "DecisionTreeClassifier"}, key="id")
    assert got["species"].classes == ["setosa", "virginica"]


def test_boolean_labels(flowers):
    df = flowers.withColumn("tall", F.col("petal_l") > 3)
    got = train(df, Roles(COLS, ["tall"]), spec={"algo": "LogisticRegression"})
    assert got["tall"].classes == [0, 1] and got.metrics["tall"]["accuracy"] == 1.0


def test_sampling_of_large_tables(spark):
    df = spark.range(6000).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    got = train(df, Roles(["x"], ["y"]), spec={"algo": "DecisionTreeClassifier"}, key="id", full=False)
    assert got.sampled and got.metrics["y"]["classification_report"]["weighted avg"]["support"] == 5000
    got = train(df, Roles(["x"], ["y"]), spec={"algo": "DecisionTreeClassifier"}, full=True)
    assert not got.sampled and got.metrics["y"]["classification_report"]["weighted avg"]["support"] == 6000


def test_only_classifiers_are_sampled(spark):
    df = spark.range(6000).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.5).alias("y"))
    with pytest.raises(ValueError):
        train(df, Roles(["x"], ["y"]), task="regression", full=False)


def test_whole_numbers_written_with_a_point(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 2.0).alias("y"))
    fitted = train(df, Roles(["a"], ["y"]), spec={"algo": "LinearRegression"}, task="regression")["y"]
    spark.createDataFrame([("12.0",), ("80.0",), ("7",)], "a string").write.csv(str(tmp_path / "in"), header=True)
    got = fitted.predict_csv(spark, str(tmp_path / "in")).select(F.round("prediction", 6)).collect()
    assert sorted(r[0] for r in got) == [14.0, 24.0, 160.0]


def test_pca_is_centred(flowers):
    pcs = features.principal_components(flowers, COLS, ["id"])
    m = pcs.agg(F.avg("PC1"), F.avg("PC2"), F.var_samp("PC1"), F.var_samp("PC2")).first()
    assert m[0] == pytest.approx(0, abs=1e-9) and m[1] == pytest.approx(0, abs=1e-9) and m[2] > m[3] > 0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in metrics.classification_report(df, "y", "p").collect()}
    assert got["a"] == (1.0, 0.5, pytest.approx(2 / 3), 2)
    assert got["b"] == (pytest.approx(1 / 3), 1.0, 0.5, 1) and got["c"] == (0.0, 0.0, 0.0, 1)
    assert got["accuracy"][0] == 0.5 and got["macro avg"][1] == 0.5
    assert got["weighted avg"][2] == pytest.approx((2 * 2 / 3 + 0.5) / 4) and got["weighted avg"][3] == 4
    reg = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    r = metrics.regression_metrics(reg, "y", "p").first()
    assert r.mse == pytest.approx(2 / 3) and r.r2 == pytest.approx(0.75) and r.rmse == pytest.approx((2 / 3) ** 0.5)


def test_readiness(spark, flowers):
    ok = assess(flowers, Roles(COLS, ["species"]))
    assert (ok.ready, ok.task_type, ok.recommendation) == (True, "classification", "multiclass_classification_3_classes")
    assert {r.value: r.n for r in ok.label_distribution.collect()} == {s: 10 for s in MEANS} and ok.findings == []
    none = assess(flowers, Roles())
    assert none.codes == ["features_missing"] and not none.ready and none.recommendation is None
    assert assess(flowers.limit(0), Roles(COLS)).codes == ["rows_missing"]
    gone = assess(flowers, Roles(COLS, ["gone"]))
    assert gone.codes == ["label_missing"] and not gone.ready
    words = assess(flowers, Roles(["species"]))
    assert words.codes == ["numbers_missing"] and words.ready and words.recommendation == "clustering"
    assert assess(flowers.limit(3), Roles(COLS)).codes == ["rows_few"]
    assert assess(flowers.limit(6), Roles(COLS, ["species"])).codes[0] == "labels_few"
    skew = spark.range(200).select("id", F.when(F.col("id") < 190, "x").otherwise("y").alias("y"))
    got = assess(skew, Roles(["id"], ["y"]))
    assert got.recommendation == "binary_classification" and got.findings == [("class_dominates", "x: 95% of all labels")]
    many = assess(spark.range(30).select("id", F.col("id").cast("string").alias("y")), Roles(["id"], ["y"]))
    assert many.codes == ["classes_many", "classes_rare"] and many.recommendation is None
    reg = spark.range(200).select("id", (F.col("id") % 25).alias("y"))
    got = assess(reg, Roles(["id"], ["y"]))
    assert got.recommendation == "regression" and got.codes == ["values_few"]
    assert got.to_frame(spark).first().label_cardinality == 25
    assert got.warnings_frame(spark).first().code == "values_few"
    wide = assess(spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(12)]), Roles([f"c{i}" for i in range(12)]))
    assert len(wide.to_frame(spark).first().numeric_features) == 12


def test_roles(spark):
    cols = ["a", "b", "c", "d", "e", "f", "g"]
    assert resolve_features(Roles(["a", "y", "zz"], ["y"]), [*cols, "y"]) == ["a"]
    assert resolve_features(Roles([], ["a"]), cols) == ["b", "c", "d", "e", "f", "g"]
    assert resolve_targets(Roles([], ["a", "b"]), cols) == ["a", "b"] and resolve_targets(Roles(), cols) == []
    assert resolve_targets(Roles([], ["a", "b"]), ["a", "b", "c"]) == ["a", "b"]
    moved = reconcile_roles(Roles(["My Col", "gone"], ["y"]), ["My Col", "gone", "y"], ["my_col", "y"])
    assert (moved.features, moved.labels) == (["my_col"], ["y"])
    assert missing_roles(moved, ["y"]) == {"features": ["my_col"]} and validate_roles(moved, ["y"]).features == []
    twice = spark.sql("select 1 as a, 2 as b, 3 as a")
    assert [tuple(r) for r in drop_duplicate_names(twice).collect()] == [(1, 2)]


def test_questions(spark, flowers):
    data = flowers.withColumn("place", F.when(F.col("id") % 2 == 0, "New York").otherwise("York"))
    asked = [
        (1, "Predict species when petal_l = 1.5 and petal w is 0.2", True, "species", {"petal_l": 1.5, "petal_w": 0.2}),
        (2, "what will be the sepal_w for place is new york?", True, "sepal_w", {"place": "New York"}),
        (3, "4.5 petal_l flowers of place York", False, "species", {"petal_l": 4.5, "place": "York"}),
        (4, "tell me about york in place names", False, "species", {"place": "York"}),
        (5, "hello", False, "species", {}),
        (6, "sepal_l of 5.5", False, "sepal_l", {"sepal_l": 5.5}),
        (7, None, None, "species", {}),
    ]
    df = spark.createDataFrame([(k, t) for k, t, *_ in asked], "k int, q string")
    routed = {r.k: r for r in questions.route_questions(df, "q", data.columns, "species").collect()}
    from tabloom.functions.intent import extract_inputs

    found = {r.k: r for r in extract_inputs(df, "q", "k", data, [*COLS, "place"]).collect()}
    for k, _, intent, target, inputs in asked:
        assert (routed[k].intent, routed[k].target) == (intent, target), k
        got = {c: found[k][c] for c in [*COLS, "place"] if found[k][c] is not None}
        assert got == inputs and found[k].given == len(inputs), k


def test_answers_and_what_if(spark, flowers, forest):
    asked = spark.createDataFrame(
        [(1, "predict species when petal_l = 1.4 and petal_w = 0.2"), (2, "hm"), (3, None), (4, "What would you predict?")],
        "k int, q string",
    )
    got = sorted(map(tuple, questions.answer_questions(asked, "q", "k", flowers, forest).collect()))
    assert got[0] == (1, "species", 2, "setosa", "model")
    assert got[1:3] == [(2, "species", 0, None, "none"), (3, "species", 0, None, "none")]
    assert got[3][2:] == (0, "setosa", "bulk")  # ten of each kind, the smallest name
    with pytest.raises(ValueError, match="fewer features"):
        questions.what_if_grid(flowers, COLS, COLS, values=100)
    grid = questions.what_if_grid(flowers, [*COLS, "species"], ["petal_l", "species"])
    assert grid.count() == 9 and grid.select("petal_w").distinct().count() == 1
    assert forest["species"].predict(grid).count() == 9
    asks = questions.suggested_questions(flowers, [*COLS], "species", "classification")
    assert len(asks) == 3 * len(COLS) - 1 and asks[0].startswith("Predict species for sepal_l = ")
    assert questions.suggested_questions(flowers, ["species"], "y", "regression") == ["Estimate y for species = setosa"]
    assert questions.suggested_questions(flowers, [*COLS], None, "clustering", limit=2)[1:] != []


def test_dataset_card(spark, flowers):
    got = json.loads(card.dataset_card(flowers, Roles([*COLS, "species"], ["species"]), "classification", "id").first().card)
    assert got["rows"] == 30 and len(got["numeric"]) == 4 and len(got["sample"]) == 5
    assert got["categories"][0] == {"column": "species", "rank": 1, "value": "setosa", "n": 10}


def test_prediction_summary(spark, flowers, forest):
    scored = spark.range(10).select("id", (F.col("id") * 1.0).alias("prediction"))
    from tabloom.operators.explore import prediction_summary

    got = prediction_summary(scored, "id").first()
    assert (got["min"], got["max"], got["mean"]) == (0.0, 9.0, 4.5) and got["last"] == [5.0, 6.0, 7.0, 8.0, 9.0]
    assert got["std"] == pytest.approx((99 / 12) ** 0.5)


def test_steps_and_estimators_of_the_caller(spark, flowers, tmp_path):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import SQLTransformer

    from tabloom.plans.recipe import CleanRecipe

    extra = [lambda d: d.where("id < 20"), SQLTransformer(statement="SELECT *, id * 2 AS twice FROM __THIS__")]
    fitted, out = CleanRecipe().fit_transform(flowers, extra)
    assert out.count() == 20 and "twice" in out.columns and fitted.transform(flowers).count() == 20
    assert [r.op for r in fitted.audit_log(spark).collect()][-2:] == ["custom", "custom"]
    with pytest.raises(TypeError):
        fitted.to_json()
    got = train(flowers, Roles(COLS, ["species"]), spec=NaiveBayes(modelType="gaussian"))
    assert got["species"].algo == "NaiveBayes" and got.metrics["species"]["accuracy"] > 0.9
    assert got["species"].predict(flowers).where("prob_setosa > 0.5").count() == 10


def test_bulk_csv_prediction_and_summary(spark, flowers, forest, tmp_path):
    t = forest["species"]
    flowers.drop("sepal_w").withColumn("note", F.lit("n/a")).write.csv(str(tmp_path / "in"), header=True)
    out = t.predict_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert out.where("prediction = species").count() == 30 and out.where("note is null").count() == 30
    found = t.summary(flowers, "id").collect()
    assert {r.value: r.n for r in found} == {s: 10 for s in MEANS}
    assert all(0.3 < r.confidence_min <= r.confidence_max <= 1 for r in found)
    header = spark.read.text(str(tmp_path / "out")).first().value
    assert header.startswith("id,species") and header.endswith("prob_virginica")


def test_awkward_column_names(spark):
    from tabloom.operators import explore, profile
    from tabloom.plans.recipe import CleanRecipe

    names = ["Sepal Length (cm)", "a.b", "it's; x=1", "y `tick`", "n"]
    df = spark.createDataFrame(
        [(float(i), i % 3, f" t{i % 2} ", "yes" if i > 20 else "no", i) for i in range(40)]
    ).toDF(*names)
    fitted, out = CleanRecipe(replace_placeholder_nulls=True, remove_outliers=True).fit_transform(df)
    assert out.columns == names and out.count() == 40
    got = train(df, Roles(names[:3], [names[3]]), spec={"algo": "DecisionTreeClassifier"}, key="n")
    assert got.metrics[names[3]]["accuracy"] == 1.0
    assert got[names[3]].predict(df.drop("a.b")).count() == 40
    assert [r.column for r in profile.profile_columns(df).collect()] == names
    assert profile.profile_table(df).first().duplicates == 0
    assert explore.box_stats(df, names[0], names[2]).count() == 2
    assert explore.histogram(df, names[0], 4, by="a.b").count() == 12
    assert explore.removed_rows(df, df.where("n < 30"), ["n", "a.b"]).count() == 10
    snake = CleanRecipe(snake_case=True).fit_transform(df)[1]
    assert snake.columns == ["sepal_length_cm", "a_b", "it_s_x_1", "y_tick", "n"]


def test_a_cell_that_is_no_number_is_an_error(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 2.0).alias("y"))
    fitted = train(df, Roles(["a"], ["y"]), spec={"algo": "LinearRegression"}, task="regression")["y"]
    assert len(fitted.metrics["first_predictions"]) == 5
    spark.createDataFrame([("12",), ("NA",), ("many",)], "a string").write.csv(str(tmp_path / "in"), header=True)
    with pytest.raises(Exception, match="a is not a number: many"):
        fitted.predict_csv(spark, str(tmp_path / "in")).collect()


def test_training_that_fails_falls_back(spark, flowers):
    from pyspark.ml.classification import NaiveBayes

    got = train(flowers, Roles(COLS, ["species"]), spec=NaiveBayes(modelType="multinomial"))  # takes no negative values
    assert got["species"].algo == "RandomForestClassifier" and got.metrics["species"]["accuracy"] == 1.0
    assert any("using the default model" in line for line in got.log)


def test_names_that_a_prediction_would_repeat(spark, flowers, forest):
    scored = forest["species"].predict(flowers)
    with pytest.raises(ValueError, match="prefix"):
        forest["species"].predict(scored)
    assert "again_prediction" in forest["species"].predict(scored, "again_").columns


def test_holdout_is_set_aside_before_fitting(spark):
    from tabloom.operators.metrics import flatten_metrics

    df = spark.range(2000).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.5).alias("y"))
    got = train(df, Roles(["x"], ["y"]), spec={"algo": "LinearRegression"}, task="regression", holdout=0.25)
    names = {r.metric for r in flatten_metrics(spark, got.metrics).collect()}
    assert {"mse", "holdout_mse", "holdout_r2_score"} <= names


def test_fill_gaps_with_null_keys_in_one_and_many_buckets(spark):
    from tabloom.operators.ordering import fill_gaps

    rows = [(k, None if k % 3 else f"v{k}") for k in range(40)] + [(None, None), (None, "own"), (None, None)]
    df = spark.createDataFrame(rows, "k long, y string")
    want = sorted([(k, f"v{k - k % 3}") for k in range(40)] + [(None, "v39"), (None, "own"), (None, "v39")], key=repr)
    for size in (500_000, 5):
        assert sorted((tuple(r) for r in fill_gaps(df, "y", "k", rows_per_bucket=size).collect()), key=repr) == want
    none = spark.createDataFrame([(None, None), (None, 2)], "k double, y int")
    assert sorted(r["y"] for r in fill_gaps(none, "y", "k").collect()) == [0, 2]


def test_first_predictions_follow_the_key(spark):
    rows = spark.range(200).selectExpr("id AS k", "cast(id AS double) AS x", "2.0 * id AS y")
    spec = {"algo": "LinearRegression", "params": {}}
    for parts in (1, 7):
        fitted = train(rows.repartition(parts), Roles(["x"], ["y"]), spec, task="regression", key="k")
        assert fitted["y"].metrics["first_predictions"] == pytest.approx([0, 2, 4, 6, 8], abs=1e-6)


def test_conditional_answers_of_odd_questions(spark):
    from tabloom.plans.questions import conditional_answers

    data = spark.createDataFrame([("a", 1, 2.0, "x"), ("a", 1, 4.0, "y"), ("a", 1, 6.0, "y"), ("b", 1, 9.0, "x"), (None, 2, None, None), ("a", 2, float("nan"), "x")], "s string, g int, v double, c string")
    asked = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, "b", 1), (4, None, None), (5, "zz", 1), (6, None, 1), (7, "a", 1)], "k int, s string, g int")
    got = {r["k"]: (r["matched"], r["answer"]) for r in conditional_answers(asked, "k", data, "v", ["s", "g"]).collect()}
    assert got == {1: (3, "4.0"), 2: (3, "4.0"), 3: (1, None), 4: (4, "5.25"), 5: (0, None), 6: (4, "5.25"), 7: (3, "4.0")}
    got = {r["k"]: (r["matched"], r["answer"]) for r in conditional_answers(asked, "k", data, "c", ["s", "g"]).collect()}
    assert got == {1: (3, "y"), 2: (4, "x"), 3: (1, None), 4: (5, "x"), 5: (0, None), 6: (4, "x"), 7: (3, "y")}
    assert conditional_answers(asked.limit(0), "k", data, "v", ["s", "g"]).collect() == []
    assert conditional_answers(asked, "k", data.limit(0), "v", ["s", "g"]).where("answer is not null").collect() == []


def test_the_same_forest_however_the_table_is_split(spark, monkeypatch):
    monkeypatch.setattr(ensemble, "EQUAL_ROWS", 300)
    # a third of the rows are equal
    many = spark.range(3_000).select(
        F.when(F.col("id") % 3 > 0, F.xxhash64("id") % 1000).otherwise(7).cast("double").alias("x"),
        F.when(F.col("id") % 3 > 0, F.xxhash64("id", F.lit(1)) % 1000).alias("y"),
        F.when(F.col("id") % 3 > 0, F.xxhash64("id", F.lit(2)) % 4).otherwise(1).cast("string").alias("label"),
    )
    placed = ensemble._placed(many, 3_000)
    sizes = [len(part) for part in placed.rdd.glom().collect()]
    assert len(sizes) == 3 and max(sizes) < 2_000  # one for every 1,250 rows
    assert placed.exceptAll(many).isEmpty() and many.exceptAll(placed).isEmpty()
    spec = {"algo": "RandomForestClassifier", "params": {"n_estimators": 4, "max_depth": 4, "random_state": 3}}
    found = []
    for parts in (1, 7):
        fitted = train(many.repartition(parts), Roles(["x", "y"], ["label"]), spec=spec)["label"]
        found.append(sorted((tuple(r) for r in fitted.predict(many).distinct().collect()), key=str))
    assert found[0] == found[1] and len({row[4:] for row in found[0]}) > 10


def _estimators_of_two_classes():
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, OneVsRest

    logistic = {"featuresCol": features.VECTOR, "labelCol": models.LABEL}
    return [
        {"algo": "RandomForestClassifier", "params": {"n_estimators": 3, "max_depth": 3}},
        {"algo": "SVC", "params": {"kernel": "linear"}},
        {"algo": "LogisticRegression"},
        OneVsRest(classifier=LogisticRegression()),
        Pipeline(stages=[LogisticRegression(**logistic, predictionCol=models.PREDICTION, probabilityCol=models.PROBABILITY)]),
    ]


@pytest.mark.parametrize("place", range(5))
def test_two_classes_in_a_session_that_has_observed_a_table(spark, flowers, tmp_path, monkeypatch, place):
    """The summary of such a model holds the session, which cannot be sent to tasks after an observation."""
    from pyspark.sql import Observation

    from tabloom import session

    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: str(tmp_path))
    df = flowers.withColumn("tall", (F.col("petal_l") > 3).cast("int"))
    spec = _estimators_of_two_classes()[place]
    got = train(df, Roles(COLS, ["tall"]), spec=spec)
    assert got["tall"].algo == (spec["algo"] if isinstance(spec, dict) else type(spec).__name__)
    assert got.metrics["tall"]["accuracy"] == 1.0
    assert got["tall"].predict(df).where("prediction = tall").count() == 30
    assert not list(tmp_path.iterdir())


def test_a_sampled_classifier_after_an_audit(spark, sf_dir):
    import __spark_entry__ as registry

    run = registry.queries()
    assert run["clean_audit"](spark, sf_dir).count() > 0  # observes its table
    got = run["train_sampled"](spark, sf_dir).collect()
    assert {(r.finished, r.prediction) for r in got} == {(0, 0), (1, 1)} and all(r.sampled for r in got)
    assert sum(r.n for r in got) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_clusters_by_blocks_are_those_by_rows(spark, monkeypatch):
    """The default clustering passes over packed rows, stages nothing for it, and finds what passes by row find."""
    staged, stage = [], ensemble.stage
    monkeypatch.setattr(ensemble, "stage", lambda df: staged.append(df) or stage(df))
    x = F.pmod(F.xxhash64("id"), F.lit(9973)) / 100
    kind = F.when(F.col("id") % 11 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")))
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 != 0, x).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(499)).alias("y"), kind.alias("kind"))
    roles = Roles(["x", "y", "kind"])
    monkeypatch.setattr(ensemble, "SMALL_ROWS", 2999)
    blocks = train(df, roles)
    assert not staged
    monkeypatch.setattr(ensemble, "DENSE_SLOTS", 0)
    by_row = train(df, roles)
    assert (blocks.first.model.getSolver(), by_row.first.model.getSolver()) == ("block", "auto")
    for a, b in zip(blocks.first.model.clusterCenters(), by_row.first.model.clusterCenters(), strict=True):
        assert list(a) == pytest.approx(list(b), abs=1e-9)
    found, wanted = blocks.metrics["cluster"], by_row.metrics["cluster"]
    assert found["passes"] == wanted["passes"] and found["training_cost"] == pytest.approx(wanted["training_cost"])
    both = by_row.first.predict(blocks.first.predict(df, "a_"), "b_")
    assert both.where("a_cluster = b_cluster").count() == 3000 and both.select("a_cluster").distinct().count() == 3


def test_clusters_of_few_rows_and_of_sparse_vectors(spark, monkeypatch):
    """Packed passes can't start from fewer centres than asked for: plain ones take over."""
    monkeypatch.setattr(ensemble, "SMALL_ROWS", 0)
    df = spark.createDataFrame([(1.0, "a"), (5.0, "b"), (9.0, "c")], "x double, s string")
    for rows in (1, 2, 3):
        got = train(df.limit(rows), Roles(["x"])).first
        assert got.predict(df.limit(rows)).select("cluster").distinct().count() == rows
    equal = train(df.withColumn("x", F.lit(2.0)), Roles(["x"]))
    assert equal.first.model.getSolver() == "auto" and any("row by row" in line for line in equal.log)
    assert equal.first.predict(df).select("cluster").distinct().count() == 1
    hashed = train(df, Roles(["x", "s"]), encoding="hash").first
    assert hashed.model.getSolver() == "auto" and hashed.predict(df).select("cluster").distinct().count() == 3


def test_a_sample_of_few_different_rows_holds_all_classes(spark):
    """Two rows with 20,000 copies each: a sample of 500 copies of one of them knows a single class."""
    df = spark.range(40000).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    fitted = train(df, Roles(["x"], ["y"]), full=False, max_rows=500)
    assert fitted.sampled and fitted["y"].classes == [0, 1]
    got = fitted["y"].predict(df).groupBy("y", "prediction").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 20000), (1, 1, 20000)]
