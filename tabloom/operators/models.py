"""Declarative model specifications: ``{"algo": name, "params": {keyword: value}}``.

Names and keywords are the ones data-frame users know; they map to Spark ML estimators.
No code is ever executed from a specification.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import SparkSession

from tabloom.operators.features import VECTOR
from tabloom.session import scratch, staging

CLASSIFY, REGRESS, CLUSTER = "classification", "regression", "clustering"
LABEL, PREDICTION, PROBABILITY, WEIGHT = "_label", "_prediction", "_probability", "_weight"
MAX_TREE_DEPTH = 30

# Algorithm -> task and accepted keywords.
TASKS = {
    "RandomForestClassifier": CLASSIFY,
    "RandomForestRegressor": REGRESS,
    "LogisticRegression": CLASSIFY,
    "LinearRegression": REGRESS,
    "KMeans": CLUSTER,
    "DecisionTreeClassifier": CLASSIFY,
    "DecisionTreeRegressor": REGRESS,
    "SVC": CLASSIFY,
    "SVR": REGRESS,
}
KEYWORDS = {
    "RandomForestClassifier": ["n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "random_state", "class_weight", "n_jobs"],
    "RandomForestRegressor": ["n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "random_state", "n_jobs"],
    "LogisticRegression": ["C", "penalty", "solver", "max_iter", "random_state", "class_weight"],
    "LinearRegression": ["fit_intercept", "copy_X", "n_jobs", "positive"],
    "KMeans": ["n_clusters", "init", "n_init", "max_iter", "random_state", "algorithm"],
    "DecisionTreeClassifier": ["max_depth", "min_samples_split", "min_samples_leaf", "random_state", "class_weight"],
    "DecisionTreeRegressor": ["max_depth", "min_samples_split", "min_samples_leaf", "random_state"],
    "SVC": ["C", "kernel", "degree", "gamma", "random_state", "class_weight", "probability"],
    "SVR": ["C", "kernel", "degree", "gamma", "epsilon"],
}

# What is trained when nothing (usable) is asked for.
DEFAULTS = {
    CLASSIFY: {"algo": "RandomForestClassifier", "params": {"n_estimators": 100, "max_depth": 10, "random_state": 42}},
    REGRESS: {"algo": "RandomForestRegressor", "params": {"n_estimators": 100, "max_depth": 10, "random_state": 42}},
    CLUSTER: {"algo": "KMeans", "params": {"n_clusters": 3, "random_state": 42}},
}

# keywords that have no effect on the result here
IGNORED = {"min_samples_split", "n_jobs", "solver", "copy_X", "algorithm"}


class SpecError(ValueError):
    """A specification that cannot be trained on Spark ML as written."""


@dataclass
class CheckedSpec:
    algo: str
    params: dict
    notes: list[str] = field(default_factory=list)


def check_spec(spec: dict | None, task: str) -> CheckedSpec:
    """Replace unknown algorithms by the task's default and drop unknown keywords; say so."""
    default = DEFAULTS[task]
    if not spec:
        return CheckedSpec(default["algo"], dict(default["params"]))
    algo, params = spec.get("algo"), dict(spec.get("params") or {})
    if algo not in TASKS:
        note = f"unknown model {algo}: using {default['algo']}"
        return CheckedSpec(default["algo"], dict(default["params"]), [note])
    if TASKS[algo] != task:
        note = f"{algo} does not fit a {task} target: using {default['algo']}"
        return CheckedSpec(default["algo"], dict(default["params"]), [note])
    notes = []
    for keyword in [k for k in params if k not in KEYWORDS[algo]]:
        del params[keyword]
        notes.append(f"{algo}: dropped unknown parameter {keyword}")
    for keyword in [k for k in params if k in IGNORED]:
        del params[keyword]
        notes.append(f"{algo}: {keyword} has no effect on Spark")
    return CheckedSpec(algo, params, notes)


# node ids (4 bytes per row and tree) are kept between passes up to this many
MAX_CACHED_NODE_IDS = 1_000_000_000


def _tree_settings(params: dict, rows: int, trees: int = 1) -> dict:
    # no depth given means no limit; Spark ML stops at 30
    depth = params.get("max_depth") or MAX_TREE_DEPTH
    if depth > MAX_TREE_DEPTH:
        raise SpecError(f"max_depth is limited to {MAX_TREE_DEPTH}")
    leaf = params.get("min_samples_leaf", 1)
    if not isinstance(leaf, int):
        raise SpecError("min_samples_leaf must be a whole number")
    return {
        "maxDepth": depth,
        "minInstancesPerNode": leaf,
        "seed": params.get("random_state", 42),
        "maxMemoryInMB": 1024,  # more tree nodes per pass over the data
        "cacheNodeIds": rows * trees <= MAX_CACHED_NODE_IDS,
    }


def _strength(params: dict, rows: int) -> float:
    # a summed loss weighted by C corresponds to a mean loss with penalty 1 / (C * rows)
    return 1.0 / (float(params.get("C", 1.0)) * max(rows, 1))


def estimator(checked: CheckedSpec, rows: int, classes: int = 0):
    """The unfitted Spark ML estimator of a checked specification."""
    algo, params = checked.algo, checked.params
    common = {"featuresCol": VECTOR, "predictionCol": PREDICTION}
    supervised = {**common, "labelCol": LABEL}
    scored = {**supervised, "probabilityCol": PROBABILITY, "rawPredictionCol": "_raw"}
    weighted = {"weightCol": WEIGHT} if params.get("class_weight") == "balanced" else {}
    if params.get("class_weight") not in (None, "balanced"):
        raise SpecError("class_weight must be 'balanced'")
    trees = {"numTrees": params.get("n_estimators", 100)}
    forest = {**trees, **_tree_settings(params, rows, trees["numTrees"])} if "Forest" in algo else {}
    tree = _tree_settings(params, rows) if "DecisionTree" in algo else {}
    match algo:
        case "RandomForestClassifier":
            return RandomForestClassifier(**scored, **weighted, **forest)
        case "RandomForestRegressor":
            return RandomForestRegressor(**supervised, **forest)
        case "DecisionTreeClassifier":
            return DecisionTreeClassifier(**scored, **weighted, **tree)
        case "DecisionTreeRegressor":
            return DecisionTreeRegressor(**supervised, **tree)
        case "LogisticRegression":
            penalty = params.get("penalty", "l2")
            if penalty not in ("l1", "l2", None):
                raise SpecError(f"penalty {penalty} is not supported")
            return LogisticRegression(
                **scored,
                **weighted,
                regParam=0.0 if penalty is None else _strength(params, rows),
                elasticNetParam=1.0 if penalty == "l1" else 0.0,
                maxIter=params.get("max_iter", 100),
                standardization=False,  # the features already are
                tol=1e-4,
            )
        case "LinearRegression":
            if params.get("positive"):
                raise SpecError("positive coefficients are not supported")
            return LinearRegression(**supervised, fitIntercept=params.get("fit_intercept", True))
        case "SVC":
            if params.get("kernel", "rbf") != "linear":
                raise SpecError("only the linear kernel is supported")
            if params.get("probability"):
                raise SpecError("a linear support vector machine has no probabilities")
            svc = LinearSVC(
                **{**supervised, "rawPredictionCol": "_raw"},
                **weighted,
                regParam=_strength(params, rows),
                standardization=False,
                tol=1e-3,
            )
            if classes <= 2:
                return svc
            return OneVsRest(classifier=svc, rawPredictionCol="_raw", parallelism=4, **supervised, **weighted)
        case "KMeans":
            starts = {"k-means++": "k-means||", "random": "random"}
            if params.get("init", "k-means++") not in starts:
                raise SpecError("init must be 'k-means++' or 'random'")
            return KMeans(
                **common,
                k=min(params.get("n_clusters", 8), max(rows, 2)),
                initMode=starts[params.get("init", "k-means++")],
                maxIter=params.get("max_iter", 300),
                tol=1e-4,  # passes end when no centre moves further
                seed=params.get("random_state", 42),
            )
    raise SpecError(f"{algo} has no Spark ML counterpart")


def starts(checked: CheckedSpec) -> int:
    """How many times a clustering is started with different seeds."""
    n = checked.params.get("n_init", 1)
    return n if isinstance(n, int) else 1


def without_summary(spark: SparkSession, model: Model) -> Model:
    """The same model without what its training reported, which nothing here reads.

    The summary of a classifier of two classes holds the session. Spark sends it with the model to every task, and
    cannot as soon as the session has observed any table ("Task not serializable").
    """
    if isinstance(model, PipelineModel):
        return PipelineModel([without_summary(spark, s) for s in model.stages])
    if isinstance(model, OneVsRestModel):
        bare = model.copy()
        bare.models = [without_summary(spark, m) for m in model.models]
        return bare
    if not getattr(model, "hasSummary", False):
        return model
    bare = model.copy()
    if not bare.hasSummary:
        return bare
    with staging(spark):  # a logistic regression keeps its summary in copies, but not on disk
        path = scratch(spark)
        bare.write().save(path)
        return type(bare).load(path)
