"""Training one model per target on shared features, applying, saving and explaining it."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.columns import drop_duplicate_names, resolve_features, resolve_targets
from tabloom.operators.explore import class_distribution, group_summary, prediction_summary
from tabloom.operators.features import MAX_CATEGORIES, VECTOR, FeatureModel, fit_features
from tabloom.operators.metrics import classification_report, regression_metrics
from tabloom.operators.models import (
    CLASSIFY,
    CLUSTER,
    DEFAULTS,
    LABEL,
    PREDICTION,
    PROBABILITY,
    REGRESS,
    WEIGHT,
    CheckedSpec,
    check_spec,
    estimator,
    starts,
    without_summary,
)
from tabloom.operators.ordering import SAMPLE_SIZE, fill_gaps, sample_rows
from tabloom.operators.profile import fewer_values
from tabloom.session import stage, staging
from tabloom.sources.delimited import null_tokens, read_csv_cells
from tabloom.sources.files import write_csv
from tabloom.types import Roles, col, present, value

CLASSES_BELOW = 20  # a numeric label with fewer values is a class label
MAX_CLASSES = 1000
MIN_ROWS_PER_TASK = 500
FIRST_PREDICTIONS = 5  # shown beside the metrics of a regression
SMALL_ROWS, SMALL_FITS, LARGE_FITS = 1_000_000, 8, 2  # how many fits run side by side
# (rows in a partition, up to this many partitions) for fitting, from the number of rows alone
PARTS = ((1_250, 8), (12_500, 64), (500_000, None))
EQUAL_ROWS = 10_000  # equal rows beyond this many go to another partition
DENSE_SLOTS = 2  # vectors with at most so many slots a feature are clustered in packed blocks


@dataclass
class TrainedTarget:
    """One fitted model with everything needed to apply and describe it."""

    target: str | None
    task: str
    algo: str
    params: dict
    features: FeatureModel
    model: Model
    label_type: str | None = None
    classes: list = field(default_factory=list)
    metrics: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """All input columns plus ``prediction`` and ``prob_<class>`` (or ``cluster``), each name
        after ``prefix``; a name that the input already has is an error.

        Absent features and missing cells are filled with the training median or mode.
        A narrow plan: it works on streams as it does on tables.
        """
        scored = self.model.transform(self.features.transform(df))
        kept = [col(c) for c in df.columns]
        added = {CLUSTER: ["cluster"], REGRESS: ["prediction"]}.get(
            self.task, ["prediction", *[f"prob_{c}" for c in self.classes]]
        )
        if clash := [prefix + c for c in added if prefix + c in df.columns]:
            raise ValueError(f"the table already has {', '.join(clash)}: choose a prefix")
        guess = F.col(PREDICTION)
        if self.task == CLUSTER:
            return scored.select(*kept, guess.cast("int").alias(f"{prefix}cluster"))
        if self.task == REGRESS:
            return scored.select(*kept, guess.alias(f"{prefix}prediction"))
        answer = F.element_at(_class_array(self), guess.cast("int") + 1)
        out = [*kept, answer.alias(f"{prefix}prediction")]
        if PROBABILITY in scored.columns:
            p = vector_to_array(F.col(PROBABILITY))
            out += [p[i].alias(f"{prefix}prob_{name}") for i, name in enumerate(self.classes)]
        return scored.select(*out)

    def predict_one(self, spark: SparkSession, inputs: dict) -> DataFrame:
        """Prediction for one row of inputs given by name; the others are filled in.

        The row is a constant table, which the optimizer scores while it plans: no job is run.
        """
        types = self.features.types
        known = {k: v for k, v in inputs.items() if k in types}
        one = spark.sql("SELECT * FROM VALUES (0) AS one(_one)")
        return self.predict(one.select(*[F.lit(v).cast(types[k]).alias(k) for k, v in known.items()]))

    def importance(self, spark: SparkSession, k: int = 15) -> DataFrame:
        """``feature, importance`` of the k most important source columns.

        Tree importances or absolute coefficients (of the first class); the slots of one
        encoded column are summed.
        """
        weights = _slot_weights(self.model)
        if weights is None:
            return spark.createDataFrame([], "feature string, importance double")
        totals: dict[str, float] = {}
        for source, weight in zip(self.features.slots, weights):
            totals[source] = totals.get(source, 0.0) + abs(float(weight))
        ranked = sorted(totals.items(), key=lambda item: (-item[1], item[0]))[:k]
        return spark.createDataFrame(ranked, "feature string, importance double")

    def summary(self, df: DataFrame, key: str) -> DataFrame:
        """What the model predicts for a table: ranges for numbers, counts for classes."""
        scored = self.predict(df)
        if self.task == REGRESS:
            return prediction_summary(scored, key)
        if self.task == CLUSTER:
            return class_distribution(scored, "cluster")
        return class_distribution(scored, "prediction", [c for c in scored.columns[len(df.columns) + 1 :]])

    def predict_csv(self, spark: SparkSession, path: str, out: str | None = None, **options) -> DataFrame:
        """Predictions for CSV files, written as CSV to the folder ``out`` if one is given.

        Features are read with the types they were trained with, other columns as text, so no
        inference pass is needed. Whole numbers may be written as 12 or 12.0; a cell of a numeric
        feature that is neither missing nor a number is an error.
        """
        text = read_csv_cells(spark, path, **options)
        known = {c: self.features.types.get(c, "string") for c in text.columns}
        whole = {"tinyint", "smallint", "int", "bigint"}

        def read(c: str, t: str) -> Column:
            cell = null_tokens(col(c))
            if t == "string":
                return cell
            number = cell.try_cast("double") if t in whole else cell.try_cast(t)
            wrong = F.raise_error(F.concat(F.lit(f"{c} is not a number: "), cell)).cast("double" if t in whole else t)
            return F.when(cell.isNotNull() & number.isNull(), wrong).otherwise(number)

        cells = [read(c, t).alias(c) for c, t in known.items()]
        scored = self.predict(text.select(*cells))
        if out:
            write_csv(scored, out)
        return scored

    def card(self, spark: SparkSession) -> dict:
        return {
            "algorithm": self.algo,
            "params": self.params,
            "task": self.task,
            "target": self.target,
            "top_features": [r.asDict() for r in self.importance(spark, 5).collect()],
            "probabilities": self.task == CLASSIFY and self.algo != "SVC",
            "metrics": {k: round(v, 4) for k, v in self.metrics.items() if isinstance(v, float)},
        }

    def card_table(self, spark: SparkSession) -> DataFrame:
        """The card as rows (section, name, value), for a report or the context of a chat."""
        about = self.card(spark)
        rows = [("model", k, str(about[k])) for k in ("target", "task", "algorithm", "probabilities")]
        rows += [("parameter", k, str(v)) for k, v in about["params"].items()]
        rows += [("feature", c, t) for c, t in self.features.types.items()]
        rows += [("class", str(c), str(i)) for i, c in enumerate(self.classes)]
        rows += [("importance", r["feature"], str(round(r["importance"], 4))) for r in about["top_features"]]
        rows += [("metric", k, str(v)) for k, v in about["metrics"].items()]
        return spark.createDataFrame(rows, "section string, name string, value string")


@dataclass
class Ensemble:
    targets: dict[str, TrainedTarget] = field(default_factory=dict)
    log: list[str] = field(default_factory=list)
    sampled: bool = False

    def __getitem__(self, target: str) -> TrainedTarget:
        return self.targets[target]

    @property
    def first(self) -> TrainedTarget:
        return next(iter(self.targets.values()))

    @property
    def metrics(self) -> dict[str, dict]:
        return {name: t.metrics for name, t in self.targets.items()}

    def save(self, spark: SparkSession, path: str) -> None:
        records = []
        for i, (name, t) in enumerate(self.targets.items()):
            t.features.model.write().overwrite().save(f"{path}/{i}/features")
            t.model.write().overwrite().save(f"{path}/{i}/model")
            records.append(
                {
                    "name": name,
                    "target": t.target,
                    "task": t.task,
                    "algo": t.algo,
                    "params": t.params,
                    "label_type": t.label_type,
                    "classes": t.classes,
                    "metrics": t.metrics,
                    "types": t.features.types,
                    "fills": t.features.fills,
                    "slots": t.features.slots,
                    "model_class": type(t.model).__name__,
                }
            )
        text = json.dumps({"targets": records, "log": self.log, "sampled": self.sampled})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/info"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Ensemble":
        info = model_info(spark, path)
        from pyspark.ml import classification, clustering, regression

        targets = {}
        for i, r in enumerate(info["targets"]):
            features = FeatureModel(
                PipelineModel.load(f"{path}/{i}/features"), r["types"], r["fills"], r["slots"]
            )
            module = {CLASSIFY: classification, REGRESS: regression, CLUSTER: clustering}[r["task"]]
            model = getattr(module, r["model_class"]).load(f"{path}/{i}/model")
            targets[r["name"]] = TrainedTarget(
                r["target"], r["task"], r["algo"], r["params"], features, model,
                r["label_type"], r["classes"], r["metrics"],
            )
        return cls(targets, info["log"], info["sampled"])


def model_info(spark: SparkSession, path: str) -> dict:
    """What is saved under ``path``: targets, parameters, metrics and the training log."""
    return json.loads(spark.read.text(f"{path}/info", wholetext=True).first()[0])


def _class_array(t: TrainedTarget) -> Column:
    return F.array(*[F.lit(c) for c in t.classes]).cast(f"array<{t.label_type}>")


def _slot_weights(model: Model):
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return model.coefficientMatrix.toArray()[0]
    if hasattr(model, "coefficients"):
        return model.coefficients.toArray()
    return None


def label_task(df: DataFrame, label: str) -> str:
    """Text and boolean labels are classes, and so are numbers with fewer than 20 values."""
    dtype = df.schema[label].dataType
    if isinstance(dtype, (T.StringType, T.BooleanType)) or fewer_values(df, label, CLASSES_BELOW):
        return CLASSIFY
    return REGRESS


def _classes(df: DataFrame, label: str, max_classes: int) -> list:
    found = df.select(col(label)).where(present(df, label)).distinct().limit(max_classes + 1).collect()
    if len(found) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} classes; group rare ones or raise max_classes")
    return sorted(row[0] for row in found)


def _prepare_label(df: DataFrame, target: str, key: str | None) -> DataFrame:
    """Missing labels take the value before them in key order, leading ones the first value."""
    if isinstance(df.schema[target].dataType, T.BooleanType):
        df = df.withColumn(target, col(target).cast("int"))
    if df.where(value(df, target).isNull()).isEmpty():
        return df
    if key is None:
        raise ValueError(f"{target} has missing values; name the key column that orders the rows")
    return fill_gaps(df.withColumn(target, value(df, target)), target, key)


def train(
    df: DataFrame,
    roles: Roles,
    spec: dict | Estimator | None = None,
    task: str | None = None,
    targets: list[str] | None = None,
    key: str | None = None,
    full: bool = True,
    max_rows: int = SAMPLE_SIZE,
    holdout: float | None = None,
    max_categories: int = MAX_CATEGORIES,
    max_classes: int = MAX_CLASSES,
    approximate: bool = False,
    parallelism: int | None = None,
    encoding: str = "onehot",
) -> Ensemble:
    """Train one model per target (a clustering without targets) on shared features.

    The targets follow from the roles unless they are named. ``spec`` is a declarative
    specification or an unfitted Spark ML estimator of the caller.

    All rows are used. Only classifiers may be fitted on a fixed sample, of ``max_rows`` rows of a
    larger table, with ``full=False``. Features are
    prepared once; the vectors are kept for all targets, in partitions that follow from the rows alone, and fitted ``parallelism`` at
    a time (more for small tables), each fit being a distributed job. ``holdout`` sets a share of rows aside and adds
    metrics on them.
    """
    df = drop_duplicate_names(df)
    features = resolve_features(roles, df.columns)
    targets = resolve_targets(roles, df.columns) if targets is None else targets
    features = [c for c in features if c not in targets] or features
    if not features:
        raise ValueError("no feature columns")
    with staging(df.sparkSession):
        return _train(
            df, features, targets, spec, task, key, full, max_rows, holdout,
            max_categories, max_classes, approximate, parallelism, encoding,
        )


def _train(
    df, features, targets, spec, task, key, full, max_rows, holdout,
    max_categories, max_classes, approximate, parallelism, encoding,
) -> Ensemble:
    result = Ensemble()
    extra = [key] if key and key not in features and key not in targets else []
    rows = df.select(*[col(c) for c in [*features, *[t for t in targets if t not in features], *extra]])
    if not full:
        smaller = sample_rows(rows, max_rows, key=key)
        result.sampled = smaller is not rows
        if result.sampled:
            rows = stage(smaller.repartition(max(1, max_rows // MIN_ROWS_PER_TASK)))  # picked once
    result.log.append(f"training on a sample of {max_rows:,} rows" if result.sampled else "training on all rows")
    for target in targets:
        rows = _prepare_label(rows, target, key)
    n, rows = (max_rows, rows) if result.sampled else _spread(rows)

    aside = None
    if holdout:
        # set aside before anything is fitted; by a hash of the cells, so equal rows stay together
        part = F.pmod(F.xxhash64(F.lit(42), *[col(c) for c in rows.columns]), F.lit(1_000_000))
        rows, aside = rows.where(part >= int(holdout * 1_000_000)), rows.where(part < int(holdout * 1_000_000))
        n = rows.count()
    shared = fit_features(rows, features, max_categories, approximate, encoding)
    result.log.append("features prepared")
    tasks = {t: task or label_task(rows, t) for t in targets}
    if not full and (not tasks or any(t != CLASSIFY for t in tasks.values())):
        raise ValueError("only classifiers are fitted on a sample")
    leading = None
    if REGRESS in tasks.values():
        # by the key, else by a hash of the cells: the same rows however the table is split
        place = col(key) if key else F.xxhash64(*[col(c) for c in rows.columns])
        leading = stage(rows.orderBy(place).limit(FIRST_PREDICTIONS).withColumn("_place", place))
    everything = rows if aside is None else rows.unionAll(aside)
    classes = {t: _classes(everything, t, max_classes) if tasks[t] == CLASSIFY else [] for t in targets}

    def vectorised(part: DataFrame) -> DataFrame:
        return shared.transform(part).select(VECTOR, *[col(t).alias(f"y{i}") for i, t in enumerate(targets)])

    used = rows.select(*[col(c) for c in dict.fromkeys([*shared.types, *targets])])
    vectors, held = vectorised(_placed(used, n)), None if aside is None else vectorised(aside)
    leading = leading and shared.transform(leading).select(VECTOR, "_place")
    at_once = parallelism or min(len(targets) or 1, SMALL_FITS if n <= SMALL_ROWS else LARGE_FITS)
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def fit(i: int) -> tuple[TrainedTarget, list[str]]:
            t = targets[i]
            dtype = rows.schema[t].dataType.simpleString()
            trained, notes = _fit_target(vectors, held, f"y{i}", t, dtype, shared, spec, tasks[t], classes[t], n)
            if trained.task == REGRESS:
                first = trained.model.transform(leading).select("_place", PREDICTION).orderBy("_place").collect()
                trained.metrics["first_predictions"] = [float(row[1]) for row in first]
            return trained, notes

        if not targets:
            fitted = [_fit_clusters(vectors, shared, spec, n)]
        else:
            with ThreadPoolExecutor(at_once) as pool:
                fitted = list(pool.map(fit, range(len(targets))))
    finally:
        vectors.unpersist()
    for trained, notes in fitted:
        name = trained.target or "cluster"
        result.targets[name] = trained
        result.log += [*notes, f"{name}: trained {trained.algo}"]
    return result


def _spread(rows: DataFrame) -> tuple[int, DataFrame]:
    """Row count, and the rows on as many partitions as they are worth, up to one per core.

    A table in one small file would otherwise be trained by one task: it is written once,
    spread. Tables with more splits than cores stay as they are.
    """
    sizes = rows.groupBy(F.spark_partition_id().alias("part")).count()
    n, parts = sizes.agg(F.sum("count"), F.count("*")).first()
    if not n:
        raise ValueError("no rows to train on")
    worth = max(1, n // MIN_ROWS_PER_TASK)
    wanted = min(worth, rows.sparkSession.sparkContext.defaultParallelism)
    if parts < wanted:
        return n, stage(rows.repartition(wanted))
    return n, rows.coalesce(worth) if worth < parts else rows


def _placed(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows in partitions, and an order within them, that follow from their cells and number alone.

    Estimators draw their samples by partition and position, so the same seed gives the same draws on any cluster
    and however the table is split, also where a lost partition is computed again. Rows travel as counts of
    equal rows, in chunks, so that no task gets all copies of a row.
    """
    names = rows.columns
    parts = max(min(-(-n // size), most or n) for size, most in PARTS)
    cells = [F.col(f"c{i}") for i in range(len(names))]
    counted = rows.toDF(*[f"c{i}" for i in range(len(names))]).groupBy(*cells).agg(F.count("*").alias("copies"))
    chunks = counted.select("*", F.explode(F.expr(f"sequence(0L, (copies - 1) div {EQUAL_ROWS})")).alias("chunk"))
    size = F.least(F.lit(EQUAL_ROWS), F.col("copies") - F.col("chunk") * EQUAL_ROWS).cast("int")
    sent = chunks.select(*cells, "chunk", size.alias("size"), F.xxhash64(*cells, "chunk").alias("place"))
    ordered = sent.repartition(parts, "place").sortWithinPartitions("place", *cells, "chunk")
    return ordered.select(*cells, F.explode(F.sequence(F.lit(1), "size"))).select(*cells).toDF(*names)


def _fit_target(vectors, held, y, target, label_type, shared, spec, task, classes, n):
    def labelled(frame: DataFrame) -> DataFrame:
        if task == REGRESS:
            return frame.select(VECTOR, col(y).cast("double").alias(LABEL))
        position = F.array_position(F.array(*[F.lit(c) for c in classes]).cast(f"array<{label_type}>"), col(y))
        return frame.select(VECTOR, (position - 1).cast("double").alias(LABEL))

    rows = labelled(vectors)
    checked, unfitted, notes = _choose(spec, task, target, n, len(classes))
    if checked.params.get("class_weight") == "balanced":
        counts = {r[0]: r[1] for r in rows.groupBy(LABEL).count().collect()}  # one row per class
        weights = [n / (len(classes) * counts[float(i)]) for i in range(len(classes))]
        weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col(LABEL).cast("int") + 1)
        rows = rows.withColumn(WEIGHT, weight)
    try:
        model = unfitted.fit(rows)
    except Exception as problem:  # whatever the specification led to
        if spec is None:
            raise
        trained, more = _fit_target(vectors, held, y, target, label_type, shared, None, task, classes, n)
        return trained, [*notes, f"{target}: {_reason(problem)}; using the default model", *more]
    model = without_summary(rows.sparkSession, model)
    trained = TrainedTarget(target, task, checked.algo, checked.params, shared, model, label_type, classes)
    trained.metrics = _metrics(model.transform(labelled(vectors)), task, classes)
    if held is not None:
        trained.metrics["holdout"] = _metrics(model.transform(labelled(held)), task, classes)
    return trained, notes


def _choose(spec, task: str, name: str, n: int, classes: int) -> tuple[CheckedSpec, Estimator, list[str]]:
    """The estimator to fit; the default one if the specification cannot be trained."""
    if isinstance(spec, Estimator):
        own = spec.copy()
        for param, column in (("featuresCol", VECTOR), ("labelCol", LABEL), ("predictionCol", PREDICTION), ("probabilityCol", PROBABILITY)):
            if own.hasParam(param):
                own.set(own.getParam(param), column)
        return CheckedSpec(type(spec).__name__, {}), own, []
    checked = check_spec(spec, task)
    notes = list(checked.notes)
    try:
        return checked, estimator(checked, n, classes), notes
    except Exception as problem:  # noqa: BLE001  a specification can hold any value
        notes.append(f"{name}: {_reason(problem)}; using the default model")
        checked = check_spec(DEFAULTS[task], task)
        return checked, estimator(checked, n, classes), notes


def _reason(problem: Exception) -> str:
    return (str(problem).splitlines() or [type(problem).__name__])[0]


def _metrics(scored: DataFrame, task: str, classes: list) -> dict:
    if task == REGRESS:
        r = regression_metrics(scored, LABEL, PREDICTION).first()
        return {"r2_score": r.r2, "mse": r.mse, "rmse": r.rmse}
    report = classification_report(
        scored.select(F.col(LABEL).cast("int"), F.col(PREDICTION).cast("int")), LABEL, PREDICTION
    ).collect()  # one row per class
    names = {str(i): str(c) for i, c in enumerate(classes)}
    table = {
        names.get(r["class"], r["class"]): {
            "precision": r.precision, "recall": r.recall, "f1-score": r.f1, "support": r.support
        }
        for r in report
        if r["class"] != "accuracy"
    }
    accuracy = next(r.precision for r in report if r["class"] == "accuracy")
    return {"accuracy": accuracy, "classification_report": table}


def _fit_clusters(vectors, shared, spec, n):
    checked, unfitted, notes = _choose(spec, CLUSTER, "cluster", n, 0)
    packed = not isinstance(spec, Estimator) and n > SMALL_ROWS and len(shared.slots) <= DENSE_SLOTS * len(shared.types)
    rows = vectors.select(VECTOR)
    seed = unfitted.getSeed()
    try:
        runs = [_fit_start(unfitted, rows, seed + i, packed, notes) for i in range(starts(checked))]
    except Exception as problem:  # noqa: BLE001
        if spec is None:
            raise
        trained, more = _fit_clusters(vectors, shared, None, n)
        return trained, [*notes, f"cluster: {_reason(problem)}; using the default model", *more]
    best = min(runs, key=lambda m: m.summary.trainingCost)
    trained = TrainedTarget(None, CLUSTER, checked.algo, checked.params, shared, best)
    trained.metrics = {"clusters": best.summary.k, "training_cost": best.summary.trainingCost, "passes": best.summary.numIter}
    return trained, notes


def _fit_start(unfitted, rows, seed, packed, notes):
    """A clustering from one start. Packed, the same passes go over blocks of rows; Spark can't do that from
    fewer centres than asked for, which it may find where few rows differ. Then it goes row by row."""
    start = unfitted.copy({unfitted.seed: seed})
    if packed:
        try:
            return start.copy({start.solver: "block"}).fit(rows)
        except Exception as problem:  # noqa: BLE001  whatever it was, the plain passes decide
            notes.append(f"cluster: {_reason(problem)}; going row by row")
    return start.fit(rows)


def cluster_summary(trained: TrainedTarget, df: DataFrame) -> DataFrame:
    """Per cluster: counts of every column and means of the numeric ones."""
    return group_summary(trained.predict(df), "cluster")
