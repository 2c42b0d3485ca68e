"""The published training and prediction timings, at their size, for bench.py only.

50,000 rows, 10 features, 6 targets; a 5,000-row sample; 2 targets; one row and 1,000 rows
predicted. The timed model is the default one: 100 trees of depth 10.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import table
from tabloom.operators.metrics import flatten_metrics
from tabloom.operators.ordering import sample_rows
from tabloom.plans.ensemble import train
from tabloom.session import stage
from tabloom.types import Roles

ROWS = 50_000
TARGETS = ["l_returnflag", "l_linestatus", "l_linenumber", "band", "late", "bulk"]
FEATURES = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "charge", "month", "weekday",
]
_staged: dict = {}


def _lines(spark, folder):
    """50,000 order lines with ten features and six class targets, written once."""
    if folder not in _staged:
        lines = table(spark, folder, "lineitem").select(
            "*",
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("charge"),
            F.month("l_shipdate").alias("month"),
            F.dayofweek("l_shipdate").alias("weekday"),
            F.floor(F.col("l_extendedprice") / 20_000).cast("int").alias("band"),
            (F.month("l_shipdate") > 6).cast("int").alias("late"),
            (F.col("l_quantity") > 25).cast("int").alias("bulk"),
        )
        picked = sample_rows(lines, ROWS).repartition(spark.sparkContext.defaultParallelism)
        _staged[folder] = stage(picked.select(*FEATURES, *TARGETS))
    return _staged[folder]


def _train(spark, folder, targets, full):
    fitted = train(_lines(spark, folder), Roles(FEATURES, targets), full=full, targets=targets)
    return flatten_metrics(spark, fitted.metrics)


def train_6_targets_50k(spark, folder):
    return _train(spark, folder, TARGETS, True)


def train_2_targets_50k(spark, folder):
    return _train(spark, folder, TARGETS[:2], True)


def train_5k_sample(spark, folder):
    return _train(spark, folder, TARGETS[:1], False)


def predict_1000_rows(spark, folder):
    if "model" not in _staged:
        lines = _lines(spark, folder)
        fitted = train(lines, Roles(FEATURES, TARGETS), targets=TARGETS[:1])
        _staged["model"] = fitted[TARGETS[0]], stage(lines.limit(1000))
    model, rows = _staged["model"]
    return model.predict(rows)


SCENARIOS = {
    "prepare_50k": lambda spark, folder: _lines(spark, folder),
    "train_6_targets_50k": train_6_targets_50k,
    "train_2_targets_50k": train_2_targets_50k,
    "train_5k_sample": train_5k_sample,
    "train_model_for_prediction": predict_1000_rows,
    "predict_1000_rows": predict_1000_rows,
}
