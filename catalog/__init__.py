"""Registered queries: name -> (Spark query, equivalent SQL or None)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def rounded(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def load() -> dict:
    from catalog import batches, cleaning, exploring, formatting, modelling, profiling, reading, versions  # noqa: F401

    return QUERIES
