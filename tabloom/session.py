"""Session set-up and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tabloom", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Session with the settings the library relies on.

    Sizes (shuffle partitions, memory, split size) are left to the cluster; AQE
    coalesces small shuffles and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a cluster a
    machine-local folder would be lost together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tabloom-stage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_owned: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are deleted at its end, so nothing lazy may leave it that
    still reads them. Tables staged elsewhere stay until the shared folder is cleaned."""
    owned: list[str] = []
    token = _owned.set(owned)
    try:
        yield
    finally:
        _owned.reset(token)
        for path in owned:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted at the end of the ``staging`` block it was asked for in."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    if (owned := _owned.get()) is not None:
        owned.append(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Later jobs scan only the columns they need and never repeat the shuffle behind ``df``;
    a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
