"""One recipe over many tables: each is fitted and written on its own, and a restart does only what is missing.

A table's output is a new folder, and its manifest entry, one small JSON file put in place by a rename after the
output is complete, names that folder. Readers go through the entry, so they never see half a table. Entries hold a
fingerprint of the source files and the recipe; a table is done again only when one of them has changed.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabloom.plans.recipe import CleanRecipe, FittedRecipe
from tabloom.session import staging
from tabloom.sources.files import read_table

REPORT = "table string, state string, rows long, columns int, path string, error string"
ERROR_CHARACTERS = 2_000


@dataclass
class Source:
    """A table to clean: a path for ``read_table``, or a function of the session with the ``version`` of what it
    returns. ``recipe`` replaces the common recipe for this table, ``columns`` keeps some of its columns."""

    path: str | None = None
    fmt: str | None = None
    options: dict = field(default_factory=dict)
    load: Callable[[SparkSession], DataFrame] | None = None
    version: str | None = None
    recipe: CleanRecipe | None = None
    columns: list[str] | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        rows = self.load(spark) if self.load else read_table(spark, self.path, self.fmt, **self.options)[0]
        return rows.select(*self.columns) if self.columns else rows

    def fingerprint(self, spark: SparkSession, recipe: CleanRecipe) -> str:
        """Digest of the recipe, the way of reading and the names, sizes and times of the source files."""
        if self.load and self.version is None:
            raise ValueError("a table given as a function needs a version that tells when it changed")
        state = self.version if self.version is not None else files_state(spark, self.path)
        told = [recipe.to_json(), self.path, self.fmt, self.options, self.columns, state]
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


def files_state(spark: SparkSession, path: str) -> list:
    """Count, bytes, newest time and a combined hash of the files below ``path``; no content is read, and the list
    of files stays on the cluster."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mark = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(
        F.count("*"), F.sum("length"), F.max("modificationTime").cast("string"), F.bit_xor(mark), F.sum(mark % 1_000_003)
    ).first()
    return list(row)


def clean_tables(
    spark: SparkSession, tables: Mapping[str, Source], out: str, recipe: CleanRecipe | None = None, at_once: int = 4
) -> DataFrame:
    """Fit and apply a recipe to every table and write them below ``out``: one report row per table.

    ``state`` is ``done``, ``skipped`` (an earlier run wrote it from the same files by the same recipe) or ``failed``
    with the error. A failing table fails alone and leaves its earlier output in place; the next run tries it again.
    At most ``at_once`` tables are worked on at the same time, so that the tasks of a small one fill the gaps of a
    large one. The output before the last stays for readers that have it open; older and unfinished ones go.
    An empty mapping gives an empty report. Two runs into one folder at the same time are not supported.
    """
    for name in tables:
        if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", name):
            raise ValueError(f"{name!r} can't name a folder: use letters, digits, dots, hyphens and underscores")
    if at_once < 1:
        raise ValueError("at_once must be 1 or more")
    common = recipe or CleanRecipe()

    def work(name: str) -> tuple:
        source = tables[name]
        try:
            return _clean_one(spark, name, source, source.recipe or common, out.rstrip("/"))
        except Exception as error:  # reported in its row
            return name, "failed", None, None, None, f"{type(error).__name__}: {error}"[:ERROR_CHARACTERS]

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        # a wrapper for each table: it carries the properties of this thread into the worker
        running = [pool.submit(inheritable_thread_target(spark)(work), name) for name in tables]
        report = [one.result() for one in running]
    return spark.createDataFrame(report, REPORT)


def _clean_one(spark: SparkSession, name: str, source: Source, recipe: CleanRecipe, out: str) -> tuple:
    mark = source.fingerprint(spark, recipe)
    before = entry(spark, out, name)
    if before and before["fingerprint"] == mark:
        return name, "skipped", before["rows"], before["columns"], before["path"], None
    path = f"{out}/{name}/{uuid.uuid4().hex}"
    with staging(spark):
        fitted, clean = recipe.fit_transform(source.read(spark))
        clean.write.parquet(path)
        written = spark.read.schema(clean.schema).parquet(path)
        found = {
            "table": name,
            "fingerprint": mark,
            "path": path,
            "rows": written.count(),
            "columns": len(written.columns),
            "schema": clean.schema.json(),
            "fitted": fitted.to_json(),
        }
    _put(spark, out, name, found)
    _keep(spark, f"{out}/{name}", {path, before["path"]} if before else {path})
    return name, "done", found["rows"], found["columns"], path, None


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _entry_path(out: str, name: str) -> str:
    return f"{out.rstrip('/')}/_manifest/{name}.json"


def _put(spark: SparkSession, out: str, name: str, found: dict) -> None:
    """Write the entry beside its place and rename it; without an entry the table counts as not done."""
    files, place = _hadoop(spark, _entry_path(out, name))
    _, beside = _hadoop(spark, f"{_entry_path(out, name)}.{uuid.uuid4().hex}.new")
    stream = files.create(beside, True)
    stream.write(bytearray(json.dumps(found).encode()))
    stream.close()
    files.delete(place, False)
    if not files.rename(beside, place):
        raise OSError(f"the manifest entry {place.toString()} can't be put in place")


def _keep(spark: SparkSession, folder: str, paths: set[str]) -> None:
    files, where = _hadoop(spark, folder)
    names = {p.rsplit("/", 1)[1] for p in paths}
    for status in files.listStatus(where):
        if status.getPath().getName() not in names:
            files.delete(status.getPath(), True)


def entry(spark: SparkSession, out: str, name: str) -> dict | None:
    """The manifest entry of a table, or None."""
    files, place = _hadoop(spark, _entry_path(out, name))
    if not files.exists(place):
        return None
    return json.loads(spark.read.text(_entry_path(out, name), wholetext=True).first()[0])


def _done(spark: SparkSession, out: str, name: str) -> dict:
    found = entry(spark, out, name)
    if found is None:
        raise ValueError(f"{name} has not been cleaned into {out}")
    return found


def read_cleaned(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The newest complete output of a table."""
    found = _done(spark, out, name)
    return spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(found["path"])


def fitted_recipe(spark: SparkSession, out: str, name: str) -> FittedRecipe:
    """The recipe as it was fitted on a table, for rows that arrive later."""
    return FittedRecipe.from_json(_done(spark, out, name)["fitted"])
