"""Reading by file extension, source information, and sinks."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.examples import format_examples
from tabloom.sources.delimited import read_csv
from tabloom.sources.excel import read_excel
from tabloom.types import col, nan_to_null


@dataclass
class SourceInfo:
    filename: str
    extension: str
    dtypes: dict[str, str]
    table: DataFrame

    @property
    def shape(self) -> tuple[int, int]:
        """Rows and columns; counting the rows is a job of its own."""
        return self.table.count(), len(self.dtypes)


def _extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> tuple[DataFrame, SourceInfo]:
    """Read a file or folder by its extension, or as ``fmt`` where the path has none."""
    extension = f".{fmt.lstrip('.')}" if fmt else _extension(path)
    if extension == ".csv":
        df = read_csv(spark, path, **options)
    elif extension == ".xlsx":
        df = read_excel(spark, path)
    elif extension == ".parquet":
        df = spark.read.parquet(path)
    elif extension in (".json", ".jsonl"):
        df = read_jsonl(spark, path, **options)
    else:
        raise ValueError(f"Unsupported file type: {extension}")
    df = nan_to_null(df)
    return df, SourceInfo(os.path.basename(path.rstrip("/")), extension, dict(df.dtypes), df)


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON object per line; give a schema to skip the inference scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV parts, each with a header."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def write_jsonl(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSONL parts from a one-column text table."""
    lines.select("value").write.mode(mode).text(path)


def publish_dataset(
    df: DataFrame, path: str, text_cols, label_cols=None, fmt: str = "both", mode: str = "errorifexists"
) -> str:
    """Write the examples to ``path/data.jsonl`` (a folder of parts), instruction lines if
    they were asked for, else chat lines. Returns the folder."""
    lines = format_examples(df, text_cols, label_cols, fmt)
    target = f"{path.rstrip('/')}/data.jsonl"
    write_jsonl(lines.get("instruction", lines.get("chat")), target, mode)
    return target


def rounded(df: DataFrame, digits: int, cols=None) -> DataFrame:
    """Floating-point columns rounded for display."""
    names = set(cols or [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")])

    def show(name: str) -> Column:
        return F.round(col(name), digits).alias(name) if name in names else col(name)

    return df.select(*[show(c) for c in df.columns])
