"""CSV reading with the conventions of data-frame CSV readers.

Every cell is read as text, then missing-value tokens become null, then types are inferred
from one aggregation over the whole input.
"""

from __future__ import annotations

import csv
import io
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import stage
from tabloom.types import col

CORRUPT = "_corrupt_record"

# Cells read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

INTEGER = r"^\s*[+-]?\d+\s*$"
DECIMAL = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def file_layouts(spark: SparkSession, path: str) -> DataFrame:
    """``file, encoding, spans, head``: one row per file that has a line, from one split, distributed
    scan of the raw lines.

    A UTF-16 byte-order mark names that encoding, anything else that is not valid UTF-8 is read as
    Latin-1. A line with an odd number of quotes begins or ends a cell that spans lines; without
    one the file can be split. ``head`` stands for the bytes of the first line.
    """
    line = F.col("value")
    mark = F.hex(F.substring(line.cast("binary"), 1, 2)).isin("FFFE", "FEFF")
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    # the rows of one split are numbered in their order
    start = F.when((F.col("_metadata.file_block_start") == 0) & (F.octet_length(line) > 0), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.is_valid_utf8(line).alias("utf8"),
        mark.alias("mark"),
        (quotes % 2 == 1).alias("odd"),
        start.alias("at"),
        F.when(start.isNotNull(), F.md5(line.cast("binary"))).alias("digest"),
    )
    found = lines.groupBy("file").agg(
        F.bool_and("utf8").alias("utf8"),
        F.bool_or("mark").alias("utf16"),
        F.bool_or("odd").alias("spans"),
        F.min_by("digest", "at").alias("head"),
    )
    encoding = F.when(F.col("utf8"), "UTF-8").when(F.col("utf16"), "UTF-16").otherwise("ISO-8859-1")
    return found.select("file", encoding.alias("encoding"), "spans", "head")


def scan_layout(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], bool]:
    """Encoding -> files that are not valid UTF-8, and whether a quoted cell spans lines."""
    files = file_layouts(spark, path)
    spans = files.agg(F.bool_or("spans")).first()[0]
    found: dict[str, list[str]] = {}
    for r in files.where("encoding <> 'UTF-8'").toLocalIterator():
        found.setdefault(r.encoding, []).append(r.file)
    return found, bool(spans)


def unique_names(header: list[str | None]) -> list[str]:
    """Repeated names get .1, .2, …; empty ones are named by position."""
    names: list[str] = []
    for i, raw in enumerate(header):
        name = base = raw if raw else f"Unnamed: {i}"
        n = 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def _token_count(record: Column, sep: str) -> Column:
    unquoted = F.regexp_replace(record, r'"([^"]|"")*"', "")
    return F.size(F.split(unquoted, re.escape(sep), -1))


def _options(sep: str, encoding: str, multiline: bool) -> dict:
    return {
        "sep": sep,
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "columnPruning": False,  # pruned parsing would not notice rows of the wrong length
        "encoding": encoding,
        "multiLine": multiline or encoding == "UTF-16",
    }


def read_csv_text(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    header: bool = True,
    encoding: str = "UTF-8",
    multiline: bool = True,
) -> DataFrame:
    """All cells as text. Short rows are padded with nulls; a row with too many fields is an
    error when it is read. ``multiline=False`` lets Spark split large files, for data whose
    quoted cells hold no line breaks."""
    options = _options(sep, encoding, multiline)
    reader = spark.read.options(**options)
    first = reader.csv(path, header=False).first()
    if first is None:
        raise ValueError(f"no columns to read in {path}")
    width = len(first)
    names = unique_names(list(first)) if header else [f"_c{i}" for i in range(width)]
    raw = reader.schema(_text_schema(width)).csv(path, header=header)
    return _not_too_long(raw, width, sep).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def _text_schema(width: int) -> T.StructType:
    cells = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    return T.StructType([*cells, T.StructField(CORRUPT, T.StringType())])


def _not_too_long(raw: DataFrame, width: int, sep: str) -> DataFrame:
    record = F.col(CORRUPT)
    # naming a data column keeps the check legal in plans that need no column, such as count
    message = F.concat(F.lit(f"expected {width} fields: "), record, F.lit(" "), F.coalesce("c0", F.lit("")))
    too_long = record.isNotNull() & (_token_count(record, sep) > width)
    return raw.where(F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(True))


def _header_rows(spark: SparkSession, paths: list[str], sep: str, encoding: str, spans: bool) -> dict[str, list[str]]:
    """File -> column names, of one file for each layout, in one job."""
    # with a single column, a longer record comes whole as text
    raw = spark.read.options(**_options(sep, encoding, spans)).schema(_text_schema(1)).csv(paths, header=False)
    place = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    lines = raw.select(F.col("_metadata.file_path").alias("file"), place.alias("at"), F.struct("c0", CORRUPT).alias("line"))
    heads = lines.where("at IS NOT NULL").groupBy("file").agg(F.min_by("line", "at").alias("line")).collect()
    return {
        r.file: unique_names([r.line.c0] if r.line[CORRUPT] is None else next(csv.reader(io.StringIO(r.line[CORRUPT], newline=""), delimiter=sep)))
        for r in heads
    }


def _read_layouts(spark, path, names: list[str], known: DataFrame, sep: str, encoding: str, spans: bool) -> DataFrame:
    """Files of one encoding and any number of header orders, in one scan: ``known`` gives the place of
    each of ``names`` in every file."""
    width = len(names)
    raw = spark.read.options(**_options(sep, encoding, spans)).schema(_text_schema(width)).csv(path, header=True)
    rows = _not_too_long(raw.select("*", F.col("_metadata.file_path").alias("_file")), width, sep)
    cells = rows.select("_file", F.array(*[F.col(f"c{i}") for i in range(width)]).alias("_cells"))
    placed = cells.join(known.select(F.col("file").alias("_file"), "places"), "_file")
    return placed.select(*[F.get("_cells", F.get("places", F.lit(i))).alias(n) for i, n in enumerate(names)])


def infer_types(df: DataFrame) -> dict[str, T.DataType]:
    """Narrowest of bigint, double, boolean, string per text column, in one aggregation.

    An integer column with missing cells becomes double; a column without values too.
    """
    aggs = []
    for c in df.columns:
        x = col(c)
        aggs.append(
            F.struct(
                F.count("*").alias("rows"),
                F.count(x).alias("n"),
                F.count_if(x.rlike(INTEGER) & x.try_cast("bigint").isNotNull()).alias("ints"),
                F.count_if(x.rlike(DECIMAL)).alias("decimals"),
                F.count_if(x.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias("bools"),
            ).alias(f"s{len(aggs)}")
        )
    found: dict[str, T.DataType] = {}
    for c, s in zip(df.columns, df.agg(*aggs).first()):
        if s.ints == s.n == s.rows and s.n:
            found[c] = T.LongType()
        elif s.decimals == s.n:
            found[c] = T.DoubleType()
        elif s.bools == s.n:
            found[c] = T.BooleanType()
        else:
            found[c] = T.StringType()
    return found


def cast_types(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    return df.select(
        *[
            (F.trim(col(c)) if not isinstance(t, T.StringType) else col(c)).cast(t).alias(c)
            for c, t in types.items()
        ]
    )


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    encoding: str | None = None,
    multiline: bool | None = None,
    types: dict[str, T.DataType] | None = None,
) -> DataFrame:
    """Read CSV files: encodings, unique names, missing-value tokens, inferred types.

    One scan finds the layout of every file and a second one the types. Give ``encoding`` with
    ``multiline`` (all files then share one header), and ``types``, to skip them.
    """
    df = read_csv_cells(spark, path, sep, header, encoding, multiline)
    df = df.select(*[null_tokens(col(c)).alias(c) for c in df.columns])
    return cast_types(df, types or infer_types(df))


def read_csv_cells(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    encoding: str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """All cells as text. Columns are joined by name, and a file with other names is an error.

    Files of one encoding are read in one scan, however many orders of columns they have. Files without a line
    that isn't blank have no rows. Rows find the places of their cells by a join on the file; Spark sends that
    side, one row per file, to the tasks where it is small.
    """
    if encoding is not None and multiline is not None:
        return read_csv_text(spark, path, sep, header, encoding, multiline)
    # written once: the layouts are counted, then the files of each are listed
    files = stage(file_layouts(spark, path))
    by = [
        F.lit(encoding).alias("encoding") if encoding else F.col("encoding"),
        F.col("spans") if multiline is None else F.lit(multiline).alias("spans"),
        F.col("head") if header else F.lit("").alias("head"),
    ]
    # one row per layout, of fewer than the files, which the reader lists on the driver in any case
    found = files.groupBy(*by).agg(F.min("file").alias("file")).orderBy("file").collect()
    layouts = [one for one in found if one["head"] is not None]
    if len(layouts) <= 1:
        one = layouts[0] if layouts else None
        return read_csv_text(spark, path, sep, header, one.encoding if one else "UTF-8", bool(one and one.spans))
    known = files.select("file", *by).where("head IS NOT NULL")
    kinds: dict[tuple[str, bool], list] = {}
    for one in layouts:
        kinds.setdefault((one.encoding, one.spans), []).append(one)

    def paths(kind: tuple[str, bool]) -> list[str]:
        same = known.where((F.col("encoding") == kind[0]) & (F.col("spans") == kind[1]))
        return [_plain(row.file) for row in same.select("file").collect()]

    if not header:  # cells by position, so a layout is no more than an encoding
        parts = [read_csv_text(spark, paths(kind), sep, False, *kind) for kind in kinds]
        names = parts[0].columns
        for part, kind in zip(parts, kinds):
            if part.columns != names:
                raise ValueError(f"{kinds[kind][0].file} has {len(part.columns)} columns, other files have {len(names)}")
    else:
        heads: dict[str, list[str]] = {}
        for kind, same in kinds.items():
            heads |= _header_rows(spark, [_plain(one.file) for one in same], sep, *kind)
        names = heads[layouts[0].file]
        for one in layouts:
            if set(heads[one.file]) != set(names):
                raise ValueError(f"{one.file} has columns {heads[one.file]}, other files have {names}")
        placed = [
            (one.encoding, one.spans, one["head"], [at[n] for n in names])
            for one in layouts
            for at in [{n: i for i, n in enumerate(heads[one.file])}]
        ]
        orders = spark.createDataFrame(placed, "encoding string, spans boolean, head string, places array<int>")
        located = stage(known.join(orders, ["encoding", "spans", "head"]).select("file", "places"))
        parts = [_read_layouts(spark, path if len(kinds) == 1 else paths(kind), names, located, sep, *kind) for kind in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _plain(uri: str) -> str:
    """The path a reader takes: listed names are URIs, with blanks and the like escaped."""
    return re.sub("^file:/+", "/", unquote(uri))
