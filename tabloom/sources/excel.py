"""A folder of .xlsx workbooks as one table: first sheet, header in the first row.

Spark has no workbook reader. Files are distributed over tasks by ``binaryFile`` and each
workbook is read as a stream of rows inside its task.
"""

from __future__ import annotations

import hashlib
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.sources.delimited import cast_types, infer_types, null_tokens, unique_names
from tabloom.session import stage
from tabloom.types import col

ROW_SCHEMA = "path string, row long, layout string, width int, cells array<struct<text:string,kind:string>>"
FIELDS = ["path", "row", "layout", "width", "cells"]
ROWS_PER_BATCH = 10_000

# Fixed values of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMAT_IDS = {*range(14, 23), *range(45, 48)}
EPOCH = datetime(1899, 12, 30)

# the reading functions travel to the tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _tree(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = _tree(book, "xl/workbook.xml").find(f"{MAIN}sheets/{MAIN}sheet")
    for rel in _tree(book, "xl/_rels/workbook.xml.rels"):
        if rel.get("Id") == sheet.get(f"{RELS}id"):
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("workbook without a first sheet")


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    styles = _tree(book, "xl/styles.xml")
    if styles is None:
        return set()
    custom = {
        int(f.get("numFmtId"))
        for f in styles.iter(f"{MAIN}numFmt")
        if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))
    }
    formats = styles.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in (formats if formats is not None else [])]
    return {i for i, f in enumerate(ids) if f in DATE_FORMAT_IDS or f in custom}


def _column(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def workbook_rows(content: bytes) -> Iterator[list[tuple[str | None, str]]]:
    """Rows of (text, kind) cells; kind is n(umber), s(tring), b(oolean) or d(ate)."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _tree(book, "xl/sharedStrings.xml")
        shared = [_text(s) for s in strings.iter(f"{MAIN}si")] if strings is not None else []
        dates = _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                cells: dict[int, tuple[str | None, str]] = {}
                for position, cell in enumerate(row.iter(f"{MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else position
                    cells[at] = _cell(cell, shared, dates)
                yield [cells.get(i, (None, "s")) for i in range(max(cells, default=-1) + 1)]
                row.clear()


def _cell(cell, shared: list[str], dates: set[int]) -> tuple[str | None, str]:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell), "s"
    raw = cell.findtext(f"{MAIN}v")
    if raw is None or kind == "e":
        return None, "s"
    if kind == "s":
        return shared[int(raw)], "s"
    if kind == "b":
        return ("True" if raw == "1" else "False"), "b"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        moment = EPOCH + timedelta(microseconds=round(float(raw) * 86_400_000_000))
        return moment.isoformat(sep=" "), "d"
    return raw, ("n" if kind == "n" else "s")


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows, layout = [], ""
            for number, cells in enumerate(workbook_rows(content)):
                if number == 0:
                    layout = hashlib.md5(repr([t for t, _ in cells]).encode()).hexdigest()
                width = max((i for i, (t, _) in enumerate(cells, 1) if t is not None), default=0)
                rows.append((path, number, layout, width, [{"text": t, "kind": k} for t, k in cells]))
                if len(rows) == ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=FIELDS)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=FIELDS)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """One table from a workbook or a folder of workbooks with the same column names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return workbook_table(files)


# --- workbooks by a given schema, also as they arrive ------------------------------------------

ALIGNED = "path string, row long, error string, cells array<string>"
RESCUED = "struct<path:string,row:bigint,error:string,cells:map<string,string>>"


def _aligner(names: list[str]):
    """Rows of books with their cells in the order of ``names``, whatever the order in the book."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows, at = [], None
                try:
                    for number, cells in enumerate(workbook_rows(content)):
                        if at is None:
                            header = unique_names([t for t, _ in cells])
                            if missing := [n for n in names if n not in header]:
                                raise ValueError(f"columns {missing} are missing")
                            at = [header.index(n) for n in names]
                            continue
                        if not any(t is not None for t, _ in cells):
                            continue
                        placed = [cells[i][0] if i < len(cells) else None for i in at]
                        rows.append((path, number, None, placed))
                        if len(rows) == ROWS_PER_BATCH:
                            yield pd.DataFrame(rows, columns=["path", "row", "error", "cells"])
                            rows = []
                except Exception as error:  # a damaged book is a row with an error
                    rows.append((path, None, f"{type(error).__name__}: {error}", None))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "row", "error", "cells"])

    return align


def workbook_rows_as(files: DataFrame, schema: str | T.StructType, rescued: str | None = None) -> DataFrame:
    """Rows of workbooks given as ``path`` and ``content``, cast to a schema: one narrow pass, so it runs on streams.

    Columns are found by name in each book's own header, in any order; further columns are left out. Cells are
    read as by ``read_excel`` (missing-value tokens are null, blank rows are skipped, a book without rows adds none).
    A cell that is no value of its type (for whole numbers, ``3.0`` is 3 and ``3.5`` is none), a book that lacks a column and a
    damaged book are errors that name the book and row. With ``rescued`` they are kept instead: that column holds the path, the row
    (from 0, the header included), the error and the texts that did not fit, null where all is well, and a damaged
    book gives one row of nulls after the rows read before the damage.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in wanted]
    if rescued in names:
        raise ValueError(f"{rescued!r} is a column of the schema")
    rows = files.select("path", "content").mapInPandas(_aligner(names), ALIGNED)
    texts = {n: null_tokens(F.get("cells", F.lit(i))) for i, n in enumerate(names)}
    values = {f.name: _cast(texts[f.name], f.dataType) for f in wanted}
    unfit = F.array_compact(
        F.array(*[F.when(texts[n].isNotNull() & values[n].isNull(), F.struct(F.lit(n).alias("k"), texts[n].alias("v"))) for n in names])
    )
    out = rows.select(
        "path", "row", "error", *[values[n].alias(f"_v{i}") for i, n in enumerate(names)], F.map_from_entries(unfit).alias("_unfit")
    )
    wrong = F.col("error").isNotNull() | (F.size("_unfit") > 0)
    if rescued:
        kept = F.when(wrong, F.struct("path", "row", "error", F.col("_unfit").alias("cells")).cast(RESCUED))
        extra = [kept.alias(rescued)]
    else:
        told = F.coalesce("error", F.concat(F.lit("row "), F.col("row"), F.lit(": "), F.to_json("_unfit")))
        out, extra = out.where(F.when(wrong, F.raise_error(F.concat("path", F.lit(": "), told)).cast("boolean")).otherwise(True)), []
    return out.select(*[F.col(f"_v{i}").alias(n) for i, n in enumerate(names)], *extra)


def _cast(text, kind: T.DataType):
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegralType):
        exact = F.trim(text).try_cast("decimal(38,10)")  # workbooks write whole numbers as 3, 3.0 or 3E0
        return F.when(exact == F.floor(exact), exact).try_cast(kind)
    return F.trim(text).try_cast(kind)


def read_excel_as(spark: SparkSession, path: str, schema: str | T.StructType, rescued: str | None = None) -> DataFrame:
    """A workbook or a folder of them by a schema, without the scans that find one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return workbook_rows_as(files, schema, rescued)


def stream_excel(
    spark: SparkSession, path: str, schema: str | T.StructType, rescued: str | None = None, files_per_batch: int = 1_000
) -> DataFrame:
    """Workbooks as they arrive in a folder; each is read once, by the stream's checkpoint."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.xlsx")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return workbook_rows_as(files, schema, rescued)


def workbook_table(files: DataFrame) -> DataFrame:
    """One table from workbooks given as ``path`` and ``content`` columns.

    Columns are joined by name, in the order of the first workbook; one with other names is an
    error. Any number of orders of columns is read. Cells beyond the header get names by position. Books are parsed once, into a staged table.
    """
    rows = stage(files.select("path", "content").mapInPandas(_read_batches, ROW_SCHEMA))
    layouts = (
        rows.groupBy("layout")
        .agg(
            F.max("width").alias("width"),
            F.min(F.when(F.col("row") == 0, F.struct("path", F.transform("cells", lambda c: c["text"]).alias("names")))).alias("top"),
        )
        .orderBy("top.path")
        .collect()
    )
    if not layouts:
        raise ValueError("no workbook with a header row")
    found = {}
    for one in layouts:
        header = [t for t in one.top.names]
        found[one.layout] = unique_names(header + [None] * (one.width - len(header)))
    given = [{n for n in names if not n.startswith("Unnamed: ")} for names in found.values()]
    for one, own in zip(layouts, given):
        if own != given[0]:
            raise ValueError(f"{one.top.path} has columns {sorted(own)}, other workbooks have {sorted(given[0])}")
    names = list(dict.fromkeys(n for each in found.values() for n in each))

    body = rows.where("row > 0")
    if len(found) == 1:
        body = body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    else:  # the places of the cells come with the layout, so that any number of them is one plan
        placed = [
            (layout, [at.get(n) for n in names])
            for layout, own in found.items()
            for at in [{n: i for i, n in enumerate(own)}]
        ]
        places = stage(rows.sparkSession.createDataFrame(placed, "layout string, places array<int>"))
        body = body.join(places, "layout").select(
            *[F.get("cells", F.get("places", F.lit(i))).alias(n) for i, n in enumerate(names)]
        )
    body = body.where(" or ".join("`" + n.replace("`", "``") + "`.text is not null" for n in names))
    kinds = body.agg(
        *[
            F.struct(
                F.count(col(n)["text"]).alias("n"),
                F.count_if(col(n)["text"].isNotNull() & (col(n)["kind"] == "d")).alias("dates"),
                F.count_if(col(n)["text"].isNotNull() & (col(n)["kind"] == "s")).alias("strings"),
            ).alias(f"k{i}")
            for i, n in enumerate(names)
        ]
    ).first()
    text = body.select(*[null_tokens(col(n)["text"]).alias(n) for n in names])
    types = infer_types(text)
    for n, k in zip(names, kinds):
        if k.n and k.dates == k.n:
            types[n] = T.TimestampNTZType()
        elif k.strings and not isinstance(types[n], T.StringType):
            types[n] = T.StringType()  # numbers typed as text stay text in a workbook
    return cast_types(text, types)
