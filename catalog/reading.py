"""Sources and sinks, over files that Spark writes from the given tables."""

from __future__ import annotations

import io
import sys
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from catalog import query, table
from catalog.cleaning import SPACES
from catalog.dirt import DIRTY_EVENTS, dirty_events, duck
from tabloom.functions.examples import format_examples
from tabloom.plans.recipe import CleanRecipe
from tabloom.session import checkpoint_dir
from tabloom.sources import files
from tabloom.sources.excel import workbook_rows_as, workbook_table
from tabloom.streaming.apply import clean_stream, write_stream

# the two task functions below travel to the executors with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    f"""WITH t AS {duck(DIRTY_EVENTS)}
SELECT event_id, user_id, CASE WHEN event_type = ' N/A ' THEN ' N/A ' ELSE event_type END AS event_type, value, sparse, day FROM t"""
)
def csv_round_trip(spark, folder):
    events = dirty_events(spark, folder).select("event_id", "user_id", "event_type", "value", "sparse", "day")
    path = _scratch(spark, "csv")
    events.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_table(spark, path, fmt="csv")[0]


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_text_round_trip(spark, folder):
    path = _scratch(spark, "csv")
    files.write_csv(table(spark, folder, "documents"), path)
    return files.read_table(spark, path, fmt="csv")[0]


@query(
    """SELECT c_custkey AS "id", c_name AS "name", c_mktsegment AS "name.1",
   CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey::DOUBLE END AS nation, c_acctbal > 0 AS rich FROM customer"""
)
def csv_headers_and_types(spark, folder):
    customer = table(spark, folder, "customer").select(
        "c_custkey",
        "c_name",
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("string")).otherwise("NaN"),
        F.when(F.col("c_acctbal") > 0, "True").otherwise("False"),
    )
    path = _scratch(spark, "csv")
    # every part begins with the header, which repeats a name
    lines = customer.select(F.concat_ws(",", *customer.columns).alias("value"))
    lines.mapInPandas(_with_header, "value string").write.text(path)
    return files.read_table(spark, path, fmt="csv")[0]


def _with_header(batches):
    yield pd.DataFrame({"value": ["id,name,name,nation,rich"]})
    yield from batches


@query(
    """SELECT text AS instruction, lang AS output FROM documents"""
)
def jsonl_round_trip(spark, folder):
    target = files.publish_dataset(table(spark, folder, "documents"), _scratch(spark, "dataset"), ["text"], ["lang"])
    return files.read_jsonl(spark, target, "instruction string, output string")


@query(
    """SELECT 'instruction' AS format, count(*) AS lines FROM conversations
UNION ALL SELECT 'chat', count(*) FROM conversations"""
)
def format_both(spark, folder):
    made = format_examples(table(spark, folder, "conversations"), ["text"], ["role"], "both")
    counts = [d.agg(F.lit(name).alias("format"), F.count("value").alias("lines")) for name, d in made.items()]
    return counts[0].unionAll(counts[1])


def _workbook(pdf: pd.DataFrame) -> pd.DataFrame:
    """One nation's customers as the bytes of a small workbook."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006/relationships"

    def row(cells):
        text = lambda c: f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>'
        return "<row>" + "".join(text(c) if isinstance(c, str) else f"<c><v>{c!r}</v></c>" for c in cells) + "</row>"

    names = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    lines = [row(names)] + [
        row([int(r.c_custkey), r.c_name, float(r.c_acctbal), r.c_mktsegment]) for r in pdf.itertuples()
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{doc}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return pd.DataFrame({"path": [f"{pdf.book.iloc[0]}.xlsx"], "content": [out.getvalue()]})


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def excel_workbooks(spark, folder):
    # books of about a thousand rows, so that no group grows with the table
    customer = table(spark, folder, "customer").withColumn("book", F.floor(F.col("c_custkey") / 1000))
    books = customer.groupBy("book").applyInPandas(_workbook, "path string, content binary")
    return workbook_table(books)


@query("SELECT c_custkey::INTEGER AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def stream_workbooks(spark, folder):
    """Workbooks of about a thousand customers each, read by a schema as they arrive."""
    customer = table(spark, folder, "customer").withColumn("book", F.floor(F.col("c_custkey") / 1000))
    books = customer.groupBy("book").applyInPandas(_workbook, "path string, content binary")
    arriving = spark.readStream.schema(books.schema).parquet(_written(spark, books))
    schema = "c_custkey int, c_name string, c_acctbal double, c_mktsegment string"
    out = _scratch(spark, "out")
    write_stream(workbook_rows_as(arriving, schema), out, _scratch(spark, "progress"), once=True).awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query(
    f"""WITH t AS {duck(DIRTY_EVENTS)},
 n AS (SELECT event_id, CASE WHEN lower(trim(event_type, {SPACES})) IN ('n/a') THEN NULL ELSE event_type END AS event_type, value FROM t),
 f AS (SELECT event_id, coalesce(event_type, (SELECT event_type FROM n WHERE event_type IS NOT NULL GROUP BY 1
     ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM n)) AS value FROM n)
SELECT event_id, lower(trim(event_type, {SPACES})) AS event_type, value FROM f
WHERE NOT abs(value - (SELECT avg(value) FROM f)) / (SELECT stddev_samp(value) FROM f) > 3"""
)
def stream_recipe(spark, folder):
    """A recipe fitted on the table, applied to the same rows as a stream."""
    events = dirty_events(spark, folder).select("event_id", "event_type", "value")
    recipe = CleanRecipe(
        deduplicate=False, replace_placeholder_nulls=True, lowercase_text=True, remove_outliers=True, audit=False
    )
    fitted = recipe.fit(events)
    source = spark.readStream.schema(events.schema).parquet(_written(spark, events))
    out = _scratch(spark, "out")
    write_stream(clean_stream(source, fitted), out, _scratch(spark, "progress"), once=True).awaitTermination()
    return spark.read.schema(fitted.transform(events).schema).parquet(out)


def _written(spark, df) -> str:
    path = _scratch(spark, "in")
    df.write.parquet(path)
    return path


@query("SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, value FROM events")
def stream_dedup(spark, folder):
    """Every event arrives twice; the copies are dropped within the watermark."""
    events = table(spark, folder, "events").drop("props")
    path = _written(spark, events.unionAll(events))
    fitted = CleanRecipe(
        drop_high_null=False, impute=False, strip_whitespace=False, parse_dates=False, audit=False
    ).fit(events)
    source = spark.readStream.schema(events.schema).parquet(path)
    out = _scratch(spark, "out")
    stream = clean_stream(source, fitted, "ts", "60 days", subset=["event_id"])
    write_stream(stream, out, _scratch(spark, "progress"), once=True).awaitTermination()
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    """SELECT c_custkey, 'latin' AS source, c_name || ' é£ÿ' AS name, c_acctbal FROM customer
UNION ALL SELECT c_custkey, 'wide', c_name || ' 東京 ž', c_acctbal FROM customer"""
)
def csv_charsets(spark, folder):
    """Latin-1 and UTF-16 files read back without naming their encoding."""
    customer = table(spark, folder, "customer")
    parts = []
    for source, encoding, mark in (("latin", "ISO-8859-1", " é£ÿ"), ("wide", "UTF-16", " 東京 ž")):
        path = _scratch(spark, f"csv-{source}")
        rows = customer.select("c_custkey", F.concat("c_name", F.lit(mark)).alias("name"), "c_acctbal")
        rows.write.csv(path, header=True, encoding=encoding)
        parts.append(files.read_table(spark, path, fmt="csv")[0].select("c_custkey", F.lit(source).alias("source"), "name", "c_acctbal"))
    return parts[0].unionAll(parts[1])


@query(
    """SELECT 'customer.parquet' AS filename, '.parquet' AS extension, column_name AS "column",
 CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type,
 (SELECT count(*) FROM customer) AS rows, 5 AS columns FROM (DESCRIBE customer) t(column_name, data_type, a, b, c, d)
UNION ALL SELECT 'customer.yaml', '.yaml', NULL, 'Unsupported file type: .yaml', NULL, NULL"""
)
def source_information(spark, folder):
    """What is known of a read file, and the message for an extension that can't be read."""
    _, info = files.read_table(spark, f"{folder}/customer.parquet")
    rows, columns = info.shape
    found = [(info.filename, info.extension, c, t, rows, columns) for c, t in info.dtypes.items()]
    try:
        files.read_table(spark, f"{folder}/customer.yaml")
    except ValueError as problem:
        found.append(("customer.yaml", ".yaml", None, str(problem), None, None))
    return spark.createDataFrame(found, "filename string, extension string, column string, type string, rows long, columns int")
