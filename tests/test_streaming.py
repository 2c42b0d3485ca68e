"""A fitted recipe or model gives the same rows on a stream as on a table."""

import pytest
from pyspark.sql import functions as F

from tabloom.functions.examples import to_chat_jsonl
from tabloom.plans.ensemble import train
from tabloom.plans.recipe import CleanRecipe
from tabloom.operators.drift import fit_bins
from tabloom.streaming.apply import clean_stream, score_stream, write_stream
from tabloom.streaming.monitor import COUNTS, late_groups, monitor, window_counts, window_scores
from tabloom.types import Roles


def dirty_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 5 == 0, " N/A ").otherwise(F.concat(F.lit(" "), F.upper("event_type"))).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_recipe_model_and_format_on_a_stream(spark, sf_dir, tmp_path):
    batch = dirty_events(spark, sf_dir)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    fitted, cleaned = CleanRecipe(
        replace_placeholder_nulls=True, lowercase_text=True, remove_empty_rows=True, remove_outliers=True
    ).fit_transform(batch)
    model = train(cleaned, Roles(["value"], ["event_type"]), spec={"algo": "DecisionTreeClassifier"})["event_type"]

    source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    stream = score_stream(clean_stream(source, fitted, "ts", "60 days"), model)
    query = write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    query.awaitTermination(300)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert rows(streamed) == rows(model.predict(cleaned))

    lines = to_chat_jsonl(source, ["event_type"], ["value"])
    query = write_stream(lines, str(tmp_path / "lines"), str(tmp_path / "cp2"), fmt="text", once=True)
    query.awaitTermination(300)
    assert rows(spark.read.text(str(tmp_path / "lines"))) == rows(to_chat_jsonl(batch, ["event_type"], ["value"]))


def test_stream_drops_copies_within_the_watermark(spark, sf_dir, tmp_path):
    batch = dirty_events(spark, sf_dir)
    batch.unionAll(batch).repartition(2).write.parquet(str(tmp_path / "in"))
    fitted = CleanRecipe(impute=False, parse_dates=False, strip_whitespace=False, drop_high_null=False).fit(batch)
    source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    out = clean_stream(source, fitted, "ts", "60 days", subset=["event_id"])
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_staging_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from tabloom.session import checkpoint_dir

    def session(master, folder):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder),
            sparkContext=SimpleNamespace(master=master),
        )

    assert checkpoint_dir(session("spark://host", "/shared")) == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session("spark://host", None))


def test_monitor_by_window(spark, tmp_path):
    schema = "id int, at timestamp, kind string, x double"

    def arrive(name, rows_):
        from datetime import datetime

        made = [(i, m if m is None else datetime(2024, 1, 1, m // 60, m % 60), kind, x) for i, m, kind, x in rows_]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return made

    def run():
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = monitor(source, bins, "at", str(tmp_path / "out"), str(tmp_path / "cp"), "1 hour", "30 minutes", once=True)
        query.awaitTermination(300)
        return query

    first = arrive("a", [(i, 2 * i, "ab"[i % 2], float(i) if i % 5 else None) for i in range(90)] + [(900, None, "a", 1.0)])
    before = spark.createDataFrame(first, schema)
    bins = fit_bins(before, ["kind", "x"], bins=4)
    on_time = lambda made: spark.createDataFrame(made, schema)
    closed = lambda made, until: sorted(
        (tuple(r) for r in window_counts(on_time(made), bins, "at").where(f"window_end <= timestamp'{until}'").collect()), key=str
    )
    stored = lambda: sorted((tuple(r) for r in spark.read.schema(COUNTS).parquet(str(tmp_path / "out")).collect()), key=str)
    run()
    assert stored() == closed(first, "2024-01-01 02:28:00") and len({r[0] for r in stored()}) == 2
    run()  # nothing new: nothing is repeated
    assert stored() == closed(first, "2024-01-01 02:28:00")
    # a row of a closed hour, one of an open hour, and rows that close it
    second = arrive("b", [(1, 30, "late", 5.0), (2, 130, "new", None), (3, 300, "a", 2.0)])
    assert late_groups(run()) > 0
    assert stored() == closed(first + second[1:], "2024-01-01 04:30:00")
    scores = {(r.window_start.hour, r.column): r for r in window_scores(spark, str(tmp_path / "out"), bins).collect()}
    assert set(scores) == {(h, c) for h in range(3) for c in ("kind", "x")}
    assert scores[0, "x"].n_after == 30 and scores[0, "x"].missing_after == 0.2
    # all 24 numbers of the first hour, and 37 of the 73 fitted ones, are up to the median
    assert scores[0, "x"].ks == pytest.approx(36 / 73)
    assert scores[2, "kind"].n_after == 31 and scores[2, "kind"].unlisted_after == 1 / 31


def test_monitor_needs_a_delay_on_a_stream_and_takes_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "at timestamp, x double")
    bins = fit_bins(spark.createDataFrame([(None, 1.0), (None, 2.0)], "at timestamp, x double"), ["x"])
    assert window_counts(empty, bins, "at").count() == 0
    empty.write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="delay"):
        window_counts(spark.readStream.schema(empty.schema).parquet(str(tmp_path / "in")), bins, "at")
