"""Counts, missing shares and drift of a stream by window of event time.

Only counts by (window, column, bin) are kept as state, until the watermark passes the end of their window; a closed
window is appended once. Spark's file sink records which files belong to which micro-batch, so that a batch
repeated after a failure, or a restart, adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators.drift import DriftBins, bin_counts, score
from tabloom.streaming.apply import event_time, write_stream
from tabloom.types import col

COUNTS = "window_start timestamp, window_end timestamp, column string, bin int, value string, n long"


def window_counts(df: DataFrame, bins: DriftBins, time_column: str, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """(window_start, window_end, column, bin, value, n) of a table, or of a stream with ``delay``.

    Rows without a time are in no window. On a stream, rows that come when the watermark (the latest time so
    far minus ``delay``, taken at the end of each micro-batch) has passed their window's end are left out;
    later rows of open windows are counted.
    """
    timed = event_time(df, time_column)
    if delay is not None:
        timed = timed.withWatermark(time_column, delay)
    elif df.isStreaming:
        raise ValueError("a stream needs a delay, which bounds its state")
    windows = timed.select(F.window(col(time_column), width).alias("_window"), *[col(c) for c in [*bins.edges, *bins.values]])
    counts = bin_counts(windows, bins, F.col("_window"))
    return counts.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "column", "bin", "value", "n"
    )


def monitor(
    stream: DataFrame,
    bins: DriftBins,
    time_column: str,
    path: str,
    checkpoint: str,
    width: str = "1 hour",
    delay: str = "10 minutes",
    once: bool = False,
) -> StreamingQuery:
    """Append the counts of closed windows to ``path``; ``once`` processes what is there and stops."""
    return write_stream(window_counts(stream, bins, time_column, width, delay), path, checkpoint, once=once)


def window_scores(spark: SparkSession, path: str, bins: DriftBins) -> DataFrame:
    """Rows, missing and unlisted shares, PSI and KS of every closed window and column: see ``drift.score``."""
    return score(spark, bins, spark.read.schema(COUNTS).parquet(path), ["window_start", "window_end"])


def late_groups(query: StreamingQuery) -> int:
    """How many counts (of a window, column and bin in one task's share of a micro-batch) came too late."""
    return sum(state.numRowsDroppedByWatermark for batch in query.recentProgress for state in batch.stateOperators)
