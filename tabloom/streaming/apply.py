"""Fitted recipes, formats and models on streams.

Everything a fitted recipe or model does to a row is a narrow plan, so the same object works
under ``readStream``. Only deduplication keeps state, bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators.clean import FittedStep
from tabloom.plans.ensemble import TrainedTarget
from tabloom.plans.recipe import FittedRecipe
from tabloom.types import col


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with time zone; parquet often holds one without."""
    return df.withColumn(column, col(column).cast("timestamp"))


def clean_stream(
    stream: DataFrame,
    fitted: FittedRecipe,
    time_column: str | None = None,
    delay: str = "1 hour",
    subset: Sequence[str] | None = None,
) -> DataFrame:
    """Apply a fitted recipe to a stream.

    Copies (of ``subset``, else of the columns the recipe deduplicates by, else of whole rows)
    are dropped within ``delay`` of each other, which bounds the state that is kept.
    """
    for step in fitted.steps:
        if step.op == "deduplicate":
            if time_column is None:
                raise ValueError("deduplicating a stream needs its event-time column")
            stream = _drop_copies(stream, step, time_column, delay, subset)
        else:
            stream = step.transform(stream)
    return stream


def _drop_copies(stream, step: FittedStep, time_column, delay, subset) -> DataFrame:
    by = list(subset or step.params["subset"] or stream.columns)
    return event_time(stream, time_column).withWatermark(time_column, delay).dropDuplicatesWithinWatermark(by)


def score_stream(stream: DataFrame, trained: TrainedTarget) -> DataFrame:
    return trained.predict(stream)


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False) -> StreamingQuery:
    """Append to a folder; ``once`` processes what is there and stops."""
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()
