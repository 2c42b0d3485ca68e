"""Mixing sources to target weights by Pfair scheduling.

Weights are taken as exact fractions of their sum. Block j of a source with weight w may run from slot
floor(j / w) and must run before slot ceil((j + 1) / w); giving each slot to the released block
with the earliest deadline keeps every source within one block of its target at all times. One task
makes the schedule and sends it on in parts; it holds a few numbers for each source, none for the blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of the schedule that are sent on at once.
PERIOD = 1000


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, Fraction]:
    """Exact slots of each source among ``period``: fractions in the ratio of the weights."""
    parts = whole(list(weights.values()))
    total = sum(parts)
    return {s: Fraction(w * period, total) for s, w in zip(weights, parts)}


def whole(weights: list) -> list[int]:
    """Whole numbers in exactly the ratio of the weights."""
    exact = [Fraction(w) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("positive weights are needed")
    scale = lcm(*{w.denominator for w in exact})
    return [w.numerator * (scale // w.denominator) for w in exact]


def in_order(parts: list[int], counts: list[int]) -> Iterator[tuple[int, int, int]]:
    """(slot, source, block) by earliest deadline first among released blocks.

    A source with ``counts`` blocks ends with one more, the first that it misses. Slots for which no
    source is left are skipped, so that the time follows from the blocks.
    """
    total, slot = sum(parts), 0
    due = [-(-total // p) for p in parts]
    at = [0] * len(parts)
    waiting: list[tuple[int, int]] = []  # all first blocks are released
    ready = [(d, s) for s, d in enumerate(due)]
    heapq.heapify(ready)
    while ready or waiting:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (due[s], s))
        end, s = heapq.heappop(ready)
        assert slot < end
        j = at[s]
        yield slot, s, j
        if j < counts[s]:
            at[s] = j + 1
            due[s] = -(-(j + 2) * total // parts[s])
            heapq.heappush(waiting, ((j + 1) * total // parts[s], s))
        slot += 1


def schedule(parts: dict[str, Fraction], period: int) -> dict[str, list[int]]:
    """Slots of each source's blocks among the first ``period``, of sources that don't run out."""
    names, out = sorted(parts), {s: [] for s in parts}
    for slot, s, _ in islice(in_order(whole([parts[s] for s in names]), [period] * len(names)), period):
        out[names[s]].append(slot)
    return out


_SLOTS = pa.schema([("source", pa.string()), ("block", pa.int64()), ("slot", pa.int64()), ("within_target", pa.bool_())])


def _slots(exponent: float, block: int, size: int):
    """The schedule of all blocks from the rows (source, n, weight) of all sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("source")
        names, rows = table["source"].combine_chunks(), table["n"].to_pylist()
        parts = whole([n**exponent if w is None else Fraction(w) for n, w in zip(rows, table["weight"].to_pylist())])
        counts = [-(-n // block) for n in rows]
        steps, within = in_order(parts, counts), True
        while part := list(islice(steps, size)):
            out = []
            for slot, s, j in part:
                if j == counts[s]:
                    within = False  # the first source ran out
                else:
                    out.append((s, j, slot, within))
            if out:
                s, *columns = zip(*out)
                columns = [pa.array(c, f.type) for c, f in zip(columns, list(_SLOTS)[1:])]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(s, pa.int64())), *columns], schema=_SLOTS)

    return run


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    block: int = 16,
    period: int = PERIOD,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    bucket_rows: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, block, slot, position, within_target.

    Documents of a source, in an order fixed by a seeded hash of the id, fill blocks of ``block``
    rows; slots give the order of blocks, and ``position`` the place inside the mix: slot * block +
    place in the block, unique but for gaps where a source has run out. No row is dropped: sources
    that last longer go on in their own slots, and ``within_target`` marks the slots before the first
    source ran out, where every source is within one block of its weight as given. Without ``weights``
    a source's weight is its row count to the power ``exponent``. Sources missing in ``weights`` raise;
    a null source counts as "". Null ids and repeated rows each take a place of their own. ``period``
    only says how many blocks of the schedule are sent on at once.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"))
    rows = rows.withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
    total = rows.count()
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights:
        given = spark.createDataFrame([(s, str(Fraction(w))) for s, w in weights.items()], "source string, weight string")
        sizes = sizes.join(given, "source", "left").select("source", "n", "weight")
        if missing := sizes.filter("weight is null").select("source").limit(5).collect():
            raise ValueError(f"no weight for {sorted(r['source'] for r in missing)}")
    else:
        sizes = sizes.withColumn("weight", F.lit(None).cast("string"))
    # a source is numbered in buckets of its hash order, so that a hot one is spread like the others
    buckets = max(1, total // bucket_rows)
    rows = rows.withColumn("bucket", F.shiftrightunsigned("order", 16) % buckets)
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    counts = counts.select("source", "bucket", before.alias("before"))
    own = Window.partitionBy("source", "bucket").orderBy("order", "doc_id")
    placed = (
        rows.withColumn("place", F.row_number().over(own) - 1)
        .join(counts, ["source", "bucket"])
        .withColumn("place", F.col("place") + F.col("before"))
        .withColumn("block", F.floor(F.col("place") / block))
    )
    table = sizes.repartition(1).mapInArrow(_slots(exponent, block, period), "source string, block long, slot long, within_target boolean")
    return placed.join(table, ["source", "block"]).select(
        "doc_id",
        "source",
        "block",
        "slot",
        (F.col("slot") * block + F.col("place") % block).alias("position"),
        "within_target",
    )
