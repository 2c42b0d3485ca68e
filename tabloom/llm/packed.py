"""Audit of how filters interact, over every order in which they can be applied.

What a document does at each step of each order follows from the set of filters that it fails. That set
is a mask, and every mask stands for one big integer, whose 64-bit fields say what happens at
every step. Integers of documents are added up, first within a task, and the sum's fields are the counts of all
orders and steps. A field can't run over into the next one, since a table has fewer than 2 ** 63 rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import written

#: What is counted at each step.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Parts whose sums a task holds at once.
HELD = 256
#: Groups into which the sums of a part are dealt before they are added to one.
SALTS = 32


def step_fields(mask: int, good: bool, toxic: bool, n: int) -> np.ndarray:
    """(order, step, count) of 0 or 1 for a document that fails the filters in ``mask``."""
    out = []
    for order in itertools.permutations(range(n)):
        seen = 0
        for k in order:
            fails, before = mask >> k & 1, bool(mask & seen)
            seen |= 1 << k
            removed = fails and not before
            out.append((not mask & seen, removed, fails and before, mask == 1 << k, removed and good, removed and toxic))
    return np.array(out, np.uint64).reshape(-1, n, len(COUNTS))


def to_integer(fields: np.ndarray) -> int:
    return int.from_bytes(fields.astype("<u8").tobytes(), "little")


def to_fields(total: int, n: int, orders: int) -> np.ndarray:
    size = orders * n * len(COUNTS)
    return np.frombuffer(total.to_bytes(8 * size, "little"), "<u8").reshape(orders, n, len(COUNTS))


def _packed(total: int) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(total.to_bytes(-(-total.bit_length() // 8), "little"))


def _unpacked(blob: bytes) -> int:
    return int.from_bytes(zstandard.ZstdDecompressor().decompress(blob), "little")


_SUM = "part string, salt int, total binary"


def _sums(n: int):
    """Integers of each task's documents, added by part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        integers: dict[int, int] = {}
        totals: dict[str, int] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def flush() -> pa.RecordBatch:
            rows = [list(totals), [salt] * len(totals), [_packed(t) for t in totals.values()]]
            totals.clear()
            kinds = (pa.string(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["part", "salt", "total"])

        for batch in batches:
            # equal masks of a batch are one product
            found = pa.Table.from_batches([batch]).group_by(["part", "code"]).aggregate([([], "count_all")])
            for part, code, rows in zip(*(found[c].to_pylist() for c in ("part", "code", "count_all"))):
                if code not in integers:
                    integers[code] = to_integer(step_fields(code >> 2, bool(code & 2), bool(code & 1), n))
                totals[part] = totals.get(part, 0) + integers[code] * rows
                if len(totals) > HELD:
                    yield flush()
        if totals:
            yield flush()

    return add


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
    """(part, salt, sum) of rows that come sorted, one group at a time."""
    last, total = None, 0
    for batch in batches:
        for part, salt, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "salt", "total"))):
            if last is not None and last != (part, salt):
                yield *last, total
                total = 0
            last = (part, salt)
            total += _unpacked(blob)
    if last is not None:
        yield *last, total


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, total in _added(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([0], pa.int32()), pa.array([_packed(total)], pa.binary())], ["part", "salt", "total"]
        )


def _steps(names: str):
    """Rows of the counts of every order and step of each part."""
    orders = list(itertools.permutations(range(len(names))))
    labels = ["".join(names[k] for k in order) for order in orders]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(orders)
        for part, _, total in _added(batches):
            fields = to_fields(total, len(names), len(orders)).astype(np.int64)
            shares = np.zeros(len(names), np.int64)
            np.add.at(shares, at.reshape(-1), fields[:, :, COUNTS.index("removed")].reshape(-1))
            n = at.size
            columns = {
                "part": pa.array([part] * n),
                "filter_order": pa.array(np.repeat(labels, len(names)).tolist()),
                "step": pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))),
                **{c: pa.array(fields[:, :, i].reshape(-1)) for i, c in enumerate(COUNTS)},
                "shapley": pa.array(shares[at.reshape(-1)]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return unpack


def audit_orders(fails: DataFrame, names: str, part_col: str = "part", good_col: str = "good", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``fails`` has a boolean column for each letter of ``names``, true where a row fails that filter (null
    counts as false), and booleans that mark good and toxic rows. ``filter_order`` holds the letters in the
    order in which they are applied and ``step`` counts from 1. Long row counts within the part: kept after the
    step, removed by it, redundant (failing it, removed earlier), unique_fails (failing only it), good_lost
    and toxic_lost (removed by it), and shapley, the rows that the step's filter removes, summed over all
    orders. A null part counts as "". Rows are counted each, repeated ones too; a table without rows
    has no parts and gives none. Up to seven filters: all orders of more make too many fields.
    """
    if not 1 <= len(names) <= 7 or len(set(names)) < len(names):
        raise ValueError("one to seven filters, each with a letter of its own")
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int")
    bits = [F.shiftleft(flag(c), k + 2) for k, c in enumerate(names)] + [F.shiftleft(flag(good_col), 1), flag(toxic_col)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    rows = fails.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), code.alias("code"))
    sums = rows.mapInArrow(_sums(len(names)), _SUM)
    sums = sums.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_merge, _SUM)
    counts = ", ".join(f"{c} long" for c in (*COUNTS, "shapley"))
    return sums.repartition("part").sortWithinPartitions("part", "salt").mapInArrow(_steps(names), f"part string, filter_order string, step int, {counts}")


#: Order of the letters: few words, few distinct words, many capitals, markup characters, repeated text.
FILTERS = "ABCDE"


def text_failures(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    min_words: int = 200,
    distinct_percent: int = 50,
    capital_percent: int = 3,
    markup: str = "[#$%&*|]",
) -> DataFrame:
    """part, A to E, good and toxic for each row of ``docs``.

    A: fewer than ``min_words`` words; B: fewer distinct words than ``distinct_percent`` of them, case kept; C: more
    A-Z than ``capital_percent`` of the code points; D: any character of ``markup``; E: a smaller id has
    the identical text, by SHA-256, in whatever part. Words are runs of characters other than ASCII white
    space; a null text counts as empty and a null part as "". A null id is never smaller and has no
    smaller one, so that such rows don't fail E; nor do rows of one id and text fail for each other.
    A row is good or toxic if any row of ``labels`` with its id has quality or toxic 1.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", words)
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    rows = rows.select(
        "doc_id",
        "part",
        (F.size("words") < min_words).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < distinct_percent * F.size("words").cast("long")).alias("B"),
        (100 * capitals.cast("long") > capital_percent * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike(markup).alias("D"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    rows = written(rows, "filter-failures")
    # the row of a text's smallest id is found by both, so that a text with many rows is spread by their ids
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(least, ["digest", "doc_id"], "left")
    rows = rows.withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
    if labels is None:
        return rows.select("part", *FILTERS, F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null and (quality = 1 or toxic = 1)")
    known = known.groupBy("doc_id").agg(F.max(_is_one("quality")).alias("good"), F.max(_is_one("toxic")).alias("toxic"))
    rows = rows.join(known, "doc_id", "left")
    return rows.select("part", *FILTERS, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])


def _is_one(name: str) -> Column:
    return F.coalesce(F.col(name) == 1, F.lit(False))
