"""Exact order statistics at any size.

Spark's exact ``percentile``/``median`` keep a value -> count map of the whole column in
one buffer. Here each pass is one small aggregation instead. The first one takes a sketch, which
puts a narrow zone around every wanted rank. The next counts the rows between the zones and those
in ``BINS`` bins of each zone; the bin that holds the rank becomes the next bracket, and once a
bracket is small its distinct values are read. Only counts are shuffled, every count is combined
on the map side, and a hot value simply makes one bin heavy.

Up to some eight million rows two scans are enough. Beyond that every further scan divides the rows of a bracket.
Bins are equal steps of the logarithm while a bracket spans more than a factor of
``NEAR``, equal steps of the value after that, so no column needs more than ten scans.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import stage
from tabloom.types import col, present, value

BINS = 1024
COLUMNS_PER_PASS = 32  # bounds the bin counts that one pass brings to the driver
LARGEST = sys.float_info.max
SMALL = 5000  # a bracket with at most this many rows is read value by value
ACCURACY = 10_000  # a sketched rank is off by at most one in so many rows
NEAR = 16.0
SALTS = 16
ONE, STEPS, VALUES = 0, 1, 2  # how the rows of a zone are counted: together, in bins, by value


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    pos = p * (n - 1)
    low = math.floor(pos)
    return low, min(math.ceil(pos), n - 1), pos - low


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """A bin number that never falls as x rises from lo to hi."""

    def level(v: Column) -> Column:
        # beyond the logarithm of the smallest double, so the sign orders the two halves
        return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1080))

    # halved operands keep the width finite for any pair of doubles
    even = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    near = (F.signum(lo) == F.signum(hi)) & (
        F.greatest(F.abs(lo), F.abs(hi)) / NEAR <= F.least(F.abs(lo), F.abs(hi))
    )
    share = F.when(near, even).otherwise((level(x) - level(lo)) / (level(hi) - level(lo)))
    return F.greatest(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")


def _zones(lo: float, hi: float, n: int, seeds: list[tuple[float, float]]) -> list[tuple[float, float, int]]:
    """The range cut into disjoint closed zones: narrow ones around the seeds, and the rest."""
    merged: list[list[float]] = []
    for a, b in sorted((min(max(a, lo), hi), max(min(b, hi), lo)) for a, b in seeds):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    # a seed spans four in ACCURACY rows, and either end may be off by one more
    kind = VALUES if 6 * n / ACCURACY <= SMALL else STEPS
    zones, at = [], lo
    for a, b in merged:
        if at < a:
            zones.append((at, math.nextafter(a, -math.inf), ONE))
        zones.append((a, b, kind))
        at = math.nextafter(b, math.inf)
    if at <= hi:
        zones.append((at, hi, ONE))
    return zones


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns, nulls and NaN skipped."""
    if not cols:
        return {}
    if len(cols) > COLUMNS_PER_PASS:
        rest = exact_quantiles(df, cols[COLUMNS_PER_PASS:], probs)
        return exact_quantiles(df, cols[:COLUMNS_PER_PASS], probs) | rest
    # one (column, value) row per cell keeps the generated code small for any number of columns
    cells = [F.struct(F.lit(i).alias("i"), value(df, c).cast("double").alias("x")) for i, c in enumerate(cols)]
    long = df.select(F.inline(F.array(*cells))).where("x is not null")
    finite = long.where(F.abs("x") < float("inf"))
    f = F.when(F.abs("x") < float("inf"), F.col("x"))
    edges = [min(max(p + side * 2 / ACCURACY, 0.0), 1.0) for p in probs for side in (-1, 1)]
    counts = long.groupBy("i").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("x") == float("-inf")).alias("below"),
        F.count(f).alias("m"),
        F.min(f).alias("lo"),
        F.max(f).alias("hi"),
        F.percentile_approx("x", edges, ACCURACY).alias("edges"),
    )
    first = {row.i: row for row in counts.collect()}

    answers: dict[tuple[int, int], float] = {}
    wanted: dict[int, set[int]] = defaultdict(set)  # column -> ranks still open
    zones: dict[int, list[tuple]] = {}  # column -> disjoint (lo, hi, kind, rows below or None)
    for i, s in first.items():
        for p in probs:
            for r in _ranks(s.n, p)[:2]:
                if r < s.below:
                    answers[i, r] = float("-inf")
                elif r >= s.below + s.m:
                    answers[i, r] = float("inf")
                elif s.lo == s.hi:
                    answers[i, r] = s.lo
                else:
                    wanted[i].add(r)
        if wanted[i]:
            seeds = list(zip(s.edges[::2], s.edges[1::2]))
            # they lie side by side: each one begins where the one before it ends
            cut = _zones(s.lo, s.hi, s.n, seeds)
            zones[i] = [(lo, hi, kind, s.below if k == 0 else None) for k, (lo, hi, kind) in enumerate(cut)]

    while any(wanted.values()):
        flat = [(i, *zone) for i in sorted(zones) for zone in zones[i]]
        table = pa.table(
            {
                "k": pa.array(range(len(flat)), pa.int32()),
                "c": pa.array([z[0] for z in flat], pa.int32()),
                "lo": pa.array([z[1] for z in flat], pa.float64()),
                "hi": pa.array([z[2] for z in flat], pa.float64()),
                "kind": pa.array([z[3] for z in flat], pa.int32()),
            }
        )
        zones_now = F.broadcast(df.sparkSession.createDataFrame(table))  # a few per column
        x, kind, lo, hi = F.col("x"), F.col("kind"), F.col("lo"), F.col("hi")
        slices = (
            finite.join(zones_now, (F.col("i") == F.col("c")) & x.between(lo, hi))
            .groupBy(
                "k",
                F.when((kind == STEPS) & (lo < hi), _bin(x, lo, hi)).alias("b"),
                F.when(kind == VALUES, x).alias("v"),
            )
            .agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .collect()  # at most BINS or some SMALL rows per zone
        )
        per_zone = defaultdict(list)
        for row in slices:
            per_zone[row.k].append((row.lo, row.hi, row.m))
        found: dict[int, dict[tuple, None]] = defaultdict(dict)
        below = 0
        for k, (i, _, _, _, start) in enumerate(flat):
            below = below if start is None else start
            for lo, hi, m in sorted(per_zone[k]):
                for r in [r for r in wanted[i] if below <= r < below + m]:
                    if lo == hi:
                        answers[i, r] = lo
                        wanted[i].discard(r)
                    else:
                        found[i][lo, hi, VALUES if m <= SMALL else STEPS, below] = None
                below += m
        zones = {i: list(z) for i, z in found.items()}

    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        n = first[i].n if i in first else 0
        row: list[float | None] = []
        for p in probs:
            if not n:
                row.append(None)
                continue
            low, high, frac = _ranks(n, p)
            a, b = answers[i, low], answers[i, high]
            row.append(a if a == b or frac == 0 else a + (b - a) * frac)
        result[c] = row
    return result


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()}


def approx_medians(df: DataFrame, cols: Sequence[str], accuracy: int = 10000) -> dict:
    """One pass; the value returned is within 1/accuracy of the middle rank."""
    if not cols:
        return {}
    row = df.agg(
        *[F.percentile_approx(value(df, c), 0.5, accuracy).alias(f"m{i}") for i, c in enumerate(cols)]
    ).first()
    return {c: None if row[i] is None else float(row[i]) for i, c in enumerate(cols)}


def grouped_quantiles(
    df: DataFrame, by: Sequence[str], column: str, probs: Iterable[float]
) -> DataFrame:
    """Exact quantiles per group: columns ``by``, ``p``, ``quantile``.

    The same narrowing as ``exact_quantiles`` with one bracket per (group, rank) kept in a
    staged table, so neither the number of groups nor the size of one group is limited.
    """
    probs = list(probs)
    keys = [f"g{i}" for i in range(len(by))]
    x = value(df, column).cast("double")
    x = F.least(F.greatest(x, F.lit(-LARGEST)), F.lit(LARGEST))  # infinities bin as the ends
    data = df.where(present(df, column)).select(
        *[col(b).alias(k) for b, k in zip(by, keys)], x.alias("x")
    )
    p = F.explode(F.array(*[F.lit(float(q)) for q in probs]))
    targets = stage(
        data.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .select(*keys, "n", "lo", "hi", p.alias("p"))
        .withColumn("pos", F.col("p") * (F.col("n") - 1))
    )
    ends = F.array(F.floor("pos").cast("long"), F.ceil("pos").cast("long"))
    rank = F.explode(F.array_distinct(ends))
    state = stage(
        targets.select(*keys, rank.alias("r"), "lo", "hi", F.col("n").alias("m"))
        .withColumn("below", F.lit(0).cast("long"))
        .distinct()
    )
    solved = state.where("lo = hi").select(*keys, "r", F.col("lo").alias("answer"))
    state = state.where("lo < hi")
    window_keys = [*keys, "r"]
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]

    while (open_brackets := state.count()) > 0:
        # ranks that share a bracket share its counts: rows are expanded once per bracket
        ranges = state.select(*keys, "lo", "hi", "below", "m").distinct()
        few = open_brackets <= 100_000
        # beyond that the rows of a hot group are dealt over SALTS tasks
        salt = F.lit(0) if few else F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        ranges = ranges.withColumn("salt", salt)
        side = F.broadcast(ranges) if few else ranges
        rows = data.withColumn("salt", F.lit(0) if few else F.pmod(F.xxhash64("x", F.rand(7)), F.lit(SALTS)).cast("int"))
        x, lo, hi = F.col("d.x"), F.col("s.lo"), F.col("s.hi")
        slot = F.when(F.col("s.m") > SMALL, _bin(x, lo, hi))
        exact = F.when(F.col("s.m") <= SMALL, x)
        slices = (
            rows.alias("d")
            .join(side.alias("s"), [*same("d", "s"), F.col("d.salt") == F.col("s.salt"), x.between(lo, hi)])
            .groupBy(
                *[F.col(f"s.{k}").alias(k) for k in keys],
                lo.alias("lo"),
                hi.alias("hi"),
                F.col("s.below").alias("below"),
                slot.alias("b"),
                exact.alias("v"),
            )
            .agg(F.count("*").alias("c"), F.min("x").alias("x0"), F.max("x").alias("x1"))
        )
        # at most max(BINS, SMALL) slices per bracket
        running = (
            Window.partitionBy(*keys, "lo", "hi", "below")
            .orderBy("x0")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        slices = slices.withColumn("upto", F.col("below") + F.sum("c").over(running))
        hit = (
            state.alias("s")
            .join(
                slices.alias("t"),
                [
                    *same("s", "t"),
                    F.col("s.lo") == F.col("t.lo"),
                    F.col("s.hi") == F.col("t.hi"),
                    F.col("s.below") == F.col("t.below"),
                    F.col("s.r") < F.col("t.upto"),
                    F.col("s.r") >= F.col("t.upto") - F.col("t.c"),
                ],
            )
            .select(
                *[F.col(f"s.{k}").alias(k) for k in keys],
                "s.r",
                F.col("t.x0").alias("lo"),
                F.col("t.x1").alias("hi"),
                F.col("t.c").alias("m"),
                (F.col("t.upto") - F.col("t.c")).alias("below"),
            )
        )
        hit = stage(hit)
        solved = solved.unionByName(
            hit.where("lo = hi").select(*window_keys, F.col("lo").alias("answer"))
        )
        state = hit.where("lo < hi")

    def pick(side: str) -> DataFrame:
        return solved.select(*keys, F.col("r"), F.col("answer").alias(side)).alias(side)

    low, high = pick("low"), pick("high")
    t = targets.alias("t")
    joined = t.join(low, [*same("t", "low"), F.floor("t.pos") == F.col("low.r")]).join(
        high, [*same("t", "high"), F.ceil("t.pos") == F.col("high.r")]
    )
    frac = F.col("t.pos") - F.floor("t.pos")
    a, b = (
        F.when(F.abs(c) == LARGEST, F.signum(c) * float("inf")).otherwise(c)
        for c in (F.col("low.low"), F.col("high.high"))
    )
    return joined.select(
        *[F.col(f"t.{k}").alias(n) for k, n in zip(keys, by)],
        F.col("t.p").alias("p"),
        F.when(a == b, a).otherwise(a + (b - a) * frac).alias("quantile"),
    )
