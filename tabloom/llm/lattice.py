"""Near duplicates among embeddings by lattice hashing.

Each table projects a unit vector on a few random directions, eight to a block, and decodes every block
to its nearest point of the E8 lattice; the points together are the vector's cell. A vector lies in
its own cell of each table and also looks into the cells whose lattice points are next nearest.
Vectors that meet in a cell are compared by cosine. A pair may meet several times: both vectors' cells
say where it meets first, and only there it counts, so that pairs are never written or sorted.

Cells with many entries are split into blocks, and pairs of blocks are compared by different tasks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from tabloom.llm.common import discard, mix, written
from tabloom.llm.components import components

#: Entries of a cell that one task compares with each other.
BLOCK_ROWS = 512
#: Linked pairs whose meeting places are looked up at once.
PAIRS = 20_000
#: Length after projection, per coordinate, of the difference of two vectors just similar enough.
REACH = 0.14


@lru_cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1, or eight halves with an even number of minus signs."""
    whole = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((len(whole), 8))
    for k, (i, j, a, b) in enumerate(whole):
        out[k, [i, j]] = a, b
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([out, halves[(halves < 0).sum(1) % 2 == 0]])


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of an even sum: round, and mend an odd sum where it costs least."""
    out = np.rint(x)
    off = x - out
    odd = np.flatnonzero(out.sum(1).astype(np.int64) & 1)
    at = np.abs(off[odd]).argmax(1)
    out[odd, at] += np.where(off[odd, at] >= 0, 1, -1)
    return out


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: E8 is the even whole points and the same moved by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def near_points(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest lattice point and its ``n`` neighbours next to ``x``, nearest first, with squared distances beyond the first's."""
    own = nearest(x)
    gain = 2 - 2 * (x - own) @ shortest().T
    best = np.argsort(gain, axis=1, kind="stable")[:, :n]
    points = np.concatenate([own[:, None], own[:, None] + shortest()[best]], axis=1)
    return points, np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(gain, best, 1)], axis=1)


class Tables:
    """Cells of vectors of one length in several tables."""

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, cosine: float, seed: int) -> None:
        scale = REACH / np.sqrt(2 - 2 * cosine)
        draw = np.random.Generator(np.random.PCG64([seed, dim]))
        self.directions = draw.normal(scale=scale, size=(tables, blocks, dim, 8))
        self.probes = probes

    def cells(self, units: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Keys (vector, table, 1 + probes) of the own cell and of the next ones, by distance; ``groups`` keep labels apart."""
        n, out = self.probes + 1, []
        for t, table in enumerate(self.directions):
            keys = cost = None
            for k, directions in enumerate(table):
                points, far = near_points(units @ directions, min(self.probes, 240))
                hashed = np.zeros(points.shape[:2], np.uint64)
                for i in range(8):
                    hashed = mix(hashed * np.uint64(31) + (2 * points[:, :, i]).astype(np.int64).view(np.uint64))
                if keys is None:
                    keys, cost = hashed, far
                else:  # the cheapest pairs of what was taken and this block's points; the own ones stay first
                    cost = (cost[:, :, None] + far[:, None, :]).reshape(len(units), -1)
                    keys = mix(keys[:, :, None] * np.uint64(2 * k + 1) + hashed[:, None, :]).reshape(len(units), -1)
                    best = np.argsort(cost, axis=1, kind="stable")[:, :n]
                    keys, cost = np.take_along_axis(keys, best, 1), np.take_along_axis(cost, best, 1)
            out.append(mix(keys[:, :n] + mix(groups + np.uint64(t))[:, None]))
        return np.stack(out, axis=1)


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two vectors' cells (pair, table, cell) the first where one's own cell is among the other's."""
    own_a, own_b = a[:, :, 0], b[:, :, 0]
    in_a = (b == own_a[:, :, None]).any(2)
    in_b = (a == own_b[:, :, None]).any(2)
    meets = np.stack([in_a, in_b], axis=2).reshape(len(a), -1)
    places = np.stack([own_a, own_b], axis=2).reshape(len(a), -1)
    return np.take_along_axis(places, meets.argmax(1)[:, None], 1)[:, 0]


def units_of(vectors: list[bytes], dtype: str) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    x = np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(dtype: str):
    """Vectors that can link, under a digest of label and components; other rows have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, lists = batch.column("label").to_pylist(), batch.column("vector")
            values, offsets = lists.values, lists.offsets.to_numpy()
            numbers = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(dtype) + np.array(0, dtype)
            bad = np.append(0, np.cumsum(~np.isfinite(numbers)))
            some = np.append(0, np.cumsum(numbers != 0))
            digests, vectors = [], []
            for label, there, a, b in zip(labels, lists.is_valid().to_pylist(), offsets[:-1], offsets[1:]):
                usable = there and label is not None and bad[a] == bad[b] and some[a] < some[b]
                vectors.append(numbers[a:b].tobytes() if usable else None)
                digests.append(hashlib.md5(label.encode() + b"\0" + vectors[-1]).digest() if usable else None)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "digest", "vector"])

    return read


def _by_length(vectors: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(v) for v in vectors], np.int64)
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _group(label: str) -> int:
    return int.from_bytes(hashlib.md5(label.encode()).digest()[:8], "little")


def _cells(make, dtype: str):
    """(key, home, cid) for every cell that a vector lies in or looks into."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, groups = {}, {}
        for batch in batches:
            cids, labels, vectors = (batch.column(c).to_pylist() for c in ("cid", "label", "vector"))
            for own in _by_length(vectors):
                dim = len(vectors[own[0]])
                tables = made.get(dim) or made.setdefault(dim, make(dim))
                for at in range(0, len(own), 1000):
                    part = own[at : at + 1000]
                    marks = [groups.get(labels[i]) or groups.setdefault(labels[i], _group(labels[i])) for i in part]
                    keys = tables.cells(units_of([vectors[i] for i in part], dtype), np.array(marks, np.uint64))
                    home = np.zeros(keys.shape, bool)
                    home[:, :, 0] = True
                    of = np.repeat([cids[i] for i in part], keys.shape[1] * keys.shape[2])
                    columns = [pa.array(keys.reshape(-1).view(np.int64)), pa.array(home.reshape(-1)), pa.array(of)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "home", "cid"])
            if len(groups) > 100_000:
                groups = {}

    return spread


def _compare(make, dtype: str, cosine: float):
    """Links of each cell: (a, null, links) per vector that has some, and enough of (a, b, null) to connect them.

    Rows come sorted by unit; ``side`` has bit 1 for the unit's left and bit 2 for its right vectors.
    """

    def links_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of linked pairs whose first meeting is in their unit, and the tables' cells."""
        units, keys, sides = (rows[c].to_numpy() for c in ("unit", "key", "side"))
        homes, cids, vectors = rows["home"].to_numpy(), rows["cid"].to_numpy(), rows["vector"].to_pylist()
        part = rows["part"].to_numpy()
        starts = np.flatnonzero((np.diff(units, prepend=~units[:1]) != 0) | (np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(part, prepend=~part[:1]) != 0))
        found = []
        for a, b in zip(starts, np.append(starts[1:], len(units))):
            if b - a < 2:
                continue
            left, right = a + np.flatnonzero(sides[a:b] & 1), a + np.flatnonzero(sides[a:b] & 2)
            if not len(left) or not len(right) or len({len(vectors[i]) for i in range(a, b)}) > 1:
                continue
            similar = units_of([vectors[i] for i in left], dtype) @ units_of([vectors[i] for i in right], dtype).T >= cosine
            i, j = np.nonzero(similar)
            i, j = left[i], right[j]
            # two vectors at home here meet in both orders
            keep = np.where(homes[i] & homes[j], cids[i] < cids[j], cids[i] != cids[j])
            found.append(np.stack([i[keep], j[keep]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        if not pairs.size:
            return pairs
        swap = cids[pairs[0]] > cids[pairs[1]]
        pairs[:, swap] = pairs[::-1, swap]
        labels = rows["label"].to_pylist()
        used, place = np.unique(pairs, return_inverse=True)
        place = place.reshape(pairs.shape)
        _, one, same = np.unique(cids[used], return_index=True, return_inverse=True)
        used = used[one]
        cells = None
        for own in _by_length([vectors[i] for i in used]):
            dim = len(vectors[used[own[0]]])
            tables = made.get(dim) or made.setdefault(dim, make(dim))
            marks = np.array([_group(labels[i]) for i in used[own]], np.uint64)
            for at in range(0, len(own), 1000):
                got = tables.cells(units_of([vectors[i] for i in used[own[at : at + 1000]]], dtype), marks[at : at + 1000])
                if cells is None:
                    cells = np.zeros((len(used), *got.shape[1:]), np.uint64)
                cells[own[at : at + 1000]] = got
        here = keys[pairs[0]].view(np.uint64)
        first = np.zeros(len(here), bool)
        place = same[place]
        for at in range(0, len(here), PAIRS):
            cut = slice(at, at + PAIRS)
            first[cut] = first_meeting(cells[place[0, cut]], cells[place[1, cut]]) == here[cut]
        return pairs[:, first]

    made: dict = {}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < 20 * BLOCK_ROWS:
                    continue
            if not held:
                continue
            rows = pa.Table.from_batches(held)
            end = rows.num_rows
            if batch is not None:  # the last unit may go on in the next batch
                units, keys, part = (rows[c].to_numpy() for c in ("unit", "key", "part"))
                other = np.flatnonzero((units != units[-1]) | (keys != keys[-1]) | (part != part[-1]))
                end = int(other[-1]) + 1 if len(other) else 0
            held = rows.slice(end).to_batches()
            pairs = links_of(rows.slice(0, end)) if end else np.zeros((2, 0), np.int64)
            if pairs.size:
                cids, weights = rows["cid"].to_numpy(), rows["weight"].to_numpy()
                a, b = cids[pairs[0]], cids[pairs[1]]
                nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                counts = np.zeros(len(nodes), np.int64)
                np.add.at(counts, at, np.concatenate([weights[pairs[1]], weights[pairs[0]]]))
                roots = spanning(at[: len(a)], at[len(a) :], len(nodes))
                below = roots != np.arange(len(nodes))
                none = np.zeros(len(nodes), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([nodes, nodes[below]])),
                        pa.array(np.concatenate([none, nodes[roots[below]]]), mask=np.arange(len(nodes) + below.sum()) < len(nodes)),
                        pa.array(np.concatenate([counts, none[: below.sum()]])),
                    ],
                    ["a", "b", "n"],
                )

    return compare


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def similar_vectors(
    vectors: DataFrame,
    cosine: float = 0.98,
    tables: int = 5,
    blocks: int = 2,
    probes: int = 16,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows of equal, not null label link if their vectors are equally long and their cosine, in double
    precision, is at least ``cosine``. ``n_links`` counts the other rows that a row links with directly,
    ``component_id`` is the smallest id reached by links, and ``kept`` whether that is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and
    keep their own id. Rows of equal label and vector are compared once and all count; rows that
    share an id are rows of their own. A null id never is the smallest: a group of only such rows has a
    null component, and is ``kept``. An empty table gives none. Extra columns are ignored.

    No pair below the bound is linked. A pair above it is missed if it meets in none of the tables: with
    the defaults, by simulation, some three in 100,000 of pairs just at the bound, and fewer of closer ones.
    More ``tables`` or ``probes`` miss fewer; more ``blocks`` of eight directions have smaller cells, for more rows.
    A cell of n entries costs some n * n products, in blocks of ``block_rows`` for different tasks; its
    vectors are sent n / ``block_rows`` times.
    """
    element = vectors.schema[vector_col].dataType
    single = isinstance(element, ArrayType) and isinstance(element.elementType, FloatType)
    dtype = "<f4" if single else "<f8"

    def make(size: int) -> Tables:
        return Tables(size // np.dtype(dtype).itemsize, tables, blocks, probes, cosine, seed)

    as_list = F.col(vector_col).cast(ArrayType(FloatType() if single else DoubleType()))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), as_list.alias("vector"))
    rows = rows.mapInArrow(_rows(dtype), "vec_id long, label string, digest binary, vector binary")
    rows = written(rows, "vectors")
    classes = rows.filter("digest is not null").groupBy("digest")
    classes = classes.agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    cells = written(classes.select("cid", "label", "vector").mapInArrow(_cells(make, dtype), "key long, home boolean, cid long"), "cells")
    # only cells where somebody lives and somebody else looks in
    sizes = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    sizes = sizes.filter("n > 1 and homes > 0").select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    entries = cells.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    units = entries.select("key", "home", "cid", "blocks", F.explode(_units()).alias("u")).select("key", "home", "cid", "u.*")
    facts = classes.select("cid", "weight", "label", "vector")
    units = units.join(facts, "cid").repartition("key", "unit", "part").sortWithinPartitions("key", "unit", "part", "cid")
    found = written(units.mapInArrow(_compare(make, dtype, cosine), "a long, b long, n long"), "links")
    discard(cells)
    counts = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = components(found.filter("b is not null").select("a", "b"))
    classes = classes.select("digest", "cid", "least", "weight").join(counts, "cid", "left")
    classes = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("digest", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def _units() -> Column:
    """Where an entry of block b is compared: right in (i, b) for all i, and if at home left in (b, j) for all j."""
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_unit = lambda unit, part, side: F.struct(unit.alias("unit"), part.alias("part"), F.lit(side).alias("side"))
    right = F.transform(every, lambda i: F.when((i == F.col("block")) & F.col("home"), as_unit(i, F.col("block"), 3)).otherwise(as_unit(i, F.col("block"), 2)))
    left = F.filter(F.transform(every, lambda j: as_unit(F.col("block"), j, 1)), lambda u: u["part"] != F.col("block"))
    return F.when(F.col("home"), F.concat(right, left)).otherwise(right)
