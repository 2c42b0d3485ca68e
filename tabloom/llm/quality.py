"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; every feature owns a lookup table over its bins, learnt by boosting
shallow trees on one feature after the other, round by round. The pairs that explain most of what is
left get tables over two binned features in the same way. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, SPACES, Roller, binary_values, blocks, documents

#: Bound of the labelled rows that a model is fitted on (those with the smallest seeded hash of
#: their id); they are gathered on the driver, some 100 bytes each.
MAX_TRAINING_ROWS = 50_000

FEATURES = (
    "log_bytes", "mean_word", "long_words", "upper", "digits", "marks", "symbols", "non_ascii", "spaces",
    "log_words", "distinct_words", "top_word", "adjacent_repeats", "longest_repeat", "repeats_near",
    "lines_per_word", "repeated_lines", "line_upper", "line_symbols", "line_marks", "line_repeats", "line_short",
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(b"#$%&*@^~|<>{}[]=+_/\\`")] = 5
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 6
_CLASS[SPACES] = 7
#: Lines shorter than this don't count in the features of the worst line.
_LINE_BYTES = 24


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[borders[1:]] - total[borders[:-1]]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(data: np.ndarray, offsets: np.ndarray, roller: Roller) -> np.ndarray:
    """The matrix of ``FEATURES`` for the texts of a block; the columns of an empty text are 0."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = _CLASS[data]
    # lines end at newlines and with their text; bytes are counted by line and kind in one pass
    edges = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    line_size = np.diff(edges)
    line_doc = np.searchsorted(offsets, edges[:-1], "right") - 1
    cell = np.repeat(np.arange(len(line_size), dtype=np.int64) * 8, line_size) + kind
    by_line = np.bincount(cell, minlength=8 * len(line_size)).reshape(-1, 8)
    counts = [np.bincount(line_doc, by_line[:, k], minlength=n) for k in range(8)]
    letters = counts[1] + counts[2]
    # words, cut at white space and at the borders of texts
    inside = ~SPACES[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin = inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1]) if len(data) else inside
    end = inside & (np.concatenate([~inside[1:], [True]]) | cut[1:]) if len(data) else inside
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    word_at = np.searchsorted(starts, offsets)
    n_words = np.diff(word_at)
    owner = np.repeat(np.arange(n), n_words)
    lengths = ends - starts
    word = roller.ranges(roller.sums(LOWER[data]), starts, ends)
    own_word = word + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(own_word)
    fresh = np.flatnonzero(np.diff(own_word[order], prepend=~own_word[order[:1]]))
    whose = owner[order[fresh]]
    distinct = np.bincount(whose, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, whose, np.diff(np.append(fresh, len(word))))
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    near = same.copy()
    for back in (2, 3):
        near[back:] |= (word[back:] == word[:-back]) & (owner[back:] == owner[:-back])
    stretch_at = np.flatnonzero(~same)
    stretch = np.zeros(n)
    if len(word):
        np.maximum.at(stretch, owner[stretch_at], np.diff(np.append(stretch_at, len(word))))
    line_hash = roller.ranges(roller.sums(data), edges[:-1], edges[1:] - (data[edges[1:] - 1] == 10)) if len(line_size) else np.zeros(0, np.uint64)
    n_lines = np.bincount(line_doc, minlength=n)
    by = np.lexsort((line_hash, line_doc))
    again = np.zeros(len(by), bool)
    again[1:] = (line_hash[by][1:] == line_hash[by][:-1]) & (line_doc[by][1:] == line_doc[by][:-1])
    repeated = np.bincount(line_doc[by][again], minlength=n)
    long = line_size >= _LINE_BYTES

    def worst(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, line_doc[long], values[long])
        return out

    line_word = np.searchsorted(starts, edges)
    columns = [
        np.log1p(size),
        _share(_sums(lengths, word_at), n_words),
        _share(_sums(lengths > 14, word_at), n_words),
        _share(counts[1], letters),
        _share(counts[3], size),
        _share(counts[4], size),
        _share(counts[5], size),
        _share(counts[6], size),
        _share(counts[7], size),
        np.log1p(n_words),
        _share(distinct, n_words),
        _share(top, n_words),
        _share(_sums(same, word_at), n_words),
        np.log1p(stretch),
        _share(_sums(near, word_at), n_words),
        _share(n_lines, n_words),
        _share(repeated, n_lines),
        worst(_share(by_line[:, 1], by_line[:, 1] + by_line[:, 2])),
        worst(_share(by_line[:, 5], line_size)),
        worst(_share(by_line[:, 4], line_size)),
        worst(_share(_sums(same, line_word), np.diff(line_word))),
        _share(np.bincount(line_doc[~long], minlength=n), n_lines),
    ]
    return np.where(size[:, None] > 0, np.column_stack(columns), 0).astype(np.float32)


def _matrices(column: pa.Array, roller: Roller) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = binary_values(column)
    for lo, hi in blocks(offsets):
        yield lo, hi, features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], roller)


@dataclass
class AdditiveModel:
    """Lookup tables: ``tables[i]`` over the bins of feature i, ``pairs[(i, j)]`` over coarse bins of two."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]
    rows: int = 0  # that it was fitted on

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, i], "right")]
        for (i, j), table in self.pairs.items():
            out += table[
                np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")
            ]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> np.ndarray:
    """Leaf value of each bin for a tree of ``depth`` levels over ordered bins, by Newton gain."""
    out = np.empty(len(g))

    def grow(lo: int, hi: int, levels: int) -> None:
        total_g, total_h = g[lo:hi].sum(), h[lo:hi].sum()
        if levels and hi - lo > 1:
            left_g, left_h = np.cumsum(g[lo : hi - 1]), np.cumsum(h[lo : hi - 1])
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
            gain[(left_h < least) | (right_h < least)] = -1
            best = int(np.argmax(gain))
            if gain[best] > 1e-9:
                grow(lo, lo + best + 1, levels - 1)
                grow(lo + best + 1, hi, levels - 1)
                return
        out[lo:hi] = total_g / (total_h + ridge)

    grow(0, len(g), depth)
    return out


def fit_additive(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 150,
    pair_rounds: int = 50,
    n_pairs: int = 8,
    rate: float = 0.1,
    bins: int = 48,
    pair_bins: int = 8,
    depth: int = 2,
    ridge: float = 1.0,
    least: float = 2.0,
) -> AdditiveModel:
    """Cyclic boosting of logistic loss; the same rows give the same model."""
    n, width = x.shape
    mean = min(max(y.mean(), 1e-4), 1 - 1e-4) if n else 0.5
    intercept = float(np.log(mean / (1 - mean)))
    empty = np.zeros(0)
    edges = [_cuts(x[:, i], bins) if n else empty for i in range(width)]
    coarse = [_cuts(x[:, i], pair_bins) if n else empty for i in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(intercept, edges, tables, coarse, {}, n)
    if not n or mean in (1e-4, 1 - 1e-4):
        return model
    binned = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]
    logit = np.full(n, intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, b in enumerate(binned):
            g, h = slopes()
            m = len(tables[i])
            step = rate * _tree(np.bincount(b, g, m), np.bincount(b, h, m), depth, least, ridge)
            tables[i] += step
            logit += step[b]
    rough = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(coarse)]
    g, h = slopes()

    def left_over(i: int, j: int) -> float:
        m = len(coarse[j]) + 1
        cell = rough[i] * m + rough[j]
        size = (len(coarse[i]) + 1) * m
        return float((np.bincount(cell, g, size) ** 2 / (np.bincount(cell, h, size) + 5 * ridge)).sum())

    ranked = sorted(((left_over(i, j), i, j) for i in range(width) for j in range(i)), reverse=True)
    for _, i, j in ranked[:n_pairs]:
        model.pairs[i, j] = np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = slopes()
            m = table.shape[1]
            cell = rough[i] * m + rough[j]
            g, h = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h))
            # a shallow tree: the better feature splits, and each side splits on the other one
            step = _pair_tree(g, h, least, ridge) * rate
            table += step
            logit += step[rough[i], rough[j]]
    return model


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> np.ndarray:
    def one(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        best, out = -1.0, np.full(g.shape, g.sum() / (h.sum() + ridge))
        for k in range(1, g.shape[0]):
            if h[:k].sum() < least or h[k:].sum() < least:
                continue
            sides, gain = [], 0.0
            for part in (slice(0, k), slice(k, None)):
                a, b = g[part].sum(0), h[part].sum(0)
                leaf = _tree(a, b, 1, least, ridge)
                gain += float((leaf * a).sum())
                sides.append(np.broadcast_to(leaf, g[part].shape))
            if gain > best:
                best, out = gain, np.concatenate(sides)
        return best, out

    (first, a), (second, b) = one(g, h), one(g.T, h.T)
    return a if first >= second else b.T


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, label_col: str = "quality") -> AdditiveModel:
    """Fit on documents whose id has a 0/1 label; rows without a label or id are left out.

    Of more than ``max_rows`` labelled ids those with the smallest hash are taken. An id with several
    labels counts once, with the larger one. Without any labelled row scores are 0.5.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")
    known = known.filter("label_id is not null").groupBy("label_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    rows = documents(docs)
    # at most max_rows pairs of numbers
    rows = rows.join(F.broadcast(known), rows["doc_id"] == known["label_id"]).select("doc_id", "y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            for lo, hi, x in _matrices(batch.column("text"), roller):
                kept = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "y")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "row"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    table = rows.mapInArrow(extract, f"doc_id {kind}, y int, row binary")
    found = table.orderBy("doc_id", "row").limit(max_rows).collect()
    x = np.frombuffer(b"".join(bytes(r["row"]) for r in found), np.float32).reshape(len(found), len(FEATURES))
    return fit_additive(x.astype(np.float64), np.array([r["y"] for r in found], float))


def score_documents(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score for every row. Narrow."""
    rows = documents(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            for lo, hi, x in _matrices(batch.column("text"), roller):
                ids = batch.column("doc_id").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(x.astype(np.float64)))], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``. Narrow."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            text = batch.column("text").cast(pa.string()).fill_null("")
            scores = [model.scores(x.astype(np.float64)) for _, _, x in _matrices(text, roller)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score is the model's chance of label 1, from the text alone; ``predicted`` is 1 from
    ``threshold`` on. Null texts score as empty ones, null ids are never held out, repeated rows
    each get the same score, and extra columns are not read.
    """
    model = train(docs, labels.filter(~held_out()), max_rows)
    return score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
