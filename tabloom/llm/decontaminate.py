"""Benchmark passages in documents, up to a share of edits.

Within k edits of a test item, at least one of its k + 1 pieces stands unchanged: an automaton over
all pieces finds these places in one pass over a text, and Myers' bit-parallel distance verifies the
windows around them. Test items are bounded blocks that travel to the tasks; documents stay in place.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import text_or_empty

#: Edits per character of an item that still count as the item.
ERROR_RATE = 0.08
#: Characters of test items that one pass carries; more items make more passes.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"\S+")


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def normalised(text: str) -> str:
    return " ".join(lowered(text).split())


def budget(length: int, rate: float) -> int:
    return int(length * rate + 1e-9)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length with their offsets."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the first end of such a part."""
    n = len(pattern)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        places[c] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for at, c in enumerate(text, 1):
        eq = places.get(c, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(h | plus)) & full
        down = plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = (down | ~(x | up)) & full
        minus = up & x
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds test items in texts; built once per task from (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, t, budget(len(t), rate)) for i, x in items if (t := normalised(x or ""))]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
        for n, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                # equal pieces of an item: their windows around a place overlap and make one
                first, _ = found[piece].get(n, (offset, offset))
                found[piece][n] = (first, offset)
        for piece, where in found.items():
            # how far the window reaches before the end of the piece and beyond it
            reach = [
                (n, len(piece) + last + self.items[n][2], len(self.items[n][1]) + self.items[n][2] - len(piece) - first)
                for n, (first, last) in where.items()
            ]
            self.automaton.add_word(piece, (piece, reach))
        if found:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Per item, the merged windows of the text that can hold it.

        Places of a piece come in order, so that only the latest window of each piece and item is open: what
        is held follows from the number of separate windows, not of hits.
        """
        open_: dict[tuple[str, int], list[int]] = {}
        closed: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if self.items:
            for last, (piece, reach) in self.automaton.iter(text):
                for n, before, after in reach:
                    begin, end = max(0, last + 1 - before), min(len(text), last + 1 + after)
                    window = open_.get((piece, n))
                    if window is None:
                        open_[piece, n] = [begin, end]
                    elif begin <= window[1]:
                        window[1] = end
                    else:
                        closed[n].append((window[0], window[1]))
                        window[:] = begin, end
        for (_, n), (begin, end) in open_.items():
            closed[n].append((begin, end))
        merged = {}
        for n, spans in closed.items():
            spans.sort()
            joined = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            merged[n] = [(a, b) for a, b in joined]
        return merged

    def contains(self, text: str) -> bool:
        text = normalised(text)
        return any(
            myers(self.items[n][1], text[a:b])[0] <= self.items[n][2] for n, w in self.windows(text).items() for a, b in w
        )

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of each item's best place, in characters of the text as given."""
        flat, out = normalised(text), []
        starts = None
        for n, spans in self.windows(flat).items():
            item_id, item, k = self.items[n]
            distance, end = min(((d, a + e) for a, b in spans for d, e in [myers(item, flat[a:b])]), default=(k + 1, 0))
            if distance > k:
                continue
            head = max(0, end - len(item) - k)
            _, back = myers(item[::-1], flat[head:end][::-1])
            begin = end - back
            if starts is None:
                spots = np.fromiter((x for w in _WORD.finditer(lowered(text)) for x in w.span()), np.int64).reshape(-1, 2)
                origin = spots[:, 0]
                starts = np.concatenate([[0], np.cumsum(spots[:, 1] - origin + 1)[:-1]])
            place = lambda at: int((w := np.searchsorted(starts, at, "right") - 1, origin[w] + at - starts[w])[1])
            out.append((item_id, place(begin), place(end - 1) + 1, distance))
        return sorted(out)


def item_blocks(items: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[tuple]:
    """The items in blocks of about ``limit`` characters, from one pass over them."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    block, size = [], 0
    for row in rows.filter("item_id is not null and text != ''").toLocalIterator():
        if block and size + len(row["text"]) > limit:
            yield tuple(block)
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", limit: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, start, end, distance.

    Texts are compared in lower case with each run of white space as one space. An item counts as
    found if some part of the document is within ``rate`` edits per character of the item; the best
    place is given, the first of equals. Null texts hold nothing; items without id or text are left
    out; items too short for an edit must stand exactly. Repeated rows are each reported. Narrow: the
    documents are scanned once for each block of ``limit`` characters of items, and the driver holds the items.
    A task holds a text a few times over, also a repetitive one, whose places it merges while it finds them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty().alias("text"))
    names = ["doc_id", "item_id", "start", "end", "distance"]

    def search(block: tuple):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(list(block), rate)
            for batch in batches:
                out = [
                    (doc_id, *match)
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for match in matcher.matches(text)
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

        return run

    ddl = ", ".join(f"{n} long" for n in names)
    found = [rows.mapInArrow(search(block), ddl) for block in item_blocks(items, limit)]
    out = found[0] if found else docs.sparkSession.createDataFrame([], ddl)
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no test item is found. Narrow: each task filters its own rows."""

    def keep(block: tuple):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(list(block), rate)
            for batch in batches:
                clean = [not matcher.contains(t) if t else True for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for block in item_blocks(items, limit):
        docs = docs.mapInArrow(keep(block), docs.schema)
    return docs
