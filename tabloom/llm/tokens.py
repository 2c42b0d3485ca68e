"""Token counts by section from one encoding of the whole document.

A document is encoded once, so that counts of its sections add up to the document's count. Tokens
and sections are spans of characters; both are in order, so their join is a merge by position. A
token that crosses a border goes to one section by a stated rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the vocabulary's tokenizer cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

RULES = ("start", "end", "most")

_OUT = pa.schema(
    [("doc_id", pa.int64()), ("section", pa.int64()), ("field", pa.string()), ("start", pa.int64())]
    + [("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())]
)
_DDL = "doc_id long, section long, field string, start long, end long, n_tokens long, n_crossing long"


def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer and the number of bytes of each of its tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def owners(begin: np.ndarray, end: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; section i spans borders[i] to borders[i + 1].

    "start": the section of the token's first unit; "end": of its last; "most": the one it covers
    most of, the earliest of equals.
    """
    first = np.searchsorted(borders, begin, "right") - 1
    last = np.searchsorted(borders, end - 1, "right") - 1
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    for i in np.flatnonzero(last > first):
        inside = range(first[i], last[i] + 1)
        out[i] = max(inside, key=lambda s: (min(end[i], borders[s + 1]) - max(begin[i], borders[s]), -s))
    return out


def attribute(text: str, borders: np.ndarray, rule: str, coder: tiktoken.Encoding, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and, of those, how many reach beyond it. ``borders`` counts bytes."""
    spans = sizes[np.asarray(coder.encode_ordinary(text), np.int64)]
    end = np.cumsum(spans)
    begin = end - spans
    edges = np.asarray(borders, np.int64)
    own = owners(begin, end, edges, rule)
    n = len(edges) - 1
    crossing = (begin < edges[own]) | (end > edges[own + 1]) if n else np.zeros(0, bool)
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def count_tokens(
    docs: DataFrame,
    fields: tuple[str, ...] = ("text",),
    id_col: str = "doc_id",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    rule: str = "start",
) -> DataFrame:
    """One row per document and section: field, start and end in characters, tokens, crossing tokens.

    The document is its ``fields`` in order, joined by newlines; each line of a field, with the newline
    after it, is a section, counted from 0. A null field counts as empty and has one empty section. A
    document's ``n_tokens`` add up to the tokens of its whole text, repeated rows are counted each,
    and null ids stay null. ``vocabulary`` must be readable on every executor. Narrow: no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"f{i}") for i, c in enumerate(names)],
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoder(vocabulary, pattern)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held: list[list] = [[] for _ in _OUT]
            size = 0
            for doc_id, *parts in zip(ids, *(batch.column(i + 1).to_pylist() for i in range(len(names)))):
                lines, owner = [], []
                for k, part in enumerate(parts):
                    own = _lines(part, k < len(parts) - 1)
                    lines += own
                    owner += [names[k]] * len(own)
                borders = np.concatenate([[0], np.cumsum([len(x.encode()) for x in lines])])
                chars = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
                n_tokens, crossing = attribute("".join(lines), borders, rule, coder, sizes)
                n = len(lines)
                for column, values in zip(held, ([doc_id] * n, range(n), owner, chars[:-1], chars[1:], n_tokens, crossing)):
                    column.extend(values)
                size += n
                if size > 50_000:
                    yield _batch(held)
                    held, size = [[] for _ in _OUT], 0
            if size:
                yield _batch(held)

    return rows.mapInArrow(count, _DDL)


def _lines(part: str, more: bool) -> list[str]:
    """The lines of a field with their newlines; the join's newline belongs to the last one."""
    lines = (part + "\n" * more).split("\n")
    out = [x + "\n" for x in lines[:-1]]
    return out + [lines[-1]] if lines[-1] or not out else out


def _batch(held: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, _OUT)], schema=_OUT)
