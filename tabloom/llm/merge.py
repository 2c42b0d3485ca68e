"""Alignment of two tokenizers' tokens over the same bytes, by merging where their tokens end.

The ends of both tokenizers' tokens, in order over the bytes of several documents, are two sorted lists.
Diagonals of their merge, found by binary search, cut it into pieces of equal work that don't need each
other. A piece finds the places where both lists end; a pair of equal ends that a cut has parted is put together
afterwards. What lies between two such places is a group; a group that reaches over pieces is made
of their parts.

Documents are encoded once. Of each one the distinct linked id pairs are kept in packed form, counted over all
documents, and looked up again: pairs of many documents in a table that travels to every task, the
rest by a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import BLOCK, discard, documents, written
from tabloom.llm.tokens import PATTERN

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Ends of both lists in a piece.
PIECE = 4096
#: Links that are spelled out at once; a group with more is counted by its distinct ids.
LINKS = 1 << 20
#: Pairs that a task counts before it sends them on.
COUNTED = 2_000_000
#: A pair is frequent if it has more than one in FREQUENT of all (document, pair) entries, so that fewer
#: than FREQUENT pairs are: 16 MB at most travel to every task.
FREQUENT = 1 << 20


def byte_letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: itself if it can be seen, else the next letter from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(unseen)}


class ByteLevel:
    """Byte-level BPE from its JSON file; merges must be in the order of the ids that they make."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        made = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        self.path, self.slow = path, None
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encode(t) for t in texts]

    def _encode(self, text: str) -> np.ndarray:
        try:
            return self.coder.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its splitter gives up on white space of a million characters
            pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """Sentence pieces with byte fallback; the tokenizer puts a space before the text itself."""

    def __init__(self, path: str) -> None:
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.coder.encode(texts, num_threads=1)]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How much of ``a`` and of ``b`` comes before each cut of their merge, ``piece`` values apart; equal values: ``a`` first."""
    cuts = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, cuts - len(b)), np.minimum(cuts, len(a))
    while (low < high).any():
        open_ = low < high
        middle = (low + high) // 2
        at = np.where(open_, middle, 0)
        before = np.zeros(len(cuts), bool)
        before[open_] = a[at[open_]] <= b[cuts[open_] - 1 - at[open_]]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low, cuts - low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the sorted lists ``a`` and ``b``, both without repeats, of the values that both have."""
    i, j = diagonals(a, b, piece)
    found = []
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:]):
        if i0 and j0 < len(b) and a[i0 - 1] == b[j0]:  # the cut before this piece has parted a pair
            found.append(([i0 - 1], [j0]))
        own_a, own_b = a[i0:i1], b[j0:j1]
        if len(own_a) and len(own_b):
            at = np.minimum(np.searchsorted(own_b, own_a), len(own_b) - 1)
            same = np.flatnonzero(own_b[at] == own_a)
            found.append((same + i0, at[same] + j0))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def pair_counts(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document, pair, links): how often each pair a * width + b is linked in each document; sorted.

    Group g has the tokens from ends_a[g - 1] to ends_a[g], likewise b, and belongs to document of[g].
    """
    begin_a, begin_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    n_a, n_b = ends_a - begin_a, ends_b - begin_b
    size = n_a * n_b
    docs, pairs, links = [], [], []

    def add(d: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        docs.append(d), pairs.append(p), links.append(n)

    small = np.flatnonzero((size > 0) & (size <= LINKS))
    before = np.cumsum(size[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(before, (before[at - 1] if at else 0) + LINKS, "right")))
        g, reps = small[at:to], size[small[at:to]]
        place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        wide = np.repeat(n_b[g], reps)
        left = ids_a[np.repeat(begin_a[g], reps) + place // wide].astype(np.int64)
        right = ids_b[np.repeat(begin_b[g], reps) + place % wide]
        add(*_summed(np.repeat(of[g], reps), left * width + right))
        at = to
    for g in np.flatnonzero(size > LINKS):
        left, k = np.unique(ids_a[begin_a[g] : ends_a[g]], return_counts=True)
        right, m = np.unique(ids_b[begin_b[g] : ends_b[g]], return_counts=True)
        p = (left.astype(np.int64)[:, None] * width + right[None, :]).reshape(-1)
        add(np.full(len(p), of[g]), p, (k[:, None] * m[None, :]).reshape(-1))
    if not docs:
        return (np.zeros(0, np.int64),) * 3
    if len(docs) == 1:
        return docs[0], pairs[0], links[0]
    return _summed(*map(np.concatenate, (docs, pairs, links)))


def _summed(docs: np.ndarray, pairs: np.ndarray, links: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    order = np.lexsort((pairs, docs)) if len(docs) and docs[0] != docs[-1] else np.argsort(pairs, kind="stable")
    docs, pairs = docs[order], pairs[order]
    first = np.flatnonzero((np.diff(docs, prepend=-1) != 0) | (np.diff(pairs, prepend=-1) != 0))
    if links is None:
        return docs[first], pairs[first], np.diff(np.append(first, len(docs)))
    return docs[first], pairs[first], np.add.reduceat(links[order], first)


class Aligner:
    """Tokens, groups and linked pairs of documents."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.bytes_a, self.bytes_b = pa.array(self.a.tokens, pa.binary()), pa.array(self.b.tokens, pa.binary())
        self.size_a, self.size_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        a, b = range(len(self.a.tokens)), range(len(self.b.tokens))
        self.width = len(b)
        # ids as they stand in the text of the groups, with what follows them
        self.spelled = pa.array([f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b] + [f"{i}" for i in b])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]:
        """(document, (n_a, n_b, n_groups, n_links)), digests of the groups, and linked pairs."""
        n = len(texts)
        whole = [b" " + t.encode() if t else b"" for t in texts]
        a, b = self.a.encode([" " + t for t in texts]), self.b.encode(texts)
        good = [t and self._says(x, self.bytes_a, w) and self._says(y, self.bytes_b, w) for t, x, y, w in zip(texts, a, b, whole)]
        a, b = ([x if g else x[:0] for x, g in zip(y, good)] for y in (a, b))
        counts = np.zeros((n, 4), np.int64)
        counts[:, 0], counts[:, 1] = [len(x) for x in a], [len(x) for x in b]
        ids_a, ids_b = np.concatenate(a) if n else np.zeros(0, np.uint32), np.concatenate(b) if n else np.zeros(0, np.uint32)
        # bytes are counted on over the documents: where one ends, both tokenizers' tokens end
        i, j = common_ends(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]))
        ends_a, ends_b = i + 1, j + 1
        n_a, n_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        of = np.searchsorted(np.cumsum(counts[:, 0]), ends_a, "left")
        counts[:, 2] = np.bincount(of, minlength=n)
        np.add.at(counts[:, 3], of, n_a * n_b)
        return counts, self._digests(ids_a, ids_b, ends_a, ends_b, n_a, n_b, of, counts), pair_counts(ids_a, ids_b, ends_a, ends_b, of, self.width)

    @staticmethod
    def _says(ids: np.ndarray, tokens: pa.Array, text: bytes) -> bool:
        if not len(ids):
            return False
        _, offsets, data = tokens.take(pa.array(ids)).buffers()
        end = int(np.frombuffer(offsets, np.int32, len(ids) + 1)[-1])
        return end == len(text) and data.slice(0, end).to_pybytes() == text

    def _digests(self, ids_a, ids_b, ends_a, ends_b, n_a, n_b, of, counts) -> list[str]:
        """SHA-256 of each document's groups, "" for those without tokens."""
        groups = np.arange(len(n_a))
        own_a, own_b = np.repeat(groups, n_a), np.repeat(groups, n_b)
        spelled = np.empty(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[ends_a - 1] = last_b[ends_b - 1] = True
        size_a, size_b = len(self.a.tokens), len(self.b.tokens)
        spelled[np.arange(len(ids_a)) + np.append(0, ends_b)[own_a]] = ids_a + np.where(last_a, size_a, 0)
        final = last_b.copy()
        final[last_b] = np.diff(of, append=-1) != 0
        spelled[np.arange(len(ids_b)) + ends_a[own_b]] = ids_b + 2 * size_a + np.where(final, 2 * size_b, np.where(last_b, size_b, 0))
        taken = self.spelled.take(pa.array(spelled))
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int32, len(spelled) + 1)
        ends = np.append(0, np.cumsum(counts[:, 0] + counts[:, 1]))
        data = memoryview(data) if data is not None else b""
        return [hashlib.sha256(data[offsets[x] : offsets[y]]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:])]


def pack_pairs(pairs: np.ndarray, links: np.ndarray) -> bytes:
    steps = np.diff(pairs, prepend=0)
    kind = np.uint32 if not len(steps) or steps.max() < 1 << 32 and links.max() < 1 << 32 else np.uint64
    head = bytes([kind().itemsize])
    return head + zstandard.ZstdCompressor(level=1).compress(steps.astype(kind).tobytes() + links.astype(kind).tobytes())


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint32 if blob[0] == 4 else np.uint64).astype(np.int64)
    half = len(values) // 2
    return np.cumsum(values[:half]), values[half:]


_ALIGNED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("pairs", pa.binary())]
)
_ALIGNED_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = None, TaskContext.get().partitionId() << 36
        for batch in batches:
            aligner = aligner or Aligner(path_a, path_b)
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for at, to in _blocks(texts):
                counts, digests, (of, pairs, links) = aligner.align(texts[at:to])
                cuts = np.searchsorted(of, np.arange(to - at + 1))
                packed = [pack_pairs(pairs[x:y], links[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
                columns = [pa.array(np.arange(row, row + to - at)), ids.slice(at, to - at), *map(pa.array, counts.T.copy()), pa.array(digests), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_ALIGNED)
                row += to - at

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents have each pair, by task."""
    pairs, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(held), return_counts=True)
        _, both, total = _summed(np.zeros(len(pairs) + len(new), np.int64), np.concatenate([pairs, new]), np.concatenate([counts, n]))
        return both, total

    for batch in batches:
        for blob in batch.column("pairs").to_pylist():
            own, _ = unpack_pairs(blob)
            held.append(own)
            size += len(own)
            if size >= COUNTED:
                pairs, counts = merged()
                held, size = [], 0
                if len(pairs) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                    pairs, counts = pairs[:0], counts[:0]
    if size:
        pairs, counts = merged()
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])


def _look_up(frequent, width: int):
    """Sums over the links of frequent pairs, and the other pairs with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = frequent.value
        for batch in batches:
            n_best, count_sum, rare, rare_links = [], [], [], []
            for blob in batch.column("pairs").to_pylist():
                pairs, links = unpack_pairs(blob)
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                n = counts[at[hit]]
                n_best.append(int(links[hit][n == best[pairs[hit] // width]].sum()))
                count_sum.append(int((n * links[hit]).sum()))
                rare.append(pairs[~hit])
                rare_links.append(links[~hit])
            columns = [c for c, f in zip(batch.columns, batch.schema) if f.name != "pairs"]
            columns += [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
            ends = np.append(0, np.cumsum([len(r) for r in rare])).astype(np.int32)
            for x in (rare, rare_links):
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())))
            names = [f.name for f in batch.schema if f.name != "pairs"]
            yield pa.RecordBatch.from_arrays(columns, [*names, "best", "sum", "rare", "rare_links"])

    return run


def align_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_a: str = VOCABULARY_A,
    path_b: str = VOCABULARY_B,
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both tokenizers encode the text after a space, special tokens' strings as plain text. Byte offsets where tokens
    of both end cut them into groups; every token of A is linked with every token of B in its group.
    A pair of ids counts as many documents as have it linked; ``n_best`` are the links whose pair has the
    highest count of all pairs of its A id, ties included, and ``count_sum`` adds the counts over links.
    ``groups_sha256`` is the digest of the groups as ``a1,a2|b1;a3|b2,b3``. A text that is null, empty or not
    given back by both tokenizers' bytes has no tokens: zeros and "". Rows with the same id, also
    null ids, are documents of their own; an empty table gives none. A whole text is encoded by one
    task, which needs memory in proportion to the longest text; both files must be readable on every executor.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = written(rows.mapInArrow(_align(path_a, path_b), _ALIGNED_DDL), "aligned")
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    counts = aligned.select("pairs").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("a", F.floor(F.col("pair") / width)), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    table, often = most.toArrow(), counts.filter(F.col("n") * frequent > total).select("pair", "n").toArrow()
    best = np.zeros(max(table["a"].to_pylist(), default=0) + 1, np.int64)
    best[table["a"].to_numpy()] = table["most"].to_numpy()
    order = np.argsort(often["pair"].to_numpy())
    known = spark.sparkContext.broadcast((often["pair"].to_numpy()[order], often["n"].to_numpy()[order], best))
    facts = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    found = aligned.mapInArrow(_look_up(known, width), f"{facts}, best long, sum long, rare array<long>, rare_links array<long>")
    found = written(found, "aligned")
    discard(aligned)
    rare = found.select("row", F.explode(F.arrays_zip(F.col("rare").alias("pair"), F.col("rare_links").alias("links"))).alias("p")).select("row", "p.*")
    few = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    rare = rare.join(few, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum")
    )
    out = found.join(rare, "row", "left")
    return out.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
