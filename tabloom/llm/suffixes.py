"""Removal of byte strings that stand in an earlier document, by suffix sorting.

Every string of ``length`` bytes belongs to the place of its smallest-hashed gram, which depends on the
string alone, so equal strings belong to equal grams. Grams of a single place are ruled out by their hashes;
the surroundings of the rest are dealt by gram, and each share is sorted in two stages: suffixes smaller
than their successors directly, the others induced from them bucket by bucket. Neighbours with a
common prefix of ``length`` bytes are one string, and all of its places but those of the smallest id go.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import blobs
from tabloom.llm.common import BLOCK, Roller, binary_values, blocks, documents, partitions, written

LENGTH = 50
GRAM = 24
#: Places that a task gathers before it sends them on.
CHUNK = 1_000_000
#: Bytes of surroundings that a task compares among themselves before it sends them on.
CONTEXT_BYTES = 4 << 20
#: A gram with more surroundings than this, and than one in HEAVY_PARTS of all, is dealt string by string.
HEAVY = 20_000
HEAVY_PARTS = 1 << 17
#: Bytes of text whose grams, and of surroundings that, a group holds at once.
GROUP_BYTES = 16 << 20
SHARE_BYTES = 4 << 20

_NO_ID = (1 << 63) - 1


def anchors(data: np.ndarray, roller: Roller, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of a string of ``length`` bytes: the place of its gram; and hashes of all grams."""
    width = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = roller.sums(data)
    at = np.arange(len(data) - gram + 1)
    hashes = roller.ranges(sums, at, at + gram)
    # the low bits tell the place; any of equal grams in a string serves
    low = np.uint64(63)
    key = (hashes & ~low) | (at.astype(np.uint64) & low)
    span, least = 1, key
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(key) - width + 1], least[width - span : width - span + len(key) - width + 1])
    start = np.arange(len(least))
    return start + (((least & low).astype(np.int64) - start) & 63), hashes


def _pieces(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in pieces that share ``length - 1`` bytes, so that each string is in one piece."""
    at = 0
    while at == 0 or at + length <= len(data):
        yield at, data[at : at + BLOCK + length - 1]
        at += BLOCK


def places(data: np.ndarray, offsets: np.ndarray, roller: Roller, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, places of its anchors, their hashes) for the texts of a batch."""
    for lo, hi in blocks(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if hi - lo == 1:
            found = [(at, *anchors(piece, roller, length, gram)) for at, piece in _pieces(part, length)]
            spots = [(u := np.unique(a)) + at for at, a, _ in found]
            marks = [h[np.unique(a)] for _, a, h in found]
            spot, first = np.unique(np.concatenate(spots), return_index=True)
            yield lo, spot, np.concatenate(marks)[first]
            continue
        anchor, hashes = anchors(part, roller, length, gram)
        for i in range(hi - lo):
            a, b = own[i], own[i + 1] - length + 1
            if b > a:
                spot = anchor[a:b]
                spot = np.unique(spot)
                yield lo + i, spot - a, hashes[spot]


def _send(docs: DataFrame, length: int, gram: int, n_gram: int, n_doc: int) -> DataFrame:
    """One blob entry per gram and task chunk for gram buckets (kind 1); grams that different texts of
    the chunk have are known to be shared already (kind 2, for text buckets)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            owners, hashes, spots = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((spots, owners, hashes))
            owners, hashes, spots = owners[order], hashes[order], spots[order]
            new = np.diff(hashes, prepend=~hashes[:1]) != 0
            group = np.cumsum(new) - 1
            other = np.zeros(len(owners), bool)
            other[1:] = ~new[1:] & (owners[1:] != owners[:-1])
            shared = (np.bincount(group, other) > 0)[group]
            tell = shared & (new | other)  # once for each text
            by = np.argsort(owners[new], kind="stable")
            o, h, s = owners[new][by], hashes[new][by] & np.uint64(0xFFFFFFFFFFFF), spots[new][by]
            out = [(b, 1, blob) for b, blob in blobs.dealt(o, h, (h % np.uint64(n_gram)).astype(np.int64), s)]
            by = np.argsort(owners[tell], kind="stable")
            o, s = owners[tell][by], spots[tell][by]
            out += [(b, 2, blob) for b, blob in blobs.dealt(o, s.astype(np.uint64), o % n_doc)]
            a, b, c = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c)], ["bucket", "kind", "blob"])

        for batch in batches:
            data, offsets = binary_values(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for i, spot, hashes in places(data, offsets, roller, length, gram):
                held.append((np.full(len(spot), keys[i]), hashes, spot))
                size += len(spot)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("key", "text").mapInArrow(send, "bucket int, kind int, blob binary")


def _shared(n_doc: int):
    """For a gram bucket: places of grams that different texts have, for the buckets of these texts."""

    def count(table: pa.Table) -> pa.Table:
        kinds, packed = table["kind"].to_numpy(), table["blob"].to_pylist()
        out = [(b, k, p) for b, k, p in zip(table["bucket"].to_pylist(), kinds, packed) if k == 2]
        owners, hashes, spots = blobs.decode_all([p for k, p in zip(kinds, packed) if k == 1], 1)
        if len(owners):
            order = np.argsort(hashes)
            ranked, whose = hashes[order], owners[order]
            at = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
            differ = np.minimum.reduceat(whose, at) != np.maximum.reduceat(whose, at)
            kept = np.sort(order[np.repeat(differ, np.diff(np.append(at, len(order))))])
            kept = kept[np.argsort(owners[kept], kind="stable")]
            o = owners[kept]
            out += [(b, 2, blob) for b, blob in blobs.dealt(o, spots[kept].astype(np.uint64), o % n_doc)]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"bucket": pa.array(a, pa.int32()), "kind": pa.array(b, pa.int32()), "blob": pa.array(c, pa.binary())})

    return count


def _gather(table: pa.Table) -> pa.Table:
    """For a text bucket: the shared places of each text."""
    owners, spots = blobs.decode_all(table["blob"].to_pylist())
    order = np.argsort(owners, kind="stable")
    owners, spots = owners[order], spots[order]
    at = np.flatnonzero(np.diff(owners, prepend=~owners[:1]))
    ends = np.append(at[1:], len(owners))
    found = [np.unique(spots[a:b]).astype(np.int64).tobytes() for a, b in zip(at, ends)]
    return pa.table({"key": pa.array(owners[at]), "spots": pa.array(found, pa.binary())})


_CONTEXT = pa.schema(
    [("gram", pa.int64()), ("context", pa.binary()), ("key", pa.int64()), ("doc_id", pa.int64())]
    + [("start", pa.int64()), ("end", pa.int64())]
)
_CONTEXT_DDL = "gram long, context binary, key long, doc_id long, start long, end long"


def _contexts(length: int, gram: int):
    """The surroundings of shared grams: the bytes of all strings that belong to one. Equal ones of a
    chunk are sent once, with the smallest id; in texts with a larger id they are gone already (gram null)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        held: dict[bytes, list] = defaultdict(list)
        size = 0

        def flush() -> pa.RecordBatch:
            rows, gone = [], defaultdict(list)
            for context, where in held.items():
                least = min(w[1] for w in where)
                sent = False
                for mark, doc_id, key, start in where:
                    if doc_id > least:
                        gone[key, doc_id].append((start, start + len(context)))
                    elif not sent or doc_id == least:
                        sent = True
                        rows.append((mark, context, key, doc_id, start, start + len(context)))
            for (key, doc_id), spans in gone.items():
                rows += [(None, None, key, doc_id, a, b) for a, b in merged(spans)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTEXT)], schema=_CONTEXT)

        for batch in batches:
            keys, ids, spots = (batch.column(c).to_pylist() for c in ("key", "doc_id", "spots"))
            data, offsets = binary_values(batch.column("text"))
            for i, (key, doc_id, packed) in enumerate(zip(keys, ids, spots)):
                text = data[offsets[i] : offsets[i + 1]]
                raw = text.tobytes()
                told = np.frombuffer(packed, np.int64)
                for mark, start, end in _runs(text, told, roller, length, gram):
                    held[raw[start:end]].append((mark, doc_id, key, start))
                    size += end - start
                if size >= CONTEXT_BYTES:
                    yield flush()
                    held, size = defaultdict(list), 0
        if held:
            yield flush()

    return cut


def _runs(text: np.ndarray, told: np.ndarray, roller: Roller, length: int, gram: int) -> list[tuple[int, int, int]]:
    """(gram, start, end) of the bytes of the strings that belong to each place of a shared gram."""
    out = []
    found = [(at, *anchors(piece, roller, length, gram)) for at, piece in _pieces(text, length)]
    grams = [h[s - at] for at, _, h in found for s in [told[(told >= at) & (told < at + len(h))]]]
    shared = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
    for at, anchor, hashes in found:
        if not len(anchor):
            continue
        begin = np.flatnonzero(np.diff(anchor, prepend=-1))
        mark = hashes[anchor[begin]]
        stop = np.append(begin[1:], len(anchor))
        kept = np.isin(mark, shared)
        out += zip(mark[kept].view(np.int64).tolist(), (begin[kept] + at).tolist(), (stop[kept] + at + length - 1).tolist())
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def two_stage(text: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Starts of all strings of ``length`` bytes inside one owner's stretch of ``text``, in sorted order.

    Type B (smaller than its successor) is sorted directly, with the last string of each stretch,
    whose successor isn't there; type A follows from its successor by a scan over first bytes.
    UTF-8 has no byte 255, so that all bytes can move up by one and none is 0.
    """
    text = text + np.uint8(1)
    n = len(text)
    if n < length:
        return np.zeros(0, np.int64)
    inside = np.zeros(n + 1, bool)
    inside[: n - length + 1] = owner[: n - length + 1] == owner[length - 1 :]
    starts = np.flatnonzero(inside[:n])
    keys = np.lib.stride_tricks.sliding_window_view(text, length)
    key = lambda at: np.ascontiguousarray(keys[at]).view(f"S{length}").ravel()
    # the next place where neighbouring bytes differ decides the type
    step = np.diff(text.astype(np.int16))
    where = np.where(step != 0, np.arange(n - 1), n)
    next_step = np.minimum.accumulate(where[::-1])[::-1]
    ahead = next_step[np.minimum(starts, n - 2)] if n > 1 else np.full(len(starts), n)
    decided = ahead < starts + length - 1
    falls = np.zeros(n + 1, bool)
    falls[starts[decided]] = step[ahead[decided]] < 0
    induced = falls.copy()
    induced[starts] &= inside[starts + 1]
    level = np.zeros(n + 1, np.int64)
    level[starts] = ahead - starts
    direct = starts[~induced[starts]]
    direct = direct[np.argsort(key(direct), kind="stable")]
    rising = direct[~falls[direct]]
    ends = direct[falls[direct]]
    out, waiting = [], defaultdict(list)
    first_rising, first_ends = text[rising], text[ends]
    for c in np.unique(text[starts]).tolist():
        own_ends = ends[first_ends == c]
        own_level = level[own_ends]
        at = np.concatenate(waiting.pop(c)) if c in waiting else np.zeros(0, np.int64)
        bucket, depth = [], 0
        # a run of the first byte makes a suffix larger the longer it is
        while len(at) or (own_level >= depth).any():
            more = own_ends[own_level == depth]
            if len(more):
                at = np.insert(at, np.searchsorted(key(at), key(more)), more) if len(at) else more
            bucket.append(at)
            before = at[at > 0] - 1
            at = before[induced[before] & (text[before] == c)]
            depth += 1
        bucket.append(rising[first_rising == c])
        bucket = np.concatenate(bucket)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        head = text[before]
        for d in np.unique(head).tolist():
            waiting[d].append(before[head == d])
    return np.concatenate(out) if out else starts


def repeats(contexts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, start, end) of the strings that a context with a smaller id has too."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    order = two_stage(text, owner, length)
    if not len(order):
        return order, order, order
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    new = np.ones(len(order), bool)
    for lo in range(1, len(order), 1 << 16):  # common prefix of neighbours, whole or not
        hi = min(len(order), lo + (1 << 16))
        new[lo:hi] = (windows[order[lo:hi]] != windows[order[lo - 1 : hi - 1]]).any(1)
    own = ids[owner[order]]
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(own, at)[np.cumsum(new) - 1]
    gone = np.sort(order[least < own])
    if not len(gone):
        return gone, gone, gone
    begin = np.ones(len(gone), bool)
    begin[1:] = (np.diff(gone) > 1) | (owner[gone[1:]] != owner[gone[:-1]])
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(gone)) - 1
    base = np.cumsum(sizes) - sizes
    who = owner[gone[first]]
    return who, gone[first] - base[who], gone[last] - base[who] + length


def _sort_share(length: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        who, start, end = repeats(table["context"].to_pylist(), ids, length)
        base = table["start"].to_numpy()[who]
        return pa.table(
            {"key": pa.array(table["key"].to_numpy()[who]), "doc_id": pa.array(ids[who]), "start": pa.array(base + start), "end": pa.array(base + end)}
        )

    return run


def _cut_out(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_values(batch.column("text"))
            raw = memoryview(data.tobytes())
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "least", "spans"))
            for i, (doc_id, least, spans) in enumerate(zip(*columns)):
                text = raw[offsets[i] : offsets[i + 1]]
                gone = merged([(s["start"], s["end"]) for s in spans or () if s["doc_id"] == doc_id])
                if doc_id > least and len(text) >= length:
                    gone = [(0, len(text))]
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                rows.append(
                    (None if doc_id == _NO_ID else doc_id, len(text), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), [{"start": a, "end": b} for a, b in gone])
                )
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64()] * 4 + [pa.string(), span]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return cut


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed.

    Every byte goes that is covered by a string of ``length`` bytes which also starts in a text with a
    smaller id; ``removed`` lists the maximal spans. Null texts count as empty, texts shorter than
    ``length`` lose nothing, rows with the same id never shorten each other, and a null id counts as
    larger than all. An empty table gives none; extra columns are not read.
    """
    if not 8 <= gram < length or length - gram >= 64:
        raise ValueError("8 <= gram < length < gram + 64 is needed")
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text"
    )
    # equal texts share a key: only the one with the smallest id is looked at, the others go whole
    rows = rows.select(F.xxhash64("text").alias("key"), "doc_id", "text")
    # as many groups as the bytes need, and a partition for each: a task's share doesn't grow with the input
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // GROUP_BYTES))
    blob = "bucket int, kind int, blob binary"
    sent = _send(rows, length, gram, 2 * n, n).repartitionById(2 * n, "bucket")
    shared = sent.groupBy("bucket").applyInArrow(_shared(n), blob).repartitionById(n, "bucket").groupBy("bucket")
    spots = shared.applyInArrow(_gather, "key long, spots binary")
    least = rows.groupBy("key", F.md5("text").alias("digest")).agg(F.min("doc_id").alias("least"))
    least = written(least, "equal-texts")
    first = spots.join(least.select("key", "least"), "key")
    near = rows.join(first, "key").filter("doc_id = least").select("key", "doc_id", "text", "spots")
    near = near.mapInArrow(_contexts(length, gram), _CONTEXT_DDL)
    near = written(near, "contexts")
    todo = near.filter("gram is not null")
    sizes = todo.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    total, size = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("context")), F.lit(0))).first()
    shares = max(2 * partitions(spark), -(-size // SHARE_BYTES))
    large = sizes.filter(F.col("n") > max(heavy, total // HEAVY_PARTS)).select("gram", F.lit(True).alias("large"))
    todo = todo.join(F.broadcast(large), "gram", "left")  # at most HEAVY_PARTS rows
    ordinary = todo.filter("large is null").withColumn("bucket", F.pmod("gram", F.lit(shares)).cast("int"))
    # strings of a heavy gram are compared one by one: their smallest ids are found before rows meet, and the
    # join has one row a string on its right, so that rows of a common string can be split and none are held
    single = todo.filter("large").withColumn("k", F.explode(F.sequence(F.lit(1), F.length("context") - (length - 1))))
    single = single.select(
        F.substring("context", F.col("k"), F.lit(length)).alias("string"), "key", "doc_id", (F.col("start") + F.col("k") - 1).alias("start")
    )
    firsts = single.groupBy("string").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.filter("first < last").select("string", "first")
    # by a second key the join shuffles both sides itself; Spark splits none that lies on an aggregate
    single, firsts = (side.withColumn("mark", F.xxhash64("string")) for side in (single, firsts.hint("merge")))
    later = single.join(firsts, ["string", "mark"]).filter("doc_id > first")
    share = ordinary.select("bucket", "context", "key", "doc_id", "start").repartitionById(shares, "bucket").groupBy("bucket")
    gone = share.applyInArrow(_sort_share(length), "key long, doc_id long, start long, end long")
    gone = gone.unionAll(later.select("key", "doc_id", "start", (F.col("start") + length).alias("end")))
    gone = gone.unionAll(near.filter("gram is null").select("key", "doc_id", "start", "end"))
    gone = gone.groupBy("key").agg(F.collect_list(F.struct("doc_id", "start", "end")).alias("spans"))
    known = least.join(gone, "key", "left").select("key", "digest", "least", "spans")
    out = rows.withColumn("digest", F.md5("text")).join(known, ["key", "digest"]).select("doc_id", "text", "least", "spans")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>"
    return out.mapInArrow(_cut_out(length), ddl)
