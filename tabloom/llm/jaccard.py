"""Jaccard self-join on word n-grams with filters under several global orders.

The tokens of a set are 64-bit hashes of its n-grams. If two sets are similar enough, their prefixes
share a token under every global order of tokens. Candidates come from the order by document
frequency, whose prefixes hold the rare tokens; they must also share prefix tokens under further
orders, by hash, before the sets are compared in full. Tokens of a single document can't be shared
and stand first in every order, so that only their number is kept.

A group of similar texts is linked through a few of them: each posting list first compares its members
with two of them, and then only those that this has left unconnected with the others, where the
parities of their tokens leave room for enough common ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import blobs
from tabloom.llm.common import (
    BLOCK,
    LOWER,
    SPACES,
    Roller,
    binary_values,
    blocks,
    discard,
    documents,
    mix,
    partitions,
    words_of,
    written,
)
from tabloom.llm.components import components

#: Tokens that a task gathers before it counts them, and before it sends them on (some 100 bytes each).
CHUNK = 2_000_000
SENT = 700_000
#: A token is heavy if it stands in more than HEAVY rows and in more than one in HEAVY_PARTS of all:
#: there are fewer than HEAVY_PARTS of them, so that their table may travel to every task.
HEAVY = 20_000
HEAVY_PARTS = 1 << 17
#: Tokens of the rows that a group holds at once; groups of tokens hold half as many.
GROUP_TOKENS = 2_000_000
#: Orders after the first, by their seeds.
ORDERS = (0x51ED270B, 0x2545F491)
_STEP = np.uint64(0xD1342543DE82EF95)
#: Columns of 64 bits that hold the parities of a set's tokens.
MARKS = [f"m{i}" for i in range(8)]


def hashed_words(data: np.ndarray, roller: Roller) -> np.ndarray:
    """Hashes of the words of one text in order; long texts are cut between words."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not SPACES[data[end - 1]]:
            gap = np.flatnonzero(SPACES[data[end : end + BLOCK]])
            end = end + int(gap[0]) + 1 if len(gap) else min(len(data), end + BLOCK)
        part = data[at:end]
        starts, ends = words_of(part, ~SPACES[part])
        out.append(roller.ranges(roller.sums(LOWER[part]), starts, ends))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; fewer words than ``size`` make one token."""
    if not len(words):
        return words
    width = min(size, len(words))
    out = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        out = out * _STEP + words[k : len(words) - width + 1 + k]
    return np.unique(mix(out + np.uint64(width * 0x9E3779B97F4A7C15 % (1 << 64))))


def token_sets(batch_text: pa.Array, size: int, roller: Roller) -> Iterator[np.ndarray]:
    data, offsets = binary_values(batch_text)
    for lo, hi in blocks(offsets):
        if hi - lo == 1:
            yield shingles(hashed_words(data[offsets[lo] : offsets[hi]], roller), size)
            continue
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        inside = ~SPACES[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[own] = True
        begin = inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1])
        end = inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        words = roller.ranges(roller.sums(LOWER[part]), starts, ends)
        at = np.searchsorted(starts, own)
        for i in range(hi - lo):
            yield shingles(words[at[i] : at[i + 1]], size)


def prefix_length(n, percent: int):
    """Tokens of a set of ``n`` of which a similar set has at least one."""
    return n - -(-percent * n // 100) + 1


def _heavy(docs: DataFrame, size: int, heavy: int) -> tuple[dict[int, int], int]:
    """Counts of the heavy tokens, and of all. Tokens that a chunk has once aren't told, so that a count can be
    too small by the number of chunks; all that matters is that every task has the same."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, held, total = Roller(), [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = (n > 1) & (n * HEAVY_PARTS >= total)
            out = [np.append(tokens[often].view(np.int64), 0), np.append(n[often], total)]
            none = np.zeros(len(out[0]), bool)
            none[-1] = True
            return pa.RecordBatch.from_arrays([pa.array(out[0], mask=none), pa.array(out[1], pa.int64())], ["token", "n"])

        for batch in batches:
            for tokens in token_sets(batch.column("text"), size, roller):
                held.append(tokens)
                total += len(tokens)
                if total >= CHUNK:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = written(counts, "token-counts")
    total = counts.filter("token is null").agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("token").isNotNull() & (F.col("n") > max(heavy, total // HEAVY_PARTS))).collect()
    discard(counts)
    return {r["token"]: r["n"] for r in found}, total


def _send(docs: DataFrame, size: int, percent: int, heavy: dict[int, int], n_token: int, n_doc: int) -> DataFrame:
    """Blobs of (row, token) for token buckets (kind 1), and rows' own facts for row buckets (kind 0)."""
    known = np.sort(np.array(list(heavy), np.int64).view(np.uint64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, row = Roller(), TaskContext.get().partitionId() << 36
        tokens, owners, facts, seen, size_held = [], [], [], set(), 0

        def flush():
            out = []
            if facts:
                info = np.array(facts, np.int64)
                of = info[:, 0] % n_doc
                for b in np.unique(of):
                    out.append((int(b), 0, info[of == b].tobytes()))
            if size_held:
                t, o = np.concatenate(tokens), np.repeat(*np.array(owners, np.int64).T)
                tokens.clear()
                if len(known):
                    at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                    is_heavy = known[at] == t
                    out += [(b, 3, blob) for b, blob in blobs.dealt(o[is_heavy], t[is_heavy], o[is_heavy] % n_doc)]
                    t, o = t[~is_heavy], o[~is_heavy]
                out += [(b, 1, blob) for b, blob in blobs.dealt(o, t, (t % np.uint64(n_token)).astype(np.uint32))]
            return _rows(out)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, own in zip(ids, token_sets(batch.column("text"), size, roller)):
                n = len(own)
                prints = (int(own.sum().view(np.int64)), int(mix(own ^ _STEP).sum().view(np.int64))) if n else (0, 0)
                # equal sets of a task are sent once
                first = n > 0 and (n, *prints) not in seen
                facts.append((row, doc_id is not None, doc_id or 0, n, *prints, first))
                if first:
                    seen.add((n, *prints))
                    tokens.append(own)
                    owners.append((row, n))
                    size_held += n
                row += 1
                if size_held >= SENT or len(facts) >= CHUNK // 8:
                    yield flush()
                    tokens, owners, facts, size_held = [], [], [], 0
                    if len(seen) >= CHUNK // 8:
                        seen = set()
        if facts:
            yield flush()

    return docs.mapInArrow(send, "bucket int, kind int, blob binary")


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["bucket", "kind", "blob"]
    )


def _frequencies(n_doc: int):
    """For a token bucket: tokens of at least two rows go back to their rows with their frequency."""

    def count(table: pa.Table) -> pa.Table:
        kinds, packed = table["kind"].to_numpy(), table["blob"].to_pylist()
        out = [(b, k, p) for b, k, p in zip(table["bucket"].to_pylist(), kinds, packed) if k != 1]
        owners, tokens = blobs.decode_all([p for k, p in zip(kinds, packed) if k == 1])
        if len(tokens):
            order = np.argsort(tokens)
            ranked = tokens[order]
            at = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
            df = np.empty(len(tokens), np.uint32)
            sizes = np.diff(np.append(at, len(tokens)))
            df[order] = np.repeat(sizes, sizes)
            often = df > 1
            owners, tokens, df = owners[often], tokens[often], df[often]
            by = np.argsort(owners, kind="stable")
            owners, tokens, df = owners[by], tokens[by], df[by]
            out += [(b, 2, blob) for b, blob in blobs.dealt(owners, tokens, owners % n_doc, df)]
        return pa.Table.from_batches([_rows(out)])

    return count


_PROFILE = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64())]
    + [("prefix", pa.int64()), ("tokens", pa.binary())]
)


def _profiles(percent: int, heavy: dict[int, int]):
    """For a row bucket: every row's facts, and the shared tokens of rows that can have a partner.

    Tokens are in the first order, by frequency; ``prefix`` says how many of them belong to the prefix.
    """

    def gather(table: pa.Table) -> pa.Table:
        kinds, packed = table["kind"].to_numpy(), table["blob"].to_pylist()
        facts = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 7) for k, p in zip(kinds, packed) if k == 0])
        owners, tokens, df = blobs.decode_all([p for k, p in zip(kinds, packed) if k == 2], 1)
        big_owner, big = blobs.decode_all([p for k, p in zip(kinds, packed) if k == 3])
        if len(big):
            table_keys = np.array(list(heavy), np.int64).view(np.uint64)
            table_n = np.array(list(heavy.values()), np.int64)
            by = np.argsort(table_keys)
            big_df = table_n[by][np.searchsorted(table_keys[by], big)] + (1 << 40)  # after all others
        else:
            big_df = np.zeros(0, np.int64)
        owners, tokens = np.concatenate([owners, big_owner]), np.concatenate([tokens, big])
        df = np.concatenate([df.astype(np.int64), big_df])
        order = np.lexsort((tokens, df, owners))
        owners, tokens = owners[order], tokens[order]
        facts = facts[np.argsort(facts[:, 0], kind="stable")]
        start, end = np.searchsorted(owners, facts[:, 0]), np.searchsorted(owners, facts[:, 0], "right")
        n = facts[:, 3]
        prefix = prefix_length(n, percent) - (n - (end - start))
        open_ = (facts[:, 6] == 1) & (prefix > 0) & (end > start)
        sets = [tokens[a:b].tobytes() if o else None for a, b, o in zip(start, end, open_)]
        columns = [
            pa.array(facts[:, 0]),
            pa.array(facts[:, 2], mask=facts[:, 1] == 0),
            pa.array(n),
            pa.array(facts[:, 4]),
            pa.array(facts[:, 5]),
            pa.array(np.minimum(prefix, end - start)),
            pa.array(sets, pa.binary()),
        ]
        return pa.Table.from_arrays(columns, schema=_PROFILE)

    return gather


def _postings(percent: int):
    """Prefix tokens of each set. ``head`` marks those that serve for partners of at least its size:
    with these more tokens must be common, so that a shorter prefix has one."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, take = batch.column("tokens").to_pylist(), batch.column("prefix").to_numpy()
            heads = [np.frombuffer(s, np.int64)[:k] for s, k in zip(sets, take)]
            if heads:
                sizes = [len(h) for h in heads]
                n = batch.column("n").to_numpy()
                shared = np.array([len(s) // 8 for s in sets], np.int64)
                first = n - -(-2 * percent * n // (100 + percent)) + 1 - (n - shared)
                place = np.concatenate([np.arange(k) for k in sizes])
                columns = [np.repeat(c, sizes) for c in (batch.column("cid").to_numpy(), n, shared)]
                columns = [np.concatenate(heads), *columns, place < np.repeat(first, sizes)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["token", "cid", "n", "shared", "head"])

    return explode


def overlap(a: bytes, b: bytes, prefix_a: int, prefix_b: int) -> tuple[int, bool]:
    """Common tokens, and whether the prefixes share one under each of the further orders."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    for seed in ORDERS:
        heads = []
        for tokens, k in ((a, prefix_a), (b, prefix_b)):
            keys = mix(tokens ^ np.uint64(seed))
            heads.append(np.partition(keys, k - 1)[:k] if k < len(keys) else keys)
        if not len(np.intersect1d(*heads, assume_unique=True)):
            return 0, False
    return len(np.intersect1d(a, b, assume_unique=True)), True


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair with ``both``, its number of common tokens (null if an order rules it out), and ``linked``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("tokens_a", "tokens_b", "prefix_a", "prefix_b")
        for batch in batches:
            found = [overlap(*row) for row in zip(*(batch.column(c).to_pylist() for c in names))]
            both = np.array([f[0] for f in found], np.int64)
            passed = np.array([f[1] for f in found], bool)
            union = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy() - both
            columns = [batch.column("a"), batch.column("b"), pa.array(both, mask=~passed), pa.array(passed & (100 * both >= percent * union))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "both", "linked"])

    side = lambda s: sets.select(
        F.col("cid").alias(s), F.col("tokens").alias(f"tokens_{s}"), F.col("n").alias(f"n_{s}"), F.col("prefix").alias(f"prefix_{s}")
    )
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(check, "a long, b long, both long, linked boolean")


def marks(tokens: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of tokens falls on it: the bits in which two sets differ are at
    most as many as the tokens that only one of them has."""
    width = 64 * len(MARKS)
    odd = np.bincount((tokens >> np.uint64(32)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _marked(sets: DataFrame) -> DataFrame:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [marks(np.frombuffer(s, np.uint64)) for s in batch.column("tokens").to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("cid"), *map(pa.array, np.array(found).T.copy())], ["cid", *MARKS])

    return sets.select("cid", "tokens").mapInArrow(mark, ", ".join(f"{c} long" for c in ["cid", *MARKS]))


def _pairs(left: DataFrame, right: DataFrame, percent: int, most=None) -> DataFrame:
    """Pairs within a posting list that aren't connected and can still be similar enough.

    ``most`` bounds the number of common tokens; the tokens that other rows have bound it always.
    """
    most = F.least("x.shared", "y.shared") if most is None else most
    can = (most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent) & (F.col("x.root") != F.col("y.root"))
    smaller = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.cid") < F.col("y.cid"))
    can &= F.when(smaller, F.col("x.head")).otherwise(F.col("y.head"))
    joined = left.alias("x").join(right.alias("y"), (F.col("x.token") == F.col("y.token")) & can)
    return joined.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def _connect(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all sets that have a link."""
    ddl = "token long, cid long, n long, shared long, head boolean"
    postings = written(sets.select("cid", "n", "prefix", "tokens").mapInArrow(_postings(percent), ddl), "postings")
    # first with the member that has the least of its own, which is likely in the middle of its group
    mine = F.struct((1 - F.col("shared") / F.col("n")).alias("rank"), "cid", "n", "shared", "head")
    ranks = {"h0": mine, "h1": F.struct(F.xxhash64("cid").alias("rank"), "cid", "n", "shared", "head")}
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), *[F.min(r).alias(k) for k, r in ranks.items()])
    lists = written(lists.filter("size > 1").select("token", *[F.struct(f"{k}.cid", f"{k}.n", f"{k}.shared", f"{k}.head").alias(k) for k in ranks]), "lists")
    hubs = lists.select("token", F.explode(F.array_distinct(F.array(*ranks))).alias("hub")).select("token", "hub.*")
    rows = postings.withColumn("root", F.col("cid"))
    tested = _pairs(rows, hubs.withColumn("root", F.col("cid")), percent)
    tested = written(_verify(tested, sets, percent), "tested")
    links = tested.filter("linked").select("a", "b")
    # what is connected already isn't compared again; the rest of each list may be linked with any of it
    roots = components(links)
    near = roots.select(F.col("node").alias("cid"), F.col("root").alias("near"))
    ways = tested.select("a", "b", "both")
    ways = ways.unionAll(ways.select(F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    rows = postings.join(lists.select("token", F.col("h0.cid").alias("hub"), F.col("h0.shared").alias("hub_shared")), "token")
    rows = rows.join(near, "cid", "left").withColumn("root", F.coalesce("near", "cid"))
    rows = rows.join(ways.select(F.col("a").alias("cid"), F.col("b").alias("hub"), "both"), ["cid", "hub"], "left")
    common = F.when(F.col("cid") == F.col("hub"), F.col("hub_shared")).otherwise(F.col("both"))
    rows = written(rows.select("token", "cid", "n", "shared", "head", "root", common.alias("common")), "lists")
    parts = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("token").agg(F.max_by("root", "k").alias("main"), F.count(F.lit(1)).alias("parts"))
    rows = rows.join(main.filter("parts > 1").select("token", "main"), "token").join(_marked(sets), "cid")
    # what two sets share is in the hub or beside it: at most the smaller of each
    most = F.least("x.common", "y.common") + F.least(F.col("x.shared") - F.col("x.common"), F.col("y.shared") - F.col("y.common"))
    most = F.coalesce(F.when(F.col("x.common").isNotNull() & F.col("y.common").isNotNull(), most), F.least("x.shared", "y.shared"))
    differ = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in MARKS), F.lit(0))
    most = F.least(most, F.floor((F.col("x.shared") + F.col("y.shared") - differ) / 2))
    more = _pairs(rows.filter("root != main"), rows, percent, most).join(tested, ["a", "b"], "left_anti")
    more = written(_verify(more, sets, percent).filter("linked").select("a", "b"), "links")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))


def similar_groups(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a set has the distinct
    ``size``-grams of words, or the whole sequence if there are fewer words. Two rows link when 100 *
    intersection >= ``percent`` * union; ``component_id`` is the smallest id reached by links. Null
    texts count as empty; rows without words link with nothing and keep their own id. Rows with
    the same id are rows of their own. A null id never is the smallest: a group of only such rows has a
    null component. An empty table gives none. Sets are compared by 64-bit hashes of their n-grams.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heavy, total = _heavy(rows, size, heavy)
    # as many groups as the tokens need, and a partition for each: a task's share doesn't grow with the input
    n_doc = max(partitions(spark), -(-total // GROUP_TOKENS))
    sent = _send(rows, size, percent, heavy, 2 * n_doc, n_doc).repartitionById(2 * n_doc, "bucket")
    counted = sent.groupBy("bucket").applyInArrow(_frequencies(n_doc), "bucket int, kind int, blob binary").repartitionById(n_doc, "bucket")
    ddl = "row long, doc_id long, n long, print_a long, print_b long, prefix long, tokens binary"
    profiles = written(counted.groupBy("bucket").applyInArrow(_profiles(percent, heavy), ddl), "profiles")
    prints = ["n", "print_a", "print_b"]
    classes = profiles.filter("n > 0").groupBy(*prints).agg(F.min("row").alias("cid"), F.min("doc_id").alias("least"))
    classes = written(classes, "classes")
    # a set is sent once per task that has it: any of these has all its shared tokens
    sets = profiles.filter("tokens is not null").groupBy(*prints).agg(F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix"))
    sets = written(sets.join(classes, prints).select("cid", "n", "prefix", "tokens"), "sets")
    roots = _connect(sets, percent)
    classes = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    classes = classes.withColumn("root", F.coalesce("root", "cid"))
    groups = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(groups, "root").select(*prints, "component_id")
    out = profiles.select("doc_id", *prints).join(classes, prints, "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
