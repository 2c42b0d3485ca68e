"""Columns of many small rows packed into one binary value, for shuffles of hashes.

A row of 64-bit hash costs Spark some 30 bytes; a blob carries thousands of them at their own size,
with the owners' numbers as compressed steps.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = "<IIQ"


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def encode(owners: np.ndarray, values: np.ndarray, *extra: np.ndarray) -> bytes:
    """``owners`` (int64, one per value, equal ones adjacent), ``values`` (uint64) and small uint32 columns."""
    at = np.flatnonzero(np.diff(owners, prepend=~owners[:1]))
    sizes = np.diff(np.append(at, len(owners))).astype(np.uint32)
    side = [steps(owners[at]).tobytes(), sizes.tobytes(), *(steps(e.astype(np.uint32)).tobytes() for e in extra)]
    packed = zstandard.ZstdCompressor(level=1).compress(b"".join(side))
    return struct.pack(_HEAD, len(at), len(packed), len(owners)) + packed + values.astype(np.uint64).tobytes()


def decode(blob: bytes, n_extra: int = 0) -> tuple[np.ndarray, ...]:
    """The columns that ``encode`` was given."""
    groups, packed, n = struct.unpack_from(_HEAD, blob)
    at = struct.calcsize(_HEAD)
    side = zstandard.ZstdDecompressor().decompress(blob[at : at + packed])
    owners = np.cumsum(np.frombuffer(side, np.int64, groups))
    sizes = np.frombuffer(side, np.uint32, groups, 8 * groups)
    extra = [
        np.cumsum(np.frombuffer(side, np.uint32, n, 12 * groups + 4 * n * k), dtype=np.uint32) for k in range(n_extra)
    ]
    return np.repeat(owners, sizes), np.frombuffer(blob, np.uint64, n, at + packed), *extra


def decode_all(blobs: list[bytes], n_extra: int = 0) -> tuple[np.ndarray, ...]:
    if not blobs:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64)) + (np.zeros(0, np.uint32),) * n_extra
    return tuple(np.concatenate(c) for c in zip(*(decode(b, n_extra) for b in blobs)))


def dealt(owners: np.ndarray, values: np.ndarray, bucket: np.ndarray, *extra: np.ndarray) -> list[tuple[int, bytes]]:
    """A blob for each bucket that has values; the order inside a bucket stays."""
    if len(bucket) and int(bucket.max()) < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by radix, without a workspace of its size
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    at = np.flatnonzero(np.diff(sorted_bucket, prepend=~sorted_bucket[:1]))
    ends = np.append(at[1:], len(order))
    owners, values, extra = owners[order], values[order], [e[order] for e in extra]
    return [
        (int(sorted_bucket[a]), encode(owners[a:b], values[a:b], *(e[a:b] for e in extra))) for a, b in zip(at, ends)
    ]
