"""WARC archives compressed with Zstandard, one frame per record.

An archive begins with a skippable frame that holds the dictionary of its other frames. Equal
payloads are stored once; the other records revisit that one. Archives are files in the shared
folder, under names that no other attempt of a task uses; a table of names says which of them count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import partitions, scratch_path, written

#: Fixed values of the format: magic number of the dictionary's skippable frame, and of a Zstandard frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 16 << 10
DICTIONARY_SAMPLES = 64
SAMPLE_BYTES = 64 << 10

_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_NAMES = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


class BadArchive(ValueError):
    """The bytes are not a valid archive."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id, url, html: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    """One record: WARC headers, HTTP headers, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if is_revisit else http + html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(html)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # a header is one line: bytes outside it are written as in a URL
        lines.append("WARC-Target-URI: " + "".join(c if " " < c != "%" else f"%{ord(c):02X}" for c in url))
    if is_revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from the archive's own first records; too few or too short ones serve as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def write_archive(out, records: list[bytes]) -> None:
    samples = [r[:SAMPLE_BYTES] for r in records[:DICTIONARY_SAMPLES]]
    raw = dictionary(samples)
    packed = zstandard.ZstdCompressor().compress(raw)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    for record in records:
        out.write(coder.compress(record))


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode().split("\r\n")
    return first, dict(line.split(": ", 1) for line in lines)


def parse_record(record: bytes) -> tuple:
    """Fields of a record in the order of ``_READ``; raises BadArchive where headers are missing or can't be
    read, or lengths or digests don't agree."""
    try:
        return _parse(record)
    except (KeyError, ValueError) as e:  # UnicodeDecodeError is one, BadArchive may be
        if isinstance(e, BadArchive):
            raise
        raise BadArchive(f"headers can't be read: {e!r}") from e


def _parse(record: bytes) -> tuple:
    head, sep, rest = record.partition(b"\r\n\r\n")
    version, h = _headers(head)
    if not sep or version != "WARC/1.1":
        raise BadArchive(f"not a record: {record[:40]!r}")
    length = int(h["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"{h['WARC-Record-ID']}: length {len(rest) - 4}, header says {length}")
    block = rest[:length]
    if "sha1:" + digest(block) != h["WARC-Block-Digest"]:
        raise BadArchive(f"{h['WARC-Record-ID']}: block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    _, hh = _headers(http)
    size, kind = int(hh["Content-Length"]), h["WARC-Type"]
    stated = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != stated):
        raise BadArchive(f"{h['WARC-Record-ID']}: payload differs from its headers")
    number = lambda x: int(v) if (v := x[10:-1]) else None
    url = h.get("WARC-Target-URI")
    if url is not None:
        url = re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    refers = number(h["WARC-Refers-To"]) if kind == "revisit" else None
    return number(h["WARC-Record-ID"]), url, kind, refers, size, stated, payload if kind == "response" else None


def read_archive(stream) -> Iterator[bytes]:
    """Records of an archive, a frame at a time."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise BadArchive("no dictionary frame at the start")
    size = struct.unpack("<I", head[4:])[0]
    raw = stream.read(size)
    if len(raw) != size:
        raise BadArchive("the dictionary frame is cut short")
    if raw[:4] == FRAME_MAGIC:
        try:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        except zstandard.ZstdError as e:
            raise BadArchive(f"the dictionary can't be decoded: {e}") from e
    try:
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    except (zstandard.ZstdError, ValueError) as e:
        raise BadArchive(f"the dictionary can't be used: {e}") from e
    rest = b""
    while True:
        frame, record = decoder.decompressobj(), []
        while not frame.eof:
            chunk = rest or stream.read(1 << 16)
            rest = b""
            if not chunk:
                if record or frame.unused_data:
                    raise BadArchive("the last frame is cut short")
                return
            try:
                record.append(frame.decompress(chunk))
            except zstandard.ZstdError as e:
                raise BadArchive(f"a frame can't be decoded: {e}") from e
        rest = frame.unused_data
        yield b"".join(record)


def _filesystem(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit: int = 0, date: str = "2024-01-01T00:00:00Z", limit: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """Write a record per row of ``pages`` (page_id, url, html); returns the table of archives (path, n_records) and their folder.

    A null html is an empty payload. Of records with equal payloads of at least ``min_revisit``
    bytes the one with the largest page_id is a response and the others revisit it; a null
    page_id counts as smallest. Of repeated rows with that page_id all are responses. Extra columns
    are not read. ``limit`` bounds the bytes that an archive and its task hold before compression;
    only a single longer record makes a larger one.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"),
    ).withColumn("same", F.concat(F.sha2("html", 256), F.lit(":"), F.length("html")))
    shared = (
        rows.filter(F.length("html") >= min_revisit)
        .groupBy("same")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    # only groups of copies are joined on; Spark splits the hot ones
    rows = rows.join(shared.select("same", "keeper", F.lit(True).alias("copied")), "same", "left").select(
        "page_id",
        "url",
        "html",
        "keeper",
        (F.coalesce("copied", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"),
    )

    def put(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)

        def flush(records):
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(path, compression=None) as out:
                write_archive(out, records)
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(records)]}, schema=_NAMES)

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "keeper", "revisit"))):
                record = record_bytes(*row, date)
                if held and size + len(record) > limit:
                    yield flush(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield flush(held)

    return written(rows.mapInArrow(put, "path string, n_records long"), "warc-names"), folder


def read_warc(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives named in column ``path``: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload (null for revisits). Archives are read as streams, a
    record at a time; headers, lengths and digests are checked, and a bad one raises BadArchive.
    ``folder`` only says which file system the paths are on.
    """

    def get(batches):
        fs, _ = _filesystem(folder)
        for batch in batches:
            for path, said in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                held, size, seen = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for record in read_archive(stream):
                        seen += 1
                        held.append(parse_record(record))
                        size += len(record)
                        if size > 4 << 20:
                            yield _batch(held)
                            held, size = [], 0
                if said is not None and seen != said:
                    raise BadArchive(f"{path}: {seen} records, {said} were written")
                if held:
                    yield _batch(held)

    dealt = archives.select("path", "n_records").repartition(partitions(archives.sparkSession), "path")
    return dealt.mapInArrow(get, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

