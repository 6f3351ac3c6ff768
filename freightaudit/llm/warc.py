"""WARC archives with a Zstandard dictionary of their own.

A task gathers records up to ``ARCHIVE_BYTES``, builds a dictionary from them (at most
``SAMPLE_BYTES``, taken evenly over the archive), and writes a file: a skippable frame that holds
the dictionary, then one frame a record, each compressed on its own with that dictionary, so that
any record can be read with nothing but the dictionary and its offset.  An archive too small for
a dictionary has none, and no such frame.

Of pages with equal payloads the one with the smallest id is written whole; the others are revisit
records that refer to it.  That decision is made on digests alone: payloads are moved once, by page
id, so a payload that a third of all pages share makes no hot partition.

Defined results: a null payload is empty; invalid UTF-8 counts as U+FFFD; a null url leaves the
target out; a null id is written as an empty one and read as null; equal rows are alike (all
responses, or all revisits); a group without any id is written whole; an empty table gives no
archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightaudit.llm.files import new_file, open_file
from freightaudit.sources.sinks import shared_folder, stored

#: Uncompressed bytes of an archive, of the sample its dictionary is built from, and the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16_000_000, 2_000_000, 32_768
#: Fixed values of the formats: the skippable frame that marks a dictionary, the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date written where the input has none.
DATE = "1970-01-01T00:00:00Z"
#: Compressed bytes that are handed to the decompressor at a time.
READ_STEP = 4096


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload) with ``refers_to``: the page whose payload is the same,
    or null for a record written whole.  Payloads under ``least_bytes`` are never revisits."""
    narrow = pages.select(
        "page_id", F.unhex(F.sha1("payload")).alias("digest"), F.length("payload").alias("size")
    )
    large = narrow.where(F.col("size") >= least_bytes)
    copies = large.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("copies")
    )
    repeated = copies.where("copies > 1 and first is not null").drop("copies")
    revisits = (
        large.join(repeated, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select("page_id", "digest", F.col("first").alias("refers_to"))
        .distinct()
        .withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    )
    rows = pages.select("page_id", "url", "payload", F.unhex(F.sha1("payload")).alias("own"))
    return rows.join(
        revisits,
        F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("own") == F.col("_digest")),
        "left",
    ).select("page_id", "url", "payload", "refers_to")


def record(page_id, url: str | None, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """An uncompressed WARC record."""
    name = "" if page_id is None else str(page_id)
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    status += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = status if refers_to is not None else status + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def write_archives(
    records: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Archives in ``folder`` (else the shared one) from (page_id, url, payload, refers_to).
    Returns (file, records, bytes), one row an archive."""
    target = folder or shared_folder(records.sparkSession)
    rows = records.select("page_id", "url", "payload", "refers_to")

    def run(batches):
        return _archives(batches, target, archive_bytes)

    return stored(rows.mapInArrow(run, "file string, records long, bytes long"))


def _archives(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int):
    waiting, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            waiting.append(record(*row))
            size += len(waiting[-1])
            if size >= archive_bytes:
                yield _archive(waiting, folder)
                waiting, size = [], 0
    if waiting:
        yield _archive(waiting, folder)


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from an even sample of the records; None if they are too few for one."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records[::step], level=3)
    except zstandard.ZstdError:
        return None


def _archive(records: list[bytes], folder: str) -> pa.RecordBatch:
    trained, written = build_dictionary(records), 0
    compressor = zstandard.ZstdCompressor(level=3, dict_data=trained)
    with new_file(folder, ".warc.zst") as (uri, out):
        if trained is not None:
            data = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
            written += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        for one in records:
            written += out.write(compressor.compress(one))
    return pa.RecordBatch.from_arrays(
        [pa.array([uri]), pa.array([len(records)]), pa.array([written])],
        ["file", "records", "bytes"],
    )


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of ``archives`` (file): page_id, url, record_type, refers_to, the payload's
    digest and size as stated, and the payload (null for a revisit).  A record that does not match
    its digest and size, or cannot be parsed, is an error."""
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = (
        "page_id long, url string, record_type string, refers_to long, payload_digest string, "
        "payload_bytes long, payload binary"
    )
    return archives.select("file").repartition(parts, "file").mapInArrow(_read, schema)


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one by one."""
    at, known = 0, None
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == DICTIONARY_MAGIC:
            at = 8 + size
            raw = zstandard.ZstdDecompressor().decompress(data[8:at])
            known = zstandard.ZstdCompressionDict(raw)
    reader, view = zstandard.ZstdDecompressor(dict_data=known), memoryview(data)
    while at < len(data):
        frame, pieces = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a record")
            piece = view[at : at + READ_STEP]
            pieces.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(pieces)


def parse(data: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload of a record."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    size = int(fields["X-Payload-Length"])
    if payload is not None and (len(payload), digest_of(payload)) != (size, stated):
        raise ValueError(f"{fields['WARC-Record-ID']} does not match its digest")

    def page(name: str) -> int | None:
        number = fields.get(name, "<urn:page:>")[len("<urn:page:") : -1]
        return int(number) if number else None

    return (
        page("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, page("WARC-Refers-To"),
        stated, size, payload,
    )


_TYPES = (
    pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(),
)
_NAMES = (
    "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload",
)
#: Bytes of payloads in a batch that a reading task gives on.
BATCH_BYTES = 8_000_000


def _read(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for uri in batch.column("file").to_pylist():
            with open_file(uri) as source:
                data = source.read()
            rows, size = [], 0
            for one in frames(data):
                rows.append(parse(one))
                size += len(one)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], list(_NAMES)
    )
