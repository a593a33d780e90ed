"""WARC 1.1 archives with records compressed one by one under a shared
Zstandard dictionary, and their reader.

A partition of pages goes on in further files, none of which has much more
than ``FILE_BYTES``.  A file is: a skippable frame (magic 0x184D2A5D) that holds the dictionary;
one Zstandard frame for each record; a skippable frame of one byte, 0x0A, at
the end of each flush (Spark's writer supplies that byte, see ``store.py``).
The dictionary is built from the first records of the file itself, at most
``SAMPLE_BYTES`` of them.  Where they are too few or too alike to train one,
their own bytes are the dictionary (raw content), so every file with records
has one.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more the one with
the smallest page id is the response; the others are revisit records that
name it and carry its digest and length, but no payload.

Defined results: null html is an empty payload; null urls write no target
URI; a null page id never makes a record the response of others and is read
back as null; rows that repeat the response's page id are responses too.
Control characters in URLs are percent-encoded in the headers.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.store import read_blobs, write_blobs

DICTIONARY_MAGIC = 0x184D2A5D
PAD_MAGIC = 0x184D2A50
#: Records from which a file's dictionary is built, and its size.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Payloads shorter than this are always stored.
MIN_REVISIT = 100
#: Bytes of compressed records handed to the writer at once (a part).
FLUSH_BYTES = 4 << 20
#: Bytes of an archive file; its last part may pass them by one part and one record.
FILE_BYTES = 16 << 20

_NAMESPACE = uuid.UUID(int=0x5EC0_0D00_0000_4000_8000_0000_0000_0001)
_DATE = "1970-01-01T00:00:00Z"  # the table has no fetch time


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record.  Its block is an HTTP message whose Content-Length is
    the payload's, also where the payload itself is left out (revisit)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(sample: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:  # too few records, or nothing in common
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: Iterator[bytes], parts: int = 0, left: list[bytes] | None = None, flush_bytes: int = FLUSH_BYTES) -> Iterator[bytes]:
    """The bytes of a file, in parts that each lack their last byte, 0x0A; it
    ends after ``parts`` of them, if given, and puts the records that it took
    and did not write into ``left``.  Holds the sample, then one part."""
    sample, size, done = [], 0, 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not sample:
        return
    dictionary = _dictionary(sample)
    raw = dictionary.as_bytes()
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress
    part, size = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw], len(raw)
    end = struct.pack("<II", PAD_MAGIC, 1)

    def every():
        while sample:
            yield sample.pop(0)
        yield from records

    for r in every():
        part.append(compress(r))
        size += len(part[-1])
        if size >= flush_bytes:
            yield b"".join([*part, end])
            part, size, done = [], 0, done + 1
            if done == parts:
                left.extend(sample)
                return
    if part:
        yield b"".join([*part, end])


def archives(records: Iterator[bytes], parts: int, flush_bytes: int = FLUSH_BYTES) -> Iterator[bytes]:
    """The parts of as many files as needed, ``parts`` in each but the last."""
    for first in records:
        left = [first]
        while left:
            again, left = left, []
            yield from archive(itertools.chain(again, records), parts, left, flush_bytes)


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of a file, decompressed one at a time."""
    view, at = memoryview(content), 0
    decompressor = zstandard.ZstdDecompressor()
    while at < len(view):
        magic, = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size, = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC:
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(view[at + 8:at + 8 + size].tobytes()))
            at += 8 + size
            continue
        frame, out = decompressor.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            step = view[at:at + 16384]
            out.append(frame.decompress(step))
            at += len(step) - len(frame.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers | {"payload": payload, "payload_length": length}


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, size, digest, refers_to.  The first page of each
    payload comes from a map-side combined min over ids and digests; payloads
    met once need no join, so only the repeated digests are joined back."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"))
    rows = rows.withColumns({"size": F.length("html").cast("long"), "digest": F.sha2("html", 256)})
    firsts = (rows.where(F.col("size") >= min_revisit).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # short payloads are no one's copy: they meet nothing, and are spread by their page
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    rows = rows.withColumn("of", F.when(F.col("size") >= min_revisit, F.col("digest")).otherwise(alone))
    rows = rows.join(firsts.withColumnRenamed("digest", "of"), "of", "left")
    other = F.when((F.col("size") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.select("page_id", "url", "html", "size", "digest", other.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, **options) -> None:
    """Archives of ``pages`` in ``folder``, as many a partition as its bytes need."""
    flush_bytes = min(FLUSH_BYTES, file_bytes)
    parts = max(1, file_bytes // flush_bytes)
    rows = with_revisits(pages, **options)
    # a revisit's payload is not written, so it need not be moved
    rows = rows.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "digest", "refers_to"))):
                    yield record(r[0], r[1], r[2] or b"", *r[3:])
        for part in archives(records(), parts, flush_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], ["blob"])

    write_blobs(rows.mapInArrow(write, "blob binary"), "blob", folder, per_file=parts)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row a record: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (null for a revisit, or where not asked for).
    A response's length and digest are computed from the payload read and
    compared with its headers."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for files in batches:
            for content in files.column("content"):
                rows, size = [], 0
                for raw in read_archive(content.as_py()):
                    r = parse(raw)
                    kind, payload = r["warc-type"], r["payload"]
                    digest = r["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != r["payload_length"]):
                        raise ValueError(f"record {r['warc-record-id']}: the payload does not match its headers")
                    number = lambda k: int(r[k]) if k in r else None
                    rows.append((number("x-page-id"), r.get("warc-target-uri"), kind, number("x-refers-to-page-id"),
                                 r["payload_length"], digest, payload if payloads and kind == "response" else None))
                    size += len(payload) if payloads else 100
                    if size > FLUSH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return read_blobs(spark, folder).mapInArrow(read, schema)
