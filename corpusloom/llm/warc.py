"""WARC archives: written through Spark's committer, read back sequentially, one gzip member per record."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import for_python, fresh_path, lookup, written

#: An empty gzip member. The text sink must end every row with a separator; this one is itself legal in a .warc.gz.
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
#: Compressed bytes of one archive file, about, and how many compressed bytes one inflate call is given.
SEGMENT_BYTES = 8_000_000
STEP = 1 << 16


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, level: int = 6) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return _gzip("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level)


def members(stream: io.BufferedIOBase) -> Iterator[bytes]:
    """The gzip members of a stream, one by one, inflated step by step; what follows a member starts the next."""
    left = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            data = left or stream.read(STEP)
            left = b""
            if not data:
                if parts or inflate.unconsumed_tail:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(inflate.decompress(data))
        left = inflate.unused_data
        yield b"".join(parts)


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (line.decode().split(":", 1) for line in lines if b":" in line)}


def _agrees(digest: str | None, data: bytes) -> bool:
    """Whether a header's digest is that of data; one that is missing or of another kind than SHA-1 proves nothing."""
    return digest is None or not digest.startswith("sha1:") or digest.removeprefix("sha1:") == base64.b32encode(hashlib.sha1(data).digest()).decode()


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC header, HTTP header and payload of each record; frames by Content-Length and verifies the digests."""
    for data in members(stream):
        if not data:
            continue
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        warc = _headers(lines[1:])
        name = warc.get("warc-record-id", "a record without an id")
        if not warc.get("content-length", "").isdigit():
            raise ValueError(f"{name}: no Content-Length")
        length = int(warc["content-length"])
        block = rest[:length]
        if len(block) != length or rest[length:] != b"\r\n\r\n":
            raise ValueError(f"{name}: the block is not {length} bytes long")
        if not _agrees(warc.get("warc-block-digest"), block):
            raise ValueError(f"{name}: the block does not match its digest")
        http, _, payload = block.partition(b"\r\n\r\n") if "application/http" in warc.get("content-type", "") else (b"", b"", block)
        if warc.get("warc-type") != "revisit" and not _agrees(warc.get("warc-payload-digest"), payload):
            raise ValueError(f"{name}: the payload does not match its digest")
        yield warc, _headers(http.split(b"\r\n")[1:]), payload


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, segment_bytes: int = SEGMENT_BYTES, level: int = 6) -> None:
    """Writes one record per page under path; archives are files of about segment_bytes, committed task by task.

    Of pages with equal payloads of at least min_revisit bytes, the one with the largest id is a response, the others
    revisit it. Only digests are grouped: the largest id of each repeated digest is found by a partial aggregate and
    looked up from the pages. Pages of payloads that over a thousandth of the repeats share stay where they are; those of
    other repeated payloads meet by digest if the table of these is large.

    A null html is an empty payload. Null urls and ids leave their header out; a null id counts as the smallest, and
    rows that share the largest id are all responses. Extra columns are ignored. An empty table writes no record.
    """
    for_python(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    known = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    known = written(known.filter((F.col("n") > 1) & F.col("first_id").isNotNull()).select(F.col("digest").alias("digest2"), "first_id", "n"), "warc-known")
    rows = lookup(rows, known, {"digest": "digest2"}, "n", "left").drop("digest2", "n")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, data, digest, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, url, first = page_id.as_py(), url.as_py(), first.as_py()
                held.append(make_record(page_id, url, data.as_py(), digest.as_py(), first, first is not None and first != page_id, level))
                size += len(held[-1])
                if size >= segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["segment"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["segment"])

    segments = rows.select("page_id", "url", "payload", "digest", "first_id").mapInArrow(packed, "segment binary")
    out = segments.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    out.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records under path: page_id, url, record_type, payload_bytes, payload_digest (hex), refers_to, and the payload.

    Every file under path is read, whatever its name (names that begin with a dot or an underscore are hidden, as for all
    of Spark's readers), each from its start to its end: members are inflated one by one, framed by Content-Length and
    verified; a record that fails is an error, as is a file that is no archive. A file is one row of one task, so it has
    to stay below two gigabytes. A revisit has no payload of its own (null): its length and digest are those that its
    headers give. Records that another writer made need no
    page id (null), digests (the payload's is then computed) or HTTP block (the block is the payload), but a length.
    """
    fields = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for warc, http, payload in records(io.BytesIO(content.as_buffer())):
                    kind = warc.get("warc-type")
                    ids = [int(warc[k]) if warc.get(k, "").removeprefix("-").isdigit() else None for k in ("x-page-id", "x-refers-to-page-id")]
                    told = warc.get("warc-payload-digest", "")
                    digest = base64.b32decode(told.removeprefix("sha1:")).hex() if told.startswith("sha1:") else hashlib.sha1(payload).hexdigest()
                    length = int(http["content-length"]) if kind == "revisit" and http.get("content-length", "").isdigit() else len(payload)
                    row = (ids[0], warc.get("warc-target-uri"), kind, length, digest, ids[1])
                    rows.append((*row, payload if kind != "revisit" else None) if with_payload else row)
                    size += len(payload) * with_payload + 200
                    if size > 4_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(unpacked, fields + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages as archives into the shared folder and reads the records back, without their payloads."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path, with_payload=False)
