"""Media columns: payloads as 8-bit audio files, cut into content-defined chunks that are stored once each.

What is stored is the whole media, header and samples. A table in the shared folder holds every distinct chunk of it
(zstd, by digest); a manifest holds, for every distinct text, the ordered digests of its media's chunks. Reading joins the
two, verifies every chunk and every rebuilt media, and takes the payload out of the media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import for_python, fresh_path, lookup, shuffle_files_end_with_the_job, written

#: Chunk lengths in bytes: least, mean distance of cuts after that (a power of two), most.
LEAST, MEAN, MOST = 4_096, 16_384, 65_536
#: The gear hash looks back over this many bytes; it must be less than LEAST.
WINDOW = 32
BLOCK = 64
RATE = 8_000
HEADER = 44
LEVEL = 6
#: How many digests a task remembers in order to drop repeats early; the shuffle by digest drops the rest.
SEEN = 300_000


def gear() -> np.ndarray:
    """A random-looking 32-bit number for each byte value, by rule."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], dtype=np.uint32)


def cut_places(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the rolling gear hash of the last WINDOW bytes allows a cut (the position after the byte).

    The hash is the sum of the bytes' numbers, each shifted by its distance; it is built by doubling the window.
    """
    h, span = table[data], 1
    while span < WINDOW:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, span * 2
    return np.flatnonzero(h >> np.uint32(32 - (MEAN.bit_length() - 1)) == 0) + 1


def chunk_ends(length: int, places: np.ndarray) -> list[int]:
    """The ends of the chunks of a media: the first allowed place at least LEAST on, or MOST on at the latest."""
    ends, start = [], 0
    while length - start > LEAST:
        i = np.searchsorted(places, start + LEAST)
        end = min(start + MOST, length, int(places[i]) if i < len(places) else length)
        ends.append(end)
        start = end
    if start < length:
        ends.append(length)
    return ends


def padded(data: bytes) -> bytes:
    """data, then bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def wav_header(length: int) -> bytes:
    """The header of a mono WAV file with 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + length, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", length)


def is_media(data: bytes) -> bool:
    """data is one whole media of wav_header() and its samples."""
    return len(data) > HEADER and data[:HEADER] == wav_header(len(data) - HEADER)


def samples(media: bytes) -> bytes:
    """The payload that a media holds."""
    if not is_media(media):
        raise ValueError("the stored bytes are no media of this kind")
    return media[HEADER:]


def feature(payload: bytes) -> str:
    """Mean, root mean square about the middle, extremes and middle crossings of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    centred = x.astype(np.int64) - 128
    square = int((centred * centred).sum())
    return f"mean={int(x.sum(dtype=np.int64)) / len(x):.4f};rms={(square / len(x)) ** 0.5:.4f};low={x.min()};high={x.max()};crossings={int(((centred[1:] < 0) != (centred[:-1] < 0)).sum())}"


FACTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def facts(media: bytes, n_bytes: int) -> tuple:
    """The columns of FACTS, all but the given n_bytes from the media as read."""
    payload = samples(media)
    return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))


_FACT_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_FACT_NAMES = [f.split()[0] for f in FACTS.split(", ")]


@dataclass(frozen=True)
class MediaStore:
    """Paths of the chunk table (digest, many, chunk) and of the manifest (text_key, copies, n_bytes, media_digest, digests)."""

    chunks: str
    manifest: str


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _cut(data: bytes, table: np.ndarray) -> tuple[bytes, list[int]]:
    payload = padded(data)
    media = wav_header(len(payload)) + payload
    places = cut_places(np.frombuffer(media, dtype=np.uint8), table) if len(media) > LEAST else np.empty(0, np.int64)
    return media, chunk_ends(len(media), places)


def store_payloads(docs: DataFrame, text_col: str = "text") -> MediaStore:
    """Stores the media of every distinct text: its chunks, each distinct one once, and its ordered chunk list.

    Two passes over the texts: one makes the manifest, without bytes; one sends chunks to the partition of their digest,
    where repeats go. A task drops the repeats that it sees itself before. Null texts are empty texts; equal texts share
    one manifest row, which counts them; a very long text is one row of one task; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    for_python(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("text_key"), text.cast("binary").alias("data"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, again = gear(), {}
        names, kinds = ["text_key", "copies", "n_bytes", "media_digest", "digests"], [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
        for batch in batches:
            out = []
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                if (key := key.as_py()) in again:
                    again[key] += 1
                    continue
                if len(again) >= SEEN:
                    out += [(k, n, None, None, None) for k, n in again.items() if n]
                    again.clear()
                again[key] = 0  # repeats after this one
                data = data.as_py()
                media, ends = _cut(data, table)
                out.append((key, 1, len(data), hashlib.sha256(media).digest(), [hashlib.sha256(media[a:b]).digest() for a, b in zip([0, *ends], ends, strict=False)]))
            if out:
                yield _batch(out, names, kinds)
        if left := [(k, n, None, None, None) for k, n in again.items() if n]:
            yield _batch(left, names, kinds)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer, sent = gear(), zstandard.ZstdCompressor(level=LEVEL), {}
        names, kinds = ["digest", "many", "chunk"], [pa.binary(), pa.int32(), pa.binary()]
        for batch in batches:
            out, size = [], 0
            for data in batch.column(1):
                media, ends = _cut(data.as_py(), table)
                many = int(len(ends) > 1)
                for a, b in zip([0, *ends], ends, strict=False):
                    piece = media[a:b]
                    digest = hashlib.sha256(piece).digest()
                    known = sent.get(digest, -1)
                    if known < 0:
                        out.append((digest, many, packer.compress(piece)))
                        size += len(out[-1][2])
                    elif known < many:
                        out.append((digest, many, None))
                    if len(sent) >= SEEN:
                        sent.clear()
                    sent[digest] = max(known, many)
                if size > 4_000_000:
                    yield _batch(out, names, kinds)
                    out, size = [], 0
            if out:
                yield _batch(out, names, kinds)

    store = MediaStore(fresh_path(spark, "media-chunks"), fresh_path(spark, "media-manifest"))
    with shuffle_files_end_with_the_job(spark):
        lists = rows.mapInArrow(listed, "text_key binary, copies long, n_bytes long, media_digest binary, digests array<binary>")
        once = [F.first(c, ignorenulls=True).alias(c) for c in ("n_bytes", "media_digest", "digests")]
        lists.groupBy("text_key").agg(F.sum("copies").alias("copies"), *once).write.parquet(store.manifest)
        chunks = rows.mapInArrow(chunked, "digest binary, many int, chunk binary")
        chunks.groupBy("digest").agg(F.max("many").alias("many"), F.first("chunk", ignorenulls=True).alias("chunk")).write.parquet(store.chunks)
    return store


def read_payloads(spark: SparkSession, store: MediaStore) -> DataFrame:
    """Rebuilds every stored media and describes it: text_key (hex), copies (rows that have the text) and the columns of
    FACTS, a row for each distinct text.

    Chunks are verified against their digests and media against the manifest; a mismatch is an error. A media of one
    chunk is described where the chunk lies, and only the description is joined; chunks of longer media are joined to
    the manifest by digest and put in order again, so bytes move for those alone. A chunk that very many texts share is
    looked up in a broadcast table (at most a thousand chunks of at most MOST bytes), so its texts do not meet.
    """
    manifest = spark.read.parquet(store.manifest)
    chunks = spark.read.parquet(store.chunks)

    def unpack(packed: bytes, digest: bytes) -> bytes:
        piece = zstandard.ZstdDecompressor().decompress(packed)
        if hashlib.sha256(piece).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} does not match its digest")
        return piece

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, packed in zip(batch.column(0), batch.column(1), strict=True):
                piece = unpack(packed.as_py(), digest.as_py())
                if is_media(piece):  # else it is a part of one
                    out.append((digest.as_py(), *facts(piece, 0)))
            if out:
                yield _batch(out, ["digest", *_FACT_NAMES], [pa.binary(), *_FACT_KINDS])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, copies, n_bytes, expected, parts = (batch.column(k)[i].as_py() for k in range(5))
                media = b"".join(unpack(p["chunk"], p["digest"]) for p in parts)
                if hashlib.sha256(media).digest() != expected:
                    raise ValueError(f"the media of {key.hex()} does not match the manifest")
                yield _batch([(key, copies, *facts(media, n_bytes))], ["text_key", "copies", *_FACT_NAMES], [pa.binary(), pa.int64(), *_FACT_KINDS])

    one = manifest.filter(F.size("digests") == 1).select("text_key", "copies", F.col("n_bytes").alias("own_bytes"), "media_digest", F.col("digests")[0].alias("digest"))
    single = one.join(chunks.select("digest", "chunk").mapInArrow(alone, "digest binary, " + FACTS), "digest")
    single = single.withColumn("checked", F.when(F.hex("media_digest") == F.upper("media_sha256"), True).otherwise(F.raise_error(F.lit("a media does not match the manifest")).cast("boolean")))
    single = single.filter("checked").withColumn("n_bytes", F.col("own_bytes")).select("text_key", "copies", *_FACT_NAMES)
    places = manifest.filter(F.size("digests") > 1).select("text_key", "copies", "n_bytes", "media_digest", F.posexplode("digests").alias("seq", "digest"))
    uses = places.groupBy(F.col("digest").alias("used")).agg(F.count(F.lit(1)).alias("uses"))
    needed = chunks.filter("many = 1").join(uses, F.col("digest") == F.col("used")).select(F.col("digest").alias("chunk_digest"), "chunk", "uses")
    parts = lookup(places, needed, {"digest": "chunk_digest"}, "uses")
    firsts = [F.first(c).alias(c) for c in ("copies", "n_bytes", "media_digest")]
    parts = parts.groupBy("text_key").agg(*firsts, F.array_sort(F.collect_list(F.struct("seq", "digest", "chunk"))).alias("parts"))
    longer = parts.select("text_key", "copies", "n_bytes", "media_digest", "parts").mapInArrow(whole, "text_key binary, copies long, " + FACTS)
    return single.unionByName(longer).withColumn("text_key", F.lower(F.hex("text_key")))


def media_round_trip(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Stores every media, reads the store back, and returns for each row its id and the columns of FACTS.

    The digest of a row's text finds the description of its media: a narrow join, in which rows of a text that very many
    rows share stay where they are. Null ids and repeated rows are kept; null texts are empty texts; extra columns are
    ignored, whatever their names; empty tables stay empty.
    """
    described = written(read_payloads(docs.sparkSession, store_payloads(docs, text_col)), "media-facts").withColumnRenamed("text_key", "fact_key")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("text_key"))
    return lookup(keys, described, {"text_key": "fact_key"}, "copies").select("doc_id", *_FACT_NAMES)
