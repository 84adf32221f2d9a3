"""A stored inverted index: postings with positions in packed blocks, in a folder a bucket of terms, so that a search reads
the files of its terms only."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.trigrams import trigrams_of
from corpusloom.functions.udfs import trigrams, word_similarity
from corpusloom.session import ship_package

#: Postings in a block at most.
BLOCK = 2_048
#: Words whose places a worker puts together at a time.
WORDS = 1_000_000
#: Ids of a cell.
SPAN = 4_096
POSTINGS = "term string, first_id long, n int, ids binary, counts binary, positions binary"
NAMES = [f.split()[0] for f in POSTINGS.split(", ")]
FIELDS = "bucket int, " + POSTINGS


def words_of(text: Column) -> Column:
    """The lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _deltas(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences within runs that begin at starts; the first of a run as it is."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _packed(values: np.ndarray) -> bytes:
    """Integers of 0 and more at the width that the largest one needs, which the first byte tells."""
    return _packed_lists(values, np.array([len(values)]))[0].as_py()


def _packed_lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of the given sizes that stand one behind the other, each packed by itself."""
    ends = np.cumsum(sizes)
    most = np.zeros(len(sizes), dtype=np.int64)
    full = sizes > 0
    if len(values):
        most[full] = np.maximum.reduceat(values, (ends - sizes)[full])
    width = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)
    offsets = np.concatenate([[0], np.cumsum(1 + sizes * width)])
    out = np.empty(offsets[-1], dtype=np.uint8)
    out[offsets[:-1]] = width
    for w in np.unique(width).tolist():
        own, at = _bytes_at(sizes, ends - sizes, offsets[:-1] + 1, width == w, w)
        out[at] = values[own].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(out)]).cast(pa.binary())


def _bytes_at(sizes: np.ndarray, starts: np.ndarray, places: np.ndarray, chosen: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of the chosen lists stand, and where their bytes do."""
    n = sizes[chosen]
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(places[chosen], n) + k * width
    return np.repeat(starts[chosen], n) + k, at[:, None] + np.arange(width)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def _unpacked_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What _packed_lists was given."""
    offsets = np.frombuffer(lists.buffers()[1], dtype="<i4", count=len(lists) + 1, offset=4 * lists.offset).astype(np.int64)
    data = np.frombuffer(lists.buffers()[2], dtype=np.uint8)
    width = data[offsets[:-1]].astype(np.int64)
    sizes = (np.diff(offsets) - 1) // width
    starts = np.cumsum(sizes) - sizes
    values = np.empty(sizes.sum(), dtype=np.int64)
    for w in np.unique(width).tolist():
        own, at = _bytes_at(sizes, starts, offsets[:-1] + 1, width == w, w)
        values[own] = np.ascontiguousarray(data[at]).view(f"<u{w}").ravel()
    return values, sizes


def write_index(docs: DataFrame, doc_id: str, terms: Column, path: str, buckets: int = 64, parts: int = 1) -> None:
    """Writes the postings of docs (doc_id: an integer) to path; terms: an array of the terms of a document, in order.

    A row is a block of up to BLOCK postings of one term: first_id, ids (gaps to the document before), counts, and
    positions (gaps within each document), all packed. Rows lie in folders by bucket of the term and are sorted by term,
    so that a reader prunes folders, then row groups. A term's postings are put together where its documents are read, as
    far as their ids lie in one cell of SPAN ids: a row for each term of some documents is shuffled, once, and sorted by
    term and cell. Blocks are then packed as a stream, many terms at a time; of one term, no more than a cell is held
    beside the blocks. parts deals the documents of each bucket to so many tasks, for terms that many of them have. A null
    id or a null term is left out; ids may be negative, and repeat only if their rows are one document.
    """
    most = BLOCK
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), terms.alias("terms")).filter("id is not null")
    rows = rows.mapInArrow(lambda batches: _gathered(_placed(batches)), f"{POSTINGS}, cell long")
    rows = rows.withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(parts)))
    rows = rows.repartition(buckets * parts, "bucket", "part").sortWithinPartitions("term", "cell").drop("part", "bucket")
    blocks = rows.mapInArrow(lambda batches: _blocks(batches, most), POSTINGS).withColumn("bucket", _bucket(F.col("term"), buckets))
    blocks.write.partitionBy("bucket").option("parquet.block.size", str(8 << 20)).parquet(path)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, id, n, at: for each row and distinct term its number of places, and these as gaps (32 bits each)."""
    for batch in batches:
        lists = batch.column(1)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):  # rows of about WORDS words at a time
            before = ends[at] - sizes[at]
            upto = max(at + 1, int(np.searchsorted(ends, before + WORDS, side="right")))
            yield from _placed_rows(batch.column(0).slice(at, upto - at), lists.slice(at, upto - at), sizes[at:upto])
            at = upto


def _placed_rows(ids: pa.Array, lists: pa.Array, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = codes >= 0
    row, place, codes = row[known], place[known], codes[known]
    if not len(codes):
        return
    order = np.argsort(row * len(words.dictionary) + codes, kind="stable")
    row, place, codes = row[order], place[order], codes[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(codes) != 0)]))
    counts = np.diff(np.append(starts, len(row)))
    gaps = _deltas(place, starts).astype("<i4")
    offsets = (4 * np.append(starts, len(row))).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(gaps)])
    out = [words.dictionary.take(pa.array(codes[starts])), ids.take(pa.array(row[starts])), pa.array(counts.astype(np.int32)), packed]
    yield pa.RecordBatch.from_arrays(out, ["term", "id", "n", "at"])


class _Postings(NamedTuple):
    """Postings in order of term (a code of words) and id: one a term and document, with its number of places, and the
    places of all as gaps."""

    words: pa.Array
    code: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    gaps: np.ndarray

    def sliced(self, a: int, b: int) -> _Postings:
        ends = np.cumsum(self.counts)
        return _Postings(self.words, self.code[a:b], self.ids[a:b], self.counts[a:b], self.gaps[ends[a] - self.counts[a] : ends[b - 1]] if a < b else self.gaps[:0])

    def rows(self, starts: np.ndarray) -> list[pa.Array]:
        """The columns of POSTINGS, a row for the postings from each start on; a row has one term."""
        sizes = np.diff(np.append(starts, len(self.ids)))
        places = np.add.reduceat(self.counts, starts)
        gaps = _deltas(self.ids, starts)
        gaps[starts] = 0
        packed = [_packed_lists(*c) for c in ((gaps, sizes), (self.counts, sizes), (self.gaps, places))]
        return [self.words.take(pa.array(self.code[starts])), pa.array(self.ids[starts]), pa.array(sizes.astype(np.int32)), *packed]


def _ordered(words: pa.Array, code: np.ndarray, ids: np.ndarray, counts: np.ndarray, gaps: np.ndarray) -> _Postings:
    """Postings in any order; those of one document, which rows or tasks have parts of, become one."""
    same = code[1:] == code[:-1]
    if not ((code[1:] > code[:-1]) | (same & (ids[1:] > ids[:-1]))).all():
        order = np.lexsort((ids, code))
        starts, sizes = (np.cumsum(counts) - counts)[order], counts[order]
        gaps = gaps[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(len(gaps))]
        code, ids, counts = code[order], ids[order], sizes
        first = np.concatenate([[True], (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])])
        if not first.all():
            starts = np.cumsum(counts) - counts
            places = np.cumsum(gaps)
            places -= np.repeat(places[starts] - gaps[starts], counts)
            owner = np.repeat(np.cumsum(first) - 1, counts)
            places = places[np.lexsort((places, owner))]
            code, ids, counts = code[first], ids[first], np.bincount(owner)
            gaps = _deltas(places, np.cumsum(counts) - counts)
    return _Postings(words, code, ids, counts, gaps)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _placed, those of a batch with one term and ids in one cell of SPAN put together."""
    for batch in batches:
        words, packed = batch.column(0).dictionary_encode(), batch.column(3)
        ends = 4 * np.cumsum(batch.column(2).to_numpy(), dtype=np.int64)
        gaps = np.frombuffer(packed.buffers()[2], dtype="<i4", count=int(ends[-1]) // 4).astype(np.int64)  # _placed writes them from 0 on
        met = _ordered(words.dictionary, words.indices.to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), gaps)
        cell = met.ids // SPAN
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(met.code) != 0) | (np.diff(cell) != 0)]))
        yield pa.RecordBatch.from_arrays([*met.rows(starts), pa.array(cell[starts])], [*NAMES, "cell"])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to most postings of one term, of rows of _gathered in order of term and cell. Of the last term, what
    does not fill a block is held back, and so is its last cell, as more of it may follow."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        for rows in _pieces(batch):
            if held is not None:
                rows = pa.concat_batches([held, rows])
            met = _read(rows)
            last = int(np.searchsorted(met.code, met.code[-1]))
            settled = last + int(np.searchsorted(met.ids[last:], rows.column(len(NAMES))[-1].as_py() * SPAN))
            upto = last + (settled - last) // most * most
            yield from _cut(met.sliced(0, upto), most)
            rest = met.sliced(upto, len(met.ids))
            cell = rest.ids // SPAN
            starts = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 0]))
            held = pa.RecordBatch.from_arrays([*rest.rows(starts), pa.array(cell[starts])], schema=rows.schema)
    if held is not None:
        yield from _cut(_read(held), most)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about WORDS bytes of places at a time."""
    ends = pc.cumulative_sum(pc.binary_length(batch.column(5)).cast(pa.int64())).to_numpy()
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + WORDS, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _read(rows: pa.RecordBatch) -> _Postings:
    words = rows.column(0).dictionary_encode()
    (gaps, sizes), (counts, _), (places, _) = (_unpacked_lists(rows.column(k)) for k in (3, 4, 5))
    starts = np.cumsum(sizes) - sizes
    ids = np.cumsum(gaps)
    ids += np.repeat(rows.column(1).to_numpy() - ids[starts], sizes)
    return _ordered(words.dictionary, np.repeat(words.indices.to_numpy().astype(np.int64), sizes), ids, counts, places)


def _cut(met: _Postings, most: int) -> Iterator[pa.RecordBatch]:
    if not len(met.ids):
        return
    first = np.flatnonzero(np.concatenate([[True], np.diff(met.code) != 0]))
    sizes = np.diff(np.append(first, len(met.ids)))
    place = np.arange(len(met.ids)) - np.repeat(first, sizes)
    yield pa.RecordBatch.from_arrays(met.rows(np.flatnonzero(place % most == 0)), NAMES)


def postings(spark: SparkSession, path: str, terms: list[str], buckets: int = 64, positions: bool = True) -> DataFrame:
    """term, id, tf and (if asked for) positions of the documents that have one of some terms, read from an index."""
    asked = sorted(set(terms))
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, asked)).cast("array<string>")).alias("t")).select(_bucket(F.col("t"), buckets).alias("b"))
    folders = sorted({r["b"] for r in wanted.collect()})  # a number for each term of the search
    rows = spark.read.schema(FIELDS).parquet(path).filter(F.col("bucket").isin(folders) & F.col("term").isin(asked))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for term, first, ids, counts, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, sizes = first + np.cumsum(_unpacked(ids)), _unpacked(counts)
                columns = [pa.array([term] * len(own), pa.string()), pa.array(own), pa.array(sizes)]
                if positions:
                    gaps, ends = _unpacked(packed), np.cumsum(sizes)
                    flat = np.cumsum(gaps)
                    before = np.repeat(np.concatenate([[0], flat[ends[:-1] - 1]]), sizes)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array((flat - before).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["term", "id", "tf", "positions"][: len(columns)])

    ship_package(spark)
    own = rows.select("term", "first_id", "ids", "counts", F.col("positions") if positions else F.lit(None).cast("binary").alias("positions"))
    return own.mapInArrow(unpack, "term string, id long, tf long" + (", positions array<int>" if positions else ""))


def all_terms(spark: SparkSession, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """id, tf: documents that have all terms, with the sum of their counts. Without terms, none."""
    met = postings(spark, path, terms, buckets, positions=False) if terms else spark.createDataFrame([], "term string, id long, tf long")
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.sum("tf").alias("tf")).filter(F.col("_n") == len(set(terms))).select("id", "tf")


def phrase(spark: SparkSession, path: str, words: list[str], buckets: int = 64) -> DataFrame:
    """id, places: documents in which the words stand one behind the other, and where (the first word's positions)."""
    met = postings(spark, path, words, buckets)
    held = met.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m")).filter(F.size("m") == len(set(words)))
    places = F.col("m")[words[0]]
    for k, word in enumerate(words[1:], 1):
        places = F.array_intersect(places, F.transform(F.col("m")[word], _back(k)))
    return held.select("id", places.alias("places")).filter(F.size("places") > 0)


def _back(k: int):
    return lambda p: p - k


def write_trigrams(docs: DataFrame, doc_id: str, text: str, path: str, buckets: int = 64, parts: int = 1) -> None:
    """The index of texts by trigram, for trigram_candidates()."""
    ship_package(docs.sparkSession)
    write_index(docs, doc_id, trigrams(F.col(text)), path, buckets, parts)


def trigram_candidates(spark: SparkSession, path: str, query: str, least: int, buckets: int = 64) -> DataFrame:
    """id, shared: texts that have at least least of the query's distinct trigrams, counted over their postings."""
    wanted = list(dict.fromkeys(trigrams_of(query)))
    if not wanted:
        return spark.createDataFrame([], "id long, shared long")
    met = postings(spark, path, wanted, buckets, positions=False)
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def alike_texts(docs: DataFrame, doc_id: str, text: str, path: str, query: str, above: float, buckets: int = 64) -> DataFrame:
    """doc_id, sim: texts of which the word similarity to the query is above a threshold (0 or more), as by a full scan.

    A text above it has over above times the query's distinct trigrams, so only texts with so many (T-occurrence, counted
    over the postings) are read and compared. In long texts all trigrams occur somewhere: the count prunes titles and
    names, and what it leaves is compared whole.
    """
    size = len(set(trigrams_of(query)))
    few = trigram_candidates(docs.sparkSession, path, query, int(above * size) + 1, buckets)
    rows = docs.join(few.select(F.col("id").alias("_id")), F.col(doc_id) == F.col("_id"), "left_semi")
    return rows.select(doc_id, word_similarity(query, F.col(text), above).alias("sim")).filter(F.col("sim") > above)


def jaccard_texts(docs: DataFrame, doc_id: str, text: str, path: str, query: str, least: float, buckets: int = 64) -> DataFrame:
    """doc_id, shared, sim: texts of which the sets of trigrams share at least the given part of their union."""
    size = len(set(trigrams_of(query)))
    few = trigram_candidates(docs.sparkSession, path, query, max(1, math.ceil(least * size - 1e-9)), buckets)
    rows = docs.select(doc_id, text).join(few, F.col(doc_id) == F.col("id"))
    own = F.size(trigrams(F.col(text)))
    return rows.select(doc_id, "shared", (F.col("shared") / (own + size - F.col("shared"))).alias("sim")).filter(F.col("sim") >= least)
