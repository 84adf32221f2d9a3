"""Ranked lexical search: a stored index of compressed postings in segments, searched document at a time by shard."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, for_python, written

#: Bytes of text in a segment of the index, and about as many in a shard that is searched by one task.
SEGMENT_BYTES = 32_000_000
#: Bytes of a text that are split at once; items that are searched together.
SLICE_BYTES = 4_000_000
BLOCK_ITEMS = 256
#: Stands for a null id: such documents come after all others.
NO_ID = 2**63 - 1

INDEX = "segment long, term binary, n int, n_bytes long, n_terms long, postings binary, lengths binary"


def _folded() -> bytes:
    """Bytes of UTF-8 to what they count as: digits, letters (A-Z lower-cased) and what is not ASCII; else a blank."""
    keep = lambda i: i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32
    return bytes(keep(i) for i in range(256))


_FOLD = _folded()


def terms_of(data: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8; all bytes of a character that is not ASCII count alike, so no term is cut."""
    return data.translate(_FOLD).split() if data else []


def pack_numbers(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative integers as variable-length bytes (seven bits each, the last one with the high bit set), and where
    each one ends."""
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        some = size > k
        out[ends[some] - 1 - k] = (values[some] >> 7 * k & 0x7F) | (0x80 if k == 0 else 0)
    return out.tobytes(), ends


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    last = raw >= 0x80
    if last.all():
        return (raw & 0x7F).astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.repeat(ends, ends - starts + 1) - np.arange(len(raw))
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << 7 * place, starts)


class _Segment:
    """Postings of the documents of a part of a task's rows, in memory of bounded size."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.pairs: list[np.ndarray] = []  # term << 32 | document, once for each occurrence
        self.n_bytes = 0

    def add(self, doc_id: int | None, data: bytes | None) -> None:
        if not data:
            return
        ids, doc, n, at = self.ids, len(self.docs), 0, 0
        while at < len(data):
            end = min(len(data), at + SLICE_BYTES)
            while end < len(data) and _FOLD[data[end]] != 32:
                end += 1
            terms = terms_of(data[at:end])
            found = np.fromiter((ids.setdefault(t, len(ids)) for t in terms), dtype=np.int64, count=len(terms))
            self.pairs.append(found << 32 | doc)
            n, at = n + len(terms), end
        if n:
            self.docs.append(NO_ID if doc_id is None else doc_id)
            self.lengths.append(n)
            self.n_bytes += len(data)

    def rows(self, segment: int) -> pa.RecordBatch | None:
        """One row for the documents (term null: ids as gaps in postings) and one for each term, terms in order."""
        if not self.docs:
            return None
        docs = np.array(self.docs, dtype=np.int64)
        order = np.argsort(docs, kind="stable")
        place = np.empty(len(docs), dtype=np.int64)
        place[order] = np.arange(len(docs))
        terms = sorted(self.ids)
        rank = np.empty(len(terms), dtype=np.int64)
        rank[np.fromiter(map(self.ids.__getitem__, terms), dtype=np.int64, count=len(terms))] = np.arange(len(terms))
        pairs = np.concatenate(self.pairs)
        pairs = rank[pairs >> 32] << 32 | place[pairs & 0xFFFFFFFF]
        pairs, tf = np.unique(pairs, return_counts=True)
        term, at = pairs >> 32, pairs & 0xFFFFFFFF
        first = np.concatenate([[True], term[1:] != term[:-1]])
        gaps = np.where(first, at, at - np.concatenate([[0], at[:-1]]))
        data, ends = pack_numbers(np.stack([gaps, tf], axis=1).reshape(-1))
        upto = ends[np.append(np.flatnonzero(first)[1:], len(term)) * 2 - 1]
        ids = docs[order]
        lengths, _ = pack_numbers(np.array(self.lengths, dtype=np.int64)[order])
        blobs = pa.BinaryArray.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(np.concatenate([[0], upto]).astype(np.int32).tobytes()), pa.py_buffer(data)])
        n = np.bincount(term)
        cells = [
            pa.array([segment] * (len(terms) + 1), pa.int64()),
            pa.array([None, *terms], pa.binary()),
            pa.array(np.concatenate([[len(docs)], n]), pa.int32()),
            pa.array([self.n_bytes] + [0] * len(terms), pa.int64()),
            pa.array([sum(self.lengths)] + [0] * len(terms), pa.int64()),
            pa.concat_arrays([pa.array([ids.astype("<i8").tobytes()], pa.binary()), blobs]),
            pa.array([lengths] + [None] * len(terms), pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The index as a written table, a row for each segment and term: n documents, and for each, in the order of ids, the
    gap to the one before and the occurrences. The row of a segment without a term holds its ids and lengths.

    No text is shuffled: a segment is what one task reads, up to SEGMENT_BYTES and one document. Documents without a term
    are not in it.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, _Segment()
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.add(doc_id, data.as_py())
                if held.n_bytes >= SEGMENT_BYTES:
                    yield held.rows(part << 20 | n)
                    held, n = _Segment(), n + 1
        if (rest := held.rows(part << 20 | n)) is not None:
            yield rest

    for_python(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    return written(docs.select(F.col(f"`{id_col}`").cast("long"), text).mapInArrow(index, INDEX), "lexical-index")


class _Terms:
    """The postings of a term in one shard: places of documents and what the term adds to each, as lists when needed."""

    __slots__ = ("at", "gain", "most", "lists")

    def __init__(self, at: np.ndarray, gain: np.ndarray):
        self.at, self.gain, self.most, self.lists = at, gain, int(gain.max()), None

    def as_lists(self) -> tuple[list[int], list[int]]:
        if self.lists is None:
            self.lists = self.at.tolist(), self.gain.tolist()
        return self.lists

    def kth(self, k: int) -> int:
        """The k-th highest gain, 0 if there are fewer: so many documents score that at least."""
        return int(np.partition(self.gain, len(self.gain) - k)[len(self.gain) - k]) if len(self.gain) >= k else 0


def best_documents(terms: list[_Terms], k: int, floor: int) -> list[tuple[int, int]]:
    """The k best (score, -place) by a document-at-a-time merge of sorted postings; ties go to the lower place.

    Cursors stand in a heap keyed by place. The result heap is bounded; a document has to beat its least. Terms that
    together cannot do so are not merged: what they add to a candidate is looked up, dearest first, while it still can
    win. floor is a score that no result stays below or at.
    """
    terms = sorted(terms, key=lambda t: t.most)
    upto = [0]
    for t in terms:
        upto.append(upto[-1] + t.most)
    least, best = floor, []
    first = sum(bound <= least for bound in upto[1:])  # terms before it cannot win alone
    lists = [t.as_lists() if i >= first else None for i, t in enumerate(terms)]
    seek = [0] * len(terms)
    heap = [(lists[i][0][0], i, 0) for i in range(first, len(terms))]
    heapq.heapify(heap)
    while heap:
        place, i, at = heap[0]
        score = 0
        while True:
            where, gain = lists[i]
            score += gain[at]
            at += 1
            if at < len(where):
                heapq.heapreplace(heap, (where[at], i, at))
            else:
                heapq.heappop(heap)
            if not heap or heap[0][0] != place:
                break
            _, i, at = heap[0]
        for i in range(first - 1, -1, -1):
            if score + upto[i + 1] <= least:
                break
            if lists[i] is None:
                lists[i] = terms[i].as_lists()
            where, gain = lists[i]
            seek[i] = at = bisect_left(where, place, seek[i])
            if at < len(where) and where[at] == place:
                score += gain[at]
        if score <= least:
            continue
        if len(best) < k:
            heapq.heappush(best, (score, -place))
        else:
            heapq.heapreplace(best, (score, -place))
        if len(best) == k and best[0][0] > least:
            least = best[0][0]
            grown = first
            while grown < len(terms) and upto[grown + 1] <= least:
                grown += 1
            if grown > first:
                for i in range(first, grown):
                    seek[i] = 0
                first = grown
                heap = [x for x in heap if x[1] >= first]
                heapq.heapify(heap)
    return best


def search_index(index: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", k: int = 50, b: int = 50) -> DataFrame:
    """item_col, rank, doc_id, score of the k best documents of each item, from a table of build_index().

    A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))) and adds w * ((10**9 tf) div (1000 tf + 20 m)) with
    m = 100 - b + ((b n N) div L), where N documents with terms have L terms, df of them the term, and the document has n
    terms, tf times this one. Only scores above 0 are returned; equal scores rank by ascending id.

    Segments are dealt to shards of about SEGMENT_BYTES of text; a task holds the postings of one block of items
    (BLOCK_ITEMS) in one shard, merges them and keeps k results an item. Those are merged in two levels, so that no task
    gets the results of all shards.
    """
    spark = index.sparkSession
    for_python(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                terms = sorted(set(terms_of(data)))
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(terms), item.type), pa.array(terms, pa.binary())], ["item", "word"])

    kind = items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(f"`{item_col}`"), F.col(f"`{text_col}`").cast("string").cast("binary")).mapInArrow(split, f"item {kind}, word binary")
    asked = written(asked.distinct(), "lexical-items")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    inner = F.col("term").isNull()
    n_docs, n_terms, n_bytes, segments = index.filter(inner).agg(total("n"), total("n_terms"), total("n_bytes"), F.count(F.lit(1))).first()
    if not segments:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, doc_id long, score long")
    n_items = asked.select("item").distinct().count()
    blocks = max(1, -(-n_items // BLOCK_ITEMS))
    shards = min(segments, max(-(-n_bytes // SEGMENT_BYTES), 2 * spark.sparkContext.defaultParallelism))

    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    words = asked.groupBy("word", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("item"))).alias("items"))
    known = index.filter(~inner).join(asked.select("word").distinct(), F.col("term") == F.col("word"), "left_semi")
    known = written(known.select("segment", "term", "n", "postings"), "lexical-known")
    df = known.groupBy(F.col("term").alias("of")).agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    words = words.join(df, F.col("word") == F.col("of")).select("word", "block", "items", weight.alias("w")).filter("w > 0")
    rows = known.join(words, F.col("term") == F.col("word")).select("segment", "block", "w", "term", "postings", F.lit(None).cast("binary").alias("lengths"), "items")
    none = F.lit(None)
    tables = index.filter(inner).select("segment", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), none.cast("long").alias("w"), "term", "postings", "lengths", none.cast(rows.schema["items"].dataType).alias("items"))
    rows = rows.unionByName(tables).withColumn("shard", F.pmod(F.xxhash64("segment"), F.lit(shards)))

    def search(rows: pa.Table) -> pa.Table:
        where: dict[int, tuple[int, int]] = {}
        ids, lengths, at = [], [], 0
        inner = rows.filter(pa.compute.is_null(rows["term"]))
        for segment, data, sizes in zip(inner["segment"].to_pylist(), inner["postings"].to_pylist(), inner["lengths"].to_pylist(), strict=True):
            ids.append(np.frombuffer(data, dtype="<i8"))
            lengths.append(unpack_numbers(sizes))
            where[segment] = at
            at += len(ids[-1])
        docs = np.concatenate(ids)
        order = np.argsort(docs, kind="stable")
        place = np.empty(len(docs), dtype=np.int64)
        place[order] = np.arange(len(docs))
        m = (100 - b + b * np.concatenate(lengths)[order] * n_docs // n_terms) * 20
        held: dict[bytes, list[np.ndarray]] = {}
        weights: dict[bytes, int] = {}
        items: dict = {}
        rest = rows.filter(pa.compute.is_valid(rows["term"]))
        for segment, term, w, data, names in zip(*(rest[c].to_pylist() for c in ("segment", "term", "w", "postings", "items")), strict=True):
            if term not in held:
                held[term], weights[term] = [], w
                for name in names:
                    items.setdefault(name["item"], []).append(term)
            gaps, tf = unpack_numbers(data).reshape(-1, 2).T
            held[term].append((place[where[segment] + np.cumsum(gaps)], tf))
        terms = {}
        for term, parts in held.items():
            at, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
            turn = np.argsort(at)
            at, tf = at[turn], tf[turn]
            terms[term] = _Terms(at, weights[term] * (1_000_000_000 * tf // (1000 * tf + m[at])))
        floors = {term: t.kth(k) for term, t in terms.items()}
        out = []
        for item, names in items.items():
            floor = max(0, max(floors[t] for t in names) - 1)
            out += [(item, int(docs[order[-p]]), s) for s, p in best_documents([terms[t] for t in names], k, floor)]
        columns = zip(*out, strict=True) if out else [[]] * 3
        kinds = [rest.schema.field("items").type.value_type.field(0).type, pa.int64(), pa.int64()]
        cells = [pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)]
        return pa.table([*cells, pa.array([int(rows["shard"][0].as_py())] * len(out), pa.int64())], names=["item", "doc_id", "score", "shard"])

    found = written(rows.groupBy("shard", "block").applyInArrow(search, f"item {kind}, doc_id long, score long, shard long"), "lexical-found")
    group = F.pmod(F.col("shard"), F.lit(max(1, round(shards**0.5))))
    best = [F.col("score").desc(), F.col("doc_id").asc()]
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("item", group).orderBy(*best))).filter(F.col("place") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k)
    id_out = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    out = written(ranked.select(F.col("item").alias(item_col), "rank", id_out.alias("doc_id"), "score"), "lexical-ranked")
    discard(asked, known, found)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", k: int = 50) -> DataFrame:
    """build_index() and search_index() in one: the k best documents of each item.

    Null and empty texts have no terms: such documents are not counted and not found, such items find nothing. Rows with
    equal ids are documents of their own; a null id comes after all others and is returned as null. Rows of one item (a
    null item too) are one query of all their terms, once each. Very long texts are split in slices between terms. Ties
    rank by id. Other columns are not read, whatever their names. Empty tables find nothing.
    """
    index = build_index(docs, text_col, id_col)
    out = search_index(index, items, text_col, item_col, k)
    discard(index)
    return out
