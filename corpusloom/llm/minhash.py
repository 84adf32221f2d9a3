"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Documents with equal shingle sets are one node. A bucket's star links its least node to the others; every link is
confirmed on the full sets. A bucket whose nodes are one component by then is settled. In the others, which are few,
the star may have missed links between its rays: their nodes are compared across components, in tiles of two blocks of
bounded size, and a tile returns links only. No candidate is left out, and no group emits its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, for_python, lookup, unused, written
from corpusloom.llm.components import connected

WORDS = 5
#: Similarity as a fraction, so that it is compared in whole numbers.
ENOUGH, OF = 75, 100
#: 24 bands of 3 of 72 bins: a pair at 0.75 shares no band with probability (1 - 0.75^3)^24, about 2 in a million.
BANDS, ROWS = 24, 3
BINS = BANDS * ROWS
#: Members that one copy of a star's centre is compared with, about.
STAR = 64
#: Nodes in a block of a bucket that its star leaves unsettled; a tile compares two blocks.
BLOCK = 256

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_EDGES = np.array([(k << 64) // BINS for k in range(BINS)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _detours(tries: int) -> np.ndarray:
    """For each bin, a random sequence of bins to borrow from, the same for all documents."""
    at = np.arange(BINS * tries, dtype=np.uint64).reshape(BINS, tries)
    return (_mixed(at * _MIX[0] + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


_NEAR, _FAR = _detours(64), _detours(4096)


def words_of(text: str | None) -> list[bytes]:
    """A text's words: A-Z lower-cased, cut at ASCII white space."""
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct shingles of five words, as sorted 64-bit hashes; fewer words are one shingle, none are none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(WORDS, len(words))
    h = one[: len(one) - span + 1].copy()
    for k in range(1, span):
        h = h * _MIX[0] + one[k : len(one) - span + 1 + k]
    return np.unique(_mixed(h + np.uint64(span)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation sketch of a non-empty sorted set: the least hash in each of BINS equal ranges; an empty bin
    borrows from the first non-empty bin of its own random sequence (optimal densification)."""
    at = np.searchsorted(hashes, _EDGES)
    upto = np.append(at[1:], len(hashes))
    full = at < upto
    out = hashes[np.minimum(at, len(hashes) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[_NEAR[empty]]
        source = _NEAR[empty, hit.argmax(axis=1)]
        lost = ~hit.any(axis=1)
        if lost.any():
            hit = full[_FAR[empty[lost]]]
            source[lost] = np.where(hit.any(axis=1), _FAR[empty[lost], hit.argmax(axis=1)], np.flatnonzero(full)[0])
        out = out.copy()
        out[empty] = out[source]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for j in range(ROWS):
        key = _mixed(key * _MIX[0] + rows[:, j])
    return key.view(np.int64)


def _signed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, n_shingles, node (a 64-bit hash of the set; null if empty), bands and packed words for a task's first of
    a node."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            nodes, sizes, bands, packed = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                hashes = shingles(words)
                sizes.append(len(hashes))
                node = xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None
                nodes.append(node)
                if node is None or node in seen:
                    bands.append(None)
                    packed.append(None)
                else:
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    bands.append(band_keys(signature(hashes)))
                    packed.append(packer.compress(b" ".join(words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "node", "bands", "packed"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), _text_key(text_col).alias("text_key"))
    return rows.mapInArrow(sign, "doc_id long, text_key binary, n_shingles long, node long, bands array<long>, packed binary")


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (centre, node), distinct: those whose full sets are similar enough, as edges (a, b).

    A centre with many members is copied, once for STAR of them, so a hot star is many groups; each group is a run of
    sorted rows that starts with its centre, compared as it streams by.
    """
    many = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("m"))
    many = written(many.select(F.col("centre").alias("c2"), F.ceil(F.col("m") / STAR).cast("int").alias("copies")), "stars")
    rays = pairs.join(many, F.col("centre") == F.col("c2")).select("centre", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy"), "node", F.lit(1).alias("ray"))
    heads = many.select(F.col("c2").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("c2").alias("node"), F.lit(0).alias("ray"))
    rows = rays.unionByName(heads).join(texts, "node").select("centre", "copy", "ray", "node", "packed")
    rows = rows.repartition("centre", "copy").sortWithinPartitions("centre", "copy", "ray")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, centre, own = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            out = []
            for at, copy, ray, node, packed in zip(*(batch.column(i) for i in range(5)), strict=True):
                hashes = shingles(opener.decompress(packed.as_py()).split(b" "))
                if ray.as_py() == 0:
                    centre, own = (at.as_py(), copy.as_py()), hashes
                    continue
                if (at.as_py(), copy.as_py()) != centre:
                    raise ValueError("a star lost its centre")
                if similar(own, hashes):
                    out.append((centre[0], node.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return written(rows.mapInArrow(compare, "a long, b long"), "links")


def _across(shared: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different components in one bucket; at least a spanning set of them.

    Buckets with the same nodes are compared once. A component with at least BLOCK nodes in a bucket has blocks of its
    own, which its nodes are dealt into by hash; smaller components are dealt into blocks whole. Blocks of one component
    need not meet one another, nor be compared within. Nothing is sorted or numbered by bucket.
    """
    held = shared.select("bucket", "node").join(roots.withColumnRenamed("node", "r2"), F.col("node") == F.col("r2"), "left")
    held = written(held.select("bucket", "node", F.coalesce("root", "node").alias("root")), "held")
    mixed = held.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.count(F.lit(1)).alias("m"))
    mixed = mixed.filter("lo != hi").groupBy("x", "y", "m").agg(F.min("bucket").alias("b2"))
    mixed = written(mixed.select("b2", "m"), "mixed")
    held = written(lookup(held, mixed, {"bucket": "b2"}, "m").select("bucket", "node", "root", "m"), "unsettled")
    sizes = written(held.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c")).withColumnsRenamed({"bucket": "b3", "root": "r3"}), "unsettled-sizes")
    small = sizes.groupBy(F.col("b3").alias("b4")).agg(F.sum(F.when(F.col("c") < BLOCK, F.col("c")).otherwise(0)).alias("small"), F.count(F.lit(1)).alias("roots"))
    sizes = lookup(sizes, written(small, "unsettled-small"), {"b3": "b4"}, "roots").select("b3", "r3", "c", "small")
    sized = lookup(held, written(sizes, "unsettled-sized"), {"bucket": "b3", "root": "r3"}, "c")
    own = F.xxhash64(F.lit(1), "root", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK)))
    packed = F.xxhash64(F.lit(2), F.pmod(F.xxhash64("root"), F.greatest(F.ceil(F.col("small") / BLOCK), F.lit(1))))
    dealt = written(sized.select("bucket", "node", "root", F.when(F.col("c") >= BLOCK, own).otherwise(packed).alias("block")), "dealt")
    blocks = dealt.groupBy("bucket", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    left = blocks.select(F.col("bucket").alias("b1"), F.col("block").alias("i"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    tiles = left.join(blocks, (F.col("b1") == F.col("bucket")) & (F.col("i") <= F.col("block")) & ((F.col("lo") != F.col("lo1")) | (F.col("lo") != F.col("hi")) | (F.col("lo1") != F.col("hi1"))))
    tiles = tiles.select("b1", "i", F.col("block").alias("j"), F.explode(F.array_distinct(F.array("i", "block"))).alias("b"))
    rows = dealt.join(tiles, (F.col("bucket") == F.col("b1")) & (F.col("block") == F.col("b")))
    rows = rows.select("bucket", "i", "j", "node", "root").join(texts, "node").select("bucket", "i", "j", "root", "node", "packed")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, tile, met, own = zstandard.ZstdDecompressor(), None, [], {}

        def find(x: int) -> int:
            while own.setdefault(x, x) != x:
                own[x] = own[own[x]]
                x = own[x]
            return x

        for batch in batches:
            out = []
            for *key, root, node, packed in zip(*(batch.column(k) for k in range(6)), strict=True):
                key, root = [k.as_py() for k in key], root.as_py()
                if key != tile:
                    tile, met, own = key, [], {}
                hashes = shingles(opener.decompress(packed.as_py()).split(b" "))
                for other, at, theirs in met:
                    if find(other) != find(root) and similar(hashes, theirs):
                        own[find(root)] = find(other)
                        out.append((at, node.as_py()))
                met.append((root, node.as_py(), hashes))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return written(rows.mapInArrow(compare, "a long, b long"), "links")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: the roots are contracted, and nodes follow."""
    ends = links
    for side in ("a", "b"):
        ends = ends.join(roots.withColumnsRenamed({"node": f"n{side}", "root": f"r{side}"}), F.col(side) == F.col(f"n{side}"), "left")
        ends = ends.withColumn(side, F.coalesce(f"r{side}", side)).drop(f"n{side}", f"r{side}")
    above = connected(ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    lone = above.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti")
    return written(moved.unionByName(lone), "components")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, on sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or OF * len(a) < ENOUGH * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return OF * both >= ENOUGH * (len(a) + len(b) - both)


def _may(n: Column, m: Column) -> Column:
    """Sets of such sizes can be similar enough."""
    return OF * F.least(n, m) >= ENOUGH * F.greatest(n, m)


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links, itself included), kept; a row per document.

    Words are A-Z lower-cased runs without ASCII white space; a document's set is its distinct shingles of five words, or
    all its words as one if they are fewer. Null, empty and blank texts have an empty set, link with nothing and are kept.
    Equal sets link; others if 100 * intersection >= 75 * union, on full sets. Very long texts are one row of one task.
    Repeated rows are each returned. A null id never represents a group that has an id; a group without ids has a null
    component_id and all its rows are kept. Extra columns are ignored; empty tables stay empty.
    """
    return _grouped(docs, text_col, id_col).drop("text_key")


def _grouped(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """near_duplicates(), with a digest of each row's text."""
    spark = docs.sparkSession
    for_python(spark)
    signed = written(_signed(docs, text_col, id_col), "signed")
    full = signed.filter(F.col("node").isNotNull())
    nodes = written(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("bands", ignorenulls=True).alias("bands")), "nodes")
    texts = full.filter(F.col("packed").isNotNull()).select("node", "packed")
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    stars = banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.min_by("n", "node").alias("cn"), F.count(F.lit(1)).alias("m"))
    stars = written(stars.filter(F.col("m") > 1).select(F.col("bucket").alias("b2"), "centre", "cn", "m"), "buckets")
    shared = written(banded.join(stars, F.col("bucket") == F.col("b2")).drop("b2"), "shared")
    pairs = written(shared.filter((F.col("node") != F.col("centre")) & _may(F.col("n"), F.col("cn"))).select("centre", "node").distinct(), "pairs")
    texts = _wanted(texts, shared)
    links = _confirmed(pairs, texts)
    roots = connected(links)
    more = _across(shared.filter("m > 2"), roots, texts)
    if not more.isEmpty():
        roots = _merged(roots, more)
    discard(stars, shared, pairs, texts, links, more)
    led = nodes.select("node", "doc_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    led = written(led, "led")
    heads = written(led.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members")).withColumnRenamed("root", "head"), "heads")
    groups = written(lookup(led, heads, {"root": "head"}, "members").select(F.col("node").alias("g"), "component_id", "copies"), "groups")
    discard(nodes, led, heads)
    out = signed.select("doc_id", "text_key", "n_shingles", "node")
    grouped = lookup(out.filter("node is not null"), groups, {"node": "g"}, "copies").select("doc_id", "text_key", "n_shingles", "component_id")
    out = grouped.unionByName(out.filter("node is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _wanted(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """The packed words of nodes that share a bucket, one row each (two tasks may both have met a node)."""
    near = texts.join(shared.select("node").distinct(), "node", "left_semi")
    return written(near.groupBy("node").agg(F.first("packed").alias("packed")), "texts")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one document of each group. All columns stay, whatever their names.

    Repeated rows (same id and text) are one document, of which one row stays: the one whose columns have the least hash,
    so reruns agree (rows alike in every column are the same row). A null id is an id like others, which null and empty
    texts (in a group each by themselves) share as one document each. Empty tables stay empty. Rows meet by id and text
    only if they repeat, and then as partial minima, so no task gathers the copies of a hot row.
    """
    own, key, many = unused(docs, "__kept_key", "__text_key", "__kept_rows")
    id_and_text = lambda i, digest: F.unhex(F.md5(F.concat(F.coalesce(i.cast("string"), F.lit("null")).cast("binary"), F.lit(":").cast("binary"), digest)))
    kept = _grouped(docs, text_col, id_col).filter("kept").groupBy(id_and_text(F.col("doc_id"), F.col("text_key")).alias(own)).agg(F.count(F.lit(1)).alias(many))
    kept = written(kept, "kept")
    rows = docs.withColumn(key, id_and_text(F.col(f"`{id_col}`").cast("long"), _text_key(text_col)))
    left = lookup(rows, kept, {key: own}, many)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if kept.filter(F.col(many) > 1).isEmpty():  # no row repeats
        return left.select(*columns)
    once = left.filter(F.col(many) == 1).select(*columns)
    again = left.filter(F.col(many) > 1).groupBy(key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(own))
    return once.unionByName(again.select(*(F.col(own)[c].alias(c) for c in docs.columns)))
