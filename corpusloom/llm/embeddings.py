"""Embedding near-dedup by collision counting on sorted one-dimensional projections.

Vectors are turned by random rotations; each coordinate is a projection, sorted on its own. Round every query's value
lies a window; a pair collects a collision for each projection whose window holds the other, and pairs with enough
collisions are verified by cosine in double precision. The count that is enough is calibrated: differences at the
threshold reach it but for about six standard deviations.

A one-dimensional window holds a fixed share of all vectors, so a label with very many of them is first dealt into
lists: each list cuts the label into cells along a few more projections, the more the larger the label, so that few
vectors that have nothing to do with one another share a cell. The number of lists is calibrated: a pair at the
threshold shares no cell with probability MISS. Rows shuffled thus grow a little faster than the label (about n^1.2 for
spread vectors), not with its square. A pair counts in the first list in which it shares a cell, so no pair is emitted.

Work within a cell goes in tiles of two blocks of bounded size. A tile returns, for each vector, how many links it found,
and the edges of a spanning forest of them: a group of thousands of copies yields no list of its pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, for_python, lookup, written
from corpusloom.llm.components import connected

COSINE = 0.93
PROJECTIONS = 64
#: Distinct vectors in a block; a tile holds two blocks.
BLOCK = 1_024
#: The width of a list's cells in distances at the threshold; what a row of a list costs, in pairs.
CELL, ROW = 5.0, 1_000
#: A pair at the threshold shares no cell of any list with about this probability.
MISS = 1e-7
_QUERIES = 256
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@functools.lru_cache(maxsize=16)
def projections(dims: int, many: int = PROJECTIONS, seed: int = PROJECTIONS) -> np.ndarray:
    """dims x many: columns of random rotations, scaled so that a unit difference has unit variance in each."""
    rng = np.random.default_rng([dims, seed])
    turns = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-many // dims))]
    return np.hstack(turns)[:, :many] * dims**0.5


@functools.lru_cache(maxsize=16)
def calibrated(dims: int, cosine: float) -> tuple[float, int]:
    """The half width of a window (the distance of unit vectors at the threshold) and the count that is enough."""
    width = (2 - 2 * cosine) ** 0.5
    rng = np.random.default_rng(dims)
    turned = rng.normal(size=(20_000, dims))
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    counts = (np.abs(turned @ projections(dims)) <= 1).sum(axis=1)
    return width * (1 + 1e-9), max(0, int(np.floor(min(counts.mean() - 6 * counts.std(), counts.min() - 1))))


def collisions(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """How many projections hold each pair in a window: queries x others, from the sorted order of each projection."""
    n, k = len(queries), len(others)
    counts = np.zeros((n, k), dtype=np.uint8)
    ranks, hit = np.empty((n, k), dtype=np.uint16), np.empty((n, k), dtype=bool)
    place = np.empty(k, dtype=np.uint16)
    for j in range(queries.shape[1]):
        order = np.argsort(others[:, j], kind="stable")
        place[order] = np.arange(k, dtype=np.uint16)
        line = others[order, j]
        first = np.searchsorted(line, queries[:, j] - half, "left").astype(np.uint16)
        held = np.searchsorted(line, queries[:, j] + half, "right").astype(np.uint16) - first
        np.subtract(place[None, :], first[:, None], out=ranks)  # places before the window wrap round
        np.less(ranks, held[:, None], out=hit)
        counts += hit
    return counts


@functools.lru_cache(maxsize=4_096)
def cuts(n: int, dims: int, cosine: float) -> int:
    """How many projections cut a label of n vectors into cells: what costs least, in pairs to compare for each vector,
    if a vector's row in a list costs as much as ROW of them and the vectors are spread. A small label is not cut."""
    width = CELL * (1 - cosine) ** 0.5  # in standard deviations of the difference of unrelated unit vectors
    share = math.erf(width / 2**0.5) - (2 / math.pi) ** 0.5 / width * (1 - math.exp(-width * width / 2))
    best, least = 0, n / 2 + ROW
    k = 1
    while n * share ** (k - 1) > ROW:
        cost = lists(dims, cosine, k) * (n * share**k / 2 + ROW)
        if cost < least:
            best, least = k, cost
        k += 1
    return best


@functools.lru_cache(maxsize=64)
def lists(dims: int, cosine: float, k: int) -> int:
    """How many lists of k cuts are enough, from simulated differences at the threshold: the mean probability that a
    pair shares no cell falls to MISS."""
    if not k:
        return 1
    rng = np.random.default_rng([dims, k])
    turned = rng.normal(size=(2_000, dims))
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    lost, many = np.ones(len(turned)), 0
    while lost.mean() > MISS:
        cut = projections(dims, k, 1_000 + many)
        lost = lost * (1 - np.prod(np.clip(1 - np.abs(turned @ cut) / CELL, 0, 1), axis=1))
        many += 1
    return many


def cell_keys(x: np.ndarray, cosine: float, k: int, first: int, last: int) -> np.ndarray:
    """rows x lists: the cell of each unit vector in the lists first to last (exclusive), as a hash.

    Sums run over the components one by one, so a vector's cells do not depend on the rows beside it.
    """
    width = CELL * (2 - 2 * cosine) ** 0.5
    out = np.empty((len(x), last - first), dtype=np.uint64)
    for t in range(first, last):
        cut = projections(x.shape[1], k, 1_000 + t) if k else np.zeros((x.shape[1], 0))
        at = np.zeros((len(x), k))
        for d in range(x.shape[1]):
            at += x[:, d : d + 1] * cut[d]
        cell = np.floor(at / width + np.random.default_rng([k, t]).random(k)).astype(np.int64).view(np.uint64)
        key = np.full(len(x), (t + 1) * 0x9E3779B9, dtype=np.uint64)
        for j in range(k):
            key = key * _MIX[0] + cell[:, j]
            key = (key ^ (key >> np.uint64(30))) * _MIX[1]
            key = (key ^ (key >> np.uint64(27))) * _MIX[2]
            key ^= key >> np.uint64(31)
        out[:, t - first] = key
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a with rows of b, in double precision; a pair's value does not depend on the rows beside it."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def linked_pairs(a: np.ndarray, b: np.ndarray, cosine: float):
    """Index pairs (i in a, j in b) of rows with a cosine of at least cosine, block of queries by block of queries."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    turn = projections(a.shape[1])
    half, enough = calibrated(a.shape[1], cosine)
    pa_, pb_ = _unit(a) @ turn, _unit(b) @ turn
    for at in range(0, len(a), _QUERIES):
        i, j = np.nonzero(collisions(pa_[at : at + _QUERIES], pb_, half) >= enough)
        i += at
        for part in range(0, len(i), 65_536):
            p, q = i[part : part + 65_536], j[part : part + 65_536]
            good = cosines(a[p], b[q]) >= cosine
            yield p[good], q[good]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each index's component over the edges (i, j)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        np.minimum.at(low, before[i], least)  # the roots move, too
        np.minimum.at(low, before[j], least)
        low = low[low]
        if (low == before).all():
            return low


def _prepared(batches):
    """vec_id, node (a 64-bit hash of label and components; null if the vector links with nothing), label, dims, vector."""
    for batch in batches:
        nodes, vectors, dims = [], [], []
        for values, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x = None
            if values and label is not None and None not in values:
                x = np.array(values, dtype=np.float64) + 0.0  # no negative zero
                if not (np.isfinite(x).all() and x.any()):
                    x = None
            nodes.append(None if x is None else xxhash.xxh3_64_intdigest(f"{label}:".encode() + x.tobytes()) - (1 << 63))
            vectors.append(None if x is None else x.tobytes())
            dims.append(None if x is None else len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), batch.column(2), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], ["vec_id", "node", "label", "dims", "vector"])


def _places(cosine: float, cut: int | None):
    """A row for each list that a vector is in: node, label, dims, cuts, list, cell."""

    def run(batches):
        for batch in batches:
            node, label, dims, n = (batch.column(c) for c in (0, 1, 2, 4))
            kinds = np.column_stack([dims.to_numpy(), n.to_numpy()]) if batch.num_rows else np.zeros((0, 2), np.int64)
            for d, many in np.unique(kinds, axis=0).tolist():
                rows = np.flatnonzero((kinds == (d, many)).all(axis=1))
                k = cuts(many, d, cosine) if cut is None else cut
                total = lists(d, cosine, k)
                for at in range(0, len(rows), 512):
                    part = rows[at : at + 512]
                    x = np.frombuffer(b"".join(batch.column(3)[r].as_py() for r in part.tolist()), dtype=np.float64).reshape(len(part), -1)
                    keys = cell_keys(_unit(x), cosine, k, 0, total)
                    take = pa.array(np.repeat(part, total))
                    yield pa.RecordBatch.from_arrays(
                        [node.take(take), label.take(take), dims.take(take), pa.array(np.full(keys.size, k), pa.int32()), pa.array(np.tile(np.arange(total), len(part)), pa.int32()), pa.array(keys.ravel().view(np.int64))],
                        ["node", "label", "dims", "cuts", "list", "cell"],
                    )

    return run


def _tile(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        x = np.frombuffer(b"".join(table["vector"].to_pylist()), dtype=np.float64).reshape(len(node), -1)
        alone = table["i"][0].as_py() == table["j"][0].as_py()
        k, number = table["cuts"][0].as_py(), table["list"][0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        links, ends = np.zeros(len(node), dtype=np.int64), []
        earlier = None
        if len(left) and len(right):
            for i, j in linked_pairs(x[left], x[right], cosine):
                i, j = left[i], right[j]
                if alone:
                    i, j = i[i < j], j[i < j]
                if number and len(i) and earlier is None:
                    earlier = cell_keys(_unit(x), cosine, k, 0, number)
                for t in range(number if len(i) else 0):  # a pair counts where it meets first
                    new = earlier[i, t] != earlier[j, t]
                    i, j = i[new], j[new]
                links += np.bincount(i, weights=copies[j], minlength=len(node)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(node)).astype(np.int64)
                ends.append((i, j))
        low = forest(len(node), *(np.concatenate(e) for e in zip(*ends, strict=True))) if ends else np.arange(len(node))
        some, moved = np.flatnonzero(links), np.flatnonzero(low != np.arange(len(node)))
        return pa.table({
            "node": pa.array(np.concatenate([node[some], node[moved]]), pa.int64()),
            "links": pa.array([*links[some].tolist(), *(None for _ in moved)], pa.int64()),
            "other": pa.array([*(None for _ in some), *node[low[moved]].tolist()], pa.int64()),
        })

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK, cut: int | None = None) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable), kept; a row per vector.

    Only vectors with the same label and length are compared. Null labels, null or empty vectors, zero vectors and
    vectors with null or non-finite components link with nothing: 0 links, their own id, kept. Equal vectors of a label
    are one node with a count, so copies are never compared with one another. Repeated rows are each returned. A null
    id never represents a component that has an id. Extra columns are ignored; empty tables stay empty.

    cut says how many projections cut a label into cells (None: what costs least at its size; 0: the label is one cell);
    links do not depend on it. Distinct vectors that are all close to one another share their cells, and their pairs are
    compared, once for each list in which they meet, in tiles of two blocks that any number of tasks share.
    """
    for_python(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows = written(rows.mapInArrow(_prepared, "vec_id long, node long, label string, dims int, vector binary"), "vectors")
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id"))
    nodes = written(nodes, "vector-nodes")
    sizes = written(nodes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({"label": "l2", "dims": "d2"}), "vector-labels")
    sized = lookup(nodes.select("node", "label", "dims", "vector"), sizes, {"label": "l2", "dims": "d2"}, "n")
    places = sized.select("node", "label", "dims", "vector", "n").mapInArrow(_places(cosine, cut), "node long, label string, dims int, cuts int, list int, cell long")
    places = written(places, "vector-places")
    where = ["label", "dims", "cuts", "list", "cell"]
    cells = written(places.groupBy(where).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").withColumnsRenamed({c: f"{c}2" for c in where}), "vector-cells")
    placed = lookup(places, cells, {c: f"{c}2" for c in where}, "m").select("node", *where, F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = placed.select(*where, F.least("own", "peer").alias("i"), F.greatest("own", "peer").alias("j"), (F.col("own") > F.col("peer")).cast("int").alias("side"), "node")
    tiles = tiles.join(nodes.select("node", "copies", "vector"), "node")
    found = written(tiles.groupBy(*where, "i", "j").applyInArrow(_tile(cosine), "node long, links long, other long"), "vector-links")
    roots = connected(found.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.filter(F.col("links").isNotNull()).groupBy("node").agg(F.sum("links").alias("links"))
    led = nodes.select("node", "vec_id", "copies").join(counts, "node", "left").join(roots, "node", "left")
    led = written(led.select("node", "vec_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "vector-led")
    heads = written(led.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("members")).withColumnRenamed("root", "head"), "vector-heads")
    groups = lookup(led, heads, {"root": "head"}, "members").select(F.col("node").alias("g"), "copies", "n_links", "component_id")
    groups = written(groups, "vector-groups")
    discard(nodes, sizes, places, cells, found, led, heads)
    linked = lookup(rows.filter("node is not null").select("vec_id", "node"), groups, {"node": "g"}, "copies").select("vec_id", "n_links", "component_id")
    out = linked.unionByName(rows.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
