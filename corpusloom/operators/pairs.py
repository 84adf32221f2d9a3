"""Pairs of vectors, block by block: products of matrices say which pairs matter, one formula decides them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship_package

#: Vectors of a side in a block, and by how much a product of matrices may be off.
BLOCK, SLACK = 2_048, 1e-9


def cosine_pairs(left: DataFrame, left_id: str, left_vector: str, right: DataFrame, right_id: str, right_vector: str, keys: list[str], least: float | None = None) -> DataFrame:
    """keys, left_id, right_id, similarity: pairs with equal keys (null: none) of a cosine of at least least; without
    least, of each left row and keys the most similar pairs of every block, those that are equal among them.

    The cosine is that of vectors.cosine(), bit for bit: in double precision, in order of the components. Vectors that are
    null, of no length or hold nulls, and vectors of different sizes, make no pair. Ids are integers. The rows of a key
    are dealt into blocks of about BLOCK, and each block of the one side meets each of the other in a task of its own, so
    memory is bounded by a block; the work is that of all pairs.
    """
    ship_package(left.sparkSession)
    on = [*(f"_k{i}" for i in range(len(keys))), "_size"]
    a, b = _sided(left, left_id, left_vector, keys), _sided(right, right_id, right_vector, keys)
    cuts = a.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_na")).join(b.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_nb")), on)
    cell = lambda n: F.pmod(F.xxhash64("_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = a.join(cuts, on).select(*on, "_id", "_v", cell("_na").alias("_a"), every("_nb").alias("_b"))
    b = b.join(cuts, on).select(*on, "_id", "_v", cell("_nb").alias("_b"), every("_na").alias("_a"))
    kind = dict(left.dtypes)
    by = [*on, "_a", "_b"]

    def run(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        (p, u, m), (q, v, n) = _matrix(x), _matrix(y)
        with np.errstate(all="ignore"):
            near, lengths = ((u / m[:, None]) @ (v / n[:, None]).T, np.outer(m, n)) if len(p) and len(q) else np.empty((2, len(p), len(q)))
        bound = np.full((len(p), 1), least - SLACK) if least is not None else np.fmax.reduce(near, axis=1, initial=-2.0)[:, None] - SLACK
        i, j = np.nonzero(~(near < bound) & (lengths != 0))  # what is no number is left to the formula
        with np.errstate(all="ignore"):
            similar = np.concatenate([_dots(u[i[k : k + 100_000]], v[j[k : k + 100_000]]) for k in range(0, len(i), 100_000)] or [np.empty(0)]) / (m[i] * n[j])
        columns = [pa.array([k.as_py()] * len(i), k.type) for k in key[: len(keys)]]
        return pa.Table.from_arrays([*columns, pa.array(p[i]), pa.array(q[j]), pa.array(similar)], [*keys, left_id, right_id, "similarity"])

    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), f"`{left_id}` long, `{right_id}` long, similarity double"])
    out = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(run, schema)
    return out if least is None else out.filter(F.col("similarity") >= least)


def _sided(rows: DataFrame, row_id: str, vector: str, keys: list[str]) -> DataFrame:
    whole: Column = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    own = rows.filter(whole).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.size(vector).alias("_size"), F.col(row_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    return own.dropna()


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, added in order of the components."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors and their lengths."""
    ids = rows.column("_id").to_numpy()
    vectors = rows.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.empty((0, 1))
    with np.errstate(all="ignore"):
        return ids, vectors, np.sqrt(_dots(vectors, vectors))
