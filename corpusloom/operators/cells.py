"""Vector search in cells: k-means cells in a folder each, of which a query reads the nearest; exact or approximate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ship_package


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and unit (the vector at length 1) of the vectors that have a length: null ones, those of zeros and those with
    null or non-finite components are left out."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(vec_id).alias("id"), v.alias("v")).withColumn("n", length).filter((F.col("n") > 0) & (F.col("n") < float("inf")))
    return rows.select("id", F.transform("v", lambda x: x / F.col("n")).alias("unit"))


def write_cells(vectors: DataFrame, vec_id: str, embedding: str, path: str, cells: int, sample: int = 200_000, seed: int = 1) -> None:
    """Writes all vectors to path, a folder for each cell, and the cells (centre, radius, number) beside them.

    Centres are fitted on at most sample rows (the least hashes of their ids), cells are given to all rows, and radii are
    the greatest distances of all rows of a cell from its centre. All vectors have the same number of components. An empty
    table has no cells.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = _usable(vectors, vec_id, embedding)
    fitted = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample).select(array_to_vector("unit").alias("features"))
    centres = np.array([]) if fitted.isEmpty() else np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(fitted).clusterCenters())
    kind = vectors.schema[vec_id].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = np.array(batch.column(1).to_pylist())
            far = (units**2).sum(1)[:, None] - 2 * units @ centres.T + (centres**2).sum(1)[None, :]
            cell = far.argmin(1)
            distance = np.sqrt(((units - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(distance)], ["id", "unit", "cell", "distance"])

    dealt = rows.mapInArrow(assign, f"id {kind}, unit array<double>, cell int, distance double")
    dealt.write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(f"id {kind}, unit array<double>, cell int, distance double").parquet(f"{path}/vectors")
    radii = stored.groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    known.join(radii, "cell").coalesce(1).write.parquet(f"{path}/cells")


def nearest(spark: SparkSession, path: str, query: list[float], k: int, probes: int | None = None, first: int = 4) -> DataFrame:
    """id, similarity: the k vectors most similar to query by cosine, ties by id, from the cells of write_cells().

    With probes, only so many cells are read, the nearest ones: approximate, its recall is to be measured. Without, cells
    are read in order of distance, first a few, then twice as many each round, until none that is left can hold a better
    vector (by its centre's distance less its radius): exact. A query without length finds nothing.
    """
    cells = spark.read.parquet(f"{path}/cells").collect()  # as many as were asked for
    kind = spark.read.parquet(f"{path}/vectors").schema["id"].dataType.simpleString() if cells else "long"
    none = spark.createDataFrame([], f"id {kind}, similarity double")
    q = np.array(query, dtype=float)
    length = np.sqrt((q**2).sum())
    if not cells or not 0 < length < np.inf:
        return none
    q = q / length
    gaps = np.array([np.sqrt(((np.array(c["centre"]) - q) ** 2).sum()) for c in cells])
    closest = np.maximum(0.0, gaps - np.array([c["radius"] for c in cells]) - 1e-9)  # room for rounding
    order = np.argsort(gaps if probes is not None else closest, kind="stable")
    numbers = [cells[i]["cell"] for i in order]
    if probes is not None:
        return _best(_similar(spark, path, kind, numbers[:probes], q), k)
    rows: list = []
    at = 0
    while at < len(order):
        if len(rows) == k and 1 - closest[order[at]] ** 2 / 2 < rows[-1]["similarity"]:
            break
        upto = at + max(first, at)
        rows = sorted([*rows, *_best(_similar(spark, path, kind, numbers[at:upto], q), k).collect()], key=lambda r: (-r["similarity"], r["id"]))[:k]
        at = upto
    return spark.createDataFrame([tuple(r) for r in rows], f"id {kind}, similarity double") if rows else none


def _similar(spark: SparkSession, path: str, kind: str, cells: list[int], q: np.ndarray) -> DataFrame:
    rows = spark.read.schema(f"id {kind}, unit array<double>, cell int, distance double").parquet(f"{path}/vectors").filter(F.col("cell").isin(cells))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat.reshape(batch.num_rows, -1) @ q)], ["id", "similarity"])

    return rows.select("id", "unit").mapInArrow(product, f"id {kind}, similarity double")


def _best(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("similarity"), F.asc("id")).limit(k)
