"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import written

#: Rows that one window partition sorts, about; the number of partitions follows the row count.
ROWS_PER_BUCKET = 8_192


def _unit(h: Column) -> Column:
    """A hash as a fraction in [0, 1)."""
    return F.shiftrightunsigned(h, 11) * F.lit(2.0**-53)


def interleave(rows: DataFrame, strata: str, keys: list[str], shards: int, seed: int = 42) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard): row counts at most one apart, each shard the mixture.

    Within each stratum rows are shuffled by a seeded hash of keys and ranked; all rows are then ordered by fractional
    rank (rank + 1/2) / stratum size and cut into equal runs. No task sorts a whole stratum: a row's rank is its rank in
    a hash bucket of about ROWS_PER_BUCKET rows plus the count of the buckets before it, and likewise for the global
    order. rows should be narrow: it is read several times and shuffled twice.

    A null stratum is a stratum. Rows alike in all columns are counted first and numbered, and the number goes into the
    hash, so that they spread like any others. Rows alike in all keys alone are interchangeable; ties of the hash are
    broken by keys. Reruns agree. Empty tables stay empty. An existing shard or slot column is replaced.

    The counts before are running sums over one row for each ROWS_PER_BUCKET rows.
    """
    given = [c for c in rows.columns if c not in ("shard", "slot")]
    alike = rows.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(given)]).groupBy(*[f"in_{i}" for i in range(len(given))]).agg(F.count(F.lit(1)).alias("m"))
    alike = alike.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / ROWS_PER_BUCKET))))
    alike = alike.withColumn("copy", F.explode(F.sequence(F.col("run") * ROWS_PER_BUCKET + 1, F.least("m", (F.col("run") + 1) * ROWS_PER_BUCKET)))).drop("m", "run")
    work = written(alike, "interleave-rows")
    at = {c: F.col(f"in_{i}") for i, c in enumerate(given)}
    work = work.withColumns({"s": at[strata], "h": F.xxhash64(F.lit(seed), *[at[k] for k in keys], F.col("copy"))})
    tie = [F.col(f"in_{given.index(k)}").asc_nulls_last() for k in keys]
    per = work.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    total = work.count()
    buckets = F.ceil(F.col("n") / ROWS_PER_BUCKET)
    work = work.join(per.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    work = work.withColumn("b", F.floor(_unit(F.col("h")) * buckets))
    # counts of the buckets before, in each stratum
    sizes = work.groupBy("s", "b").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select(F.col("s").alias("s2"), F.col("b").alias("b2"), (F.sum("m").over(W.partitionBy("s").orderBy("b")) - F.col("m")).alias("before"))
    ranked = work.withColumn("r", F.row_number().over(W.partitionBy("s", "b").orderBy("h", *tie)))
    ranked = ranked.join(before, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2"))).drop("s2", "b2")
    ranked = ranked.withColumn("f", (F.col("before") + F.col("r") - 0.5) / F.col("n"))
    whole = max(1, -(-total // ROWS_PER_BUCKET))
    ranked = written(ranked.select(*[f"in_{i}" for i in range(len(given))], "s", "h", "f", F.floor(F.col("f") * whole).alias("g")), "interleave")
    ahead = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    ahead = ahead.select(F.col("g").alias("g2"), (F.sum("m").over(W.orderBy("g")) - F.col("m")).alias("ahead"))
    at = ranked.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("f", F.col("s").asc_nulls_last(), "h", *tie)))
    at = at.join(ahead, F.col("g") == F.col("g2")).withColumn("p", F.col("ahead") + F.col("r") - 1)
    n, k = F.lit(max(1, total)).cast("long"), F.lit(shards).cast("long")
    shard = F.expr("p * k div n")
    at = at.withColumns({"k": k, "n": n}).withColumn("shard", shard)
    return at.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(given)], F.col("shard").cast("int"), F.expr("p - (shard * n + k - 1) div k").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 42) -> DataFrame:
    """One row per document: id, source, size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null: of no bytes), shard, slot.

    Only these narrow columns move; texts are read once, where they lie, very long ones whole. Null ids and sources, equal texts and repeated
    rows are placed like any others; extra columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleave(narrow, "source", ["doc_id", "text_crc32", "size"], shards, seed)
