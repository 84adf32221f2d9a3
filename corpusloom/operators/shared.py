"""Rows that share words, block by block: each block of the one side meets each of the other in a task, which counts over
the postings of the block and returns what is asked for, so that pairs are neither shuffled nor stored."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpointed, ship_package

#: Rows of a side in a block.
LEFT, RIGHT = 8_192, 32_768


def words_in(tokens: str | Column) -> Column:
    """The distinct tokens that are not null."""
    return F.array_distinct(F.filter(tokens, lambda x: x.isNotNull()))


def in_order(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds numbers from 0 in the given order (the last sort key should be unique), without gaps and without a task that
    sees all rows."""
    rows = checkpointed(rows.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()))
    part = F.shiftright("_i", 33)
    counts = dict(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a number for each partition
    before = np.cumsum([0, *(counts.get(p, 0) for p in range(max(counts, default=0)))])
    starts = F.array(*[F.lit(int(n)).cast("long") for n in before])
    return rows.withColumn(name, F.get(starts, part.cast("int")) + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).drop("_i")


class Postings:
    """How many words the rows of a block share with a set of words. Words of many rows are kept as columns."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, n_codes: int):
        self.n = len(sizes)
        order = np.argsort(codes, kind="stable")
        self.rows = np.repeat(np.arange(self.n), sizes)[order]
        self.df = np.bincount(codes, minlength=n_codes)
        self.ends = np.cumsum(self.df)
        self.kind = np.uint8 if not len(sizes) or sizes.max() < 256 else np.int32
        self.columns = {}
        for c in np.flatnonzero(self.df * 32 > self.n):
            self.columns[int(c)] = np.zeros(self.n, self.kind)
            self.columns[int(c)][self.rows[self.ends[c] - self.df[c] : self.ends[c]]] = 1

    def shared(self, own: np.ndarray, least: int) -> np.ndarray:
        """The rows, in order, that share at least least words with a set."""
        own = own[self.df[own] > 0]
        if len(own) < least:
            return own[:0]
        seen = np.zeros(self.n, self.kind)
        for c in own.tolist():
            column = self.columns.get(c)
            if column is None:
                seen[self.rows[self.ends[c] - self.df[c] : self.ends[c]]] += 1
            else:
                seen += column
        return np.flatnonzero(seen >= least)


def _coded(*columns: pa.ChunkedArray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Codes and sizes of the rows of each column of words, and how many codes there are."""
    arrays = [c.combine_chunks() for c in columns]
    flat = [a.flatten().cast(pa.large_string()) for a in arrays]
    words = pa.concat_arrays(flat).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum([0, *map(len, flat)])
    sizes = [a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in arrays]
    return [(codes[cuts[k] : cuts[k + 1]], sizes[k]) for k in range(len(arrays))], len(words.dictionary)


def _sets(coded: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    codes, sizes = coded
    return np.split(codes, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _met(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What run returns for each block of left (checkpointed, with ids l) and each block of right (with ids r)."""
    ship_package(left.sparkSession)
    n = left.count()
    nb = max(1, -(-right.count() // RIGHT))
    na = max(-(-n // LEFT), min(-(-16 // nb), -(-n // 512)), 1)  # a small side is dealt to a few tasks, too
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select("*", cell("l", na).alias("_a")).select("*", every(nb).alias("_b"))
    b = right.select("*", cell("r", nb).alias("_b")).select("*", every(na).alias("_a"))
    tasks = min(2 * na * nb, 1_000)
    sides = [rows.repartition(tasks, "_a", "_b").groupBy("_a", "_b") for rows in (a, b)]
    return sides[0].cogroup(sides[1]).applyInArrow(lambda x, y: run(x, y), schema)


def first_shared(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """l, r: for each row of left (l, tokens, and marks if asked for) the least r of those of right (r, tokens, marks) that
    share at least least words with it and have all its marks (bits of a number)."""
    marked = "marks" in left.columns

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("r")
        (own, other), n = _coded(x.column("tokens"), y.column("tokens"))
        block, ids, found = Postings(*other, n), y.column("r").to_numpy(), []
        marks = (x.column("marks").to_numpy(), ~y.column("marks").to_numpy()) if marked else None
        for k, words in enumerate(_sets(own)):
            hits = block.shared(words, least)
            if marked and len(hits) and marks[0][k]:
                hits = hits[(marks[0][k] & marks[1][hits]) == 0]
            if len(hits):
                found.append((k, ids[hits[0]]))
        at, r = (np.array(c, dtype=np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        return pa.table({"l": x.column("l").take(pa.array(at)), "r": pa.array(r)})

    return _met(left, right, run, "l long, r long").groupBy("l").agg(F.min("r").alias("r"))


def shared_pairs(rows: DataFrame, least: int) -> DataFrame:
    """a, b: pairs of rows (l, tokens) that share at least least words, a below b."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        (own, other), n = _coded(x.column("tokens"), y.column("tokens"))
        block, p, q = Postings(*other, n), x.column("l").to_numpy(), y.column("r").to_numpy()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, words in enumerate(_sets(own)):
            hits = q[block.shared(words, least)]
            hits = hits[hits > p[k]]
            a.append(np.full(len(hits), p[k]))
            b.append(hits)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return _met(rows.select("l", "tokens"), rows.select(F.col("l").alias("r"), "tokens"), run, "a long, b long")


def shared_counts(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """l, n, kept: how many of the rows that right stands for (r, tokens; n rows, kept of them kept) share at least least
    words with the one or the other set of a row of left (l, tokens, more)."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        (own, more, other), n = _coded(x.column("tokens"), x.column("more"), y.column("tokens"))
        block, sums = Postings(*other, n), []
        weights = [y.column(c).to_numpy() for c in ("n", "kept")]
        for words, second in zip(_sets(own), _sets(more), strict=True):
            hits = np.union1d(block.shared(words, least), block.shared(second, least))
            sums.append([int(w[hits].sum()) for w in weights])
        return pa.table({"l": x.column("l"), "n": pa.array([s[0] for s in sums], pa.int64()), "kept": pa.array([s[1] for s in sums], pa.int64())})

    return _met(left, right, run, "l long, n long, kept long").groupBy("l").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
