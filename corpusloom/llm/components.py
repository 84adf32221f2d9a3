"""Connected components by randomised contraction: every round each node moves to the least of its neighbourhood, in an
order that a hash makes random, and edges are rewritten between the nodes that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """Of edges (a, b) between longs: node, root, one row for each node that has an edge; nodes are linked if roots agree.

    A random order shrinks chains by a constant share a round, so rounds grow with the logarithm of the longest chain; a
    star takes one. Minima are partial aggregates, and labels are joined to edges by key, where adaptive execution can
    split a hot node. Every round's tables are written, so a lost executor costs a re-read.
    """
    edges = written(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    moves = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v")))
        move = both.groupBy("a").agg(least.alias("low")).select(F.col("a").alias("node"), F.least(F.col("low"), F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")))["v"].alias("to"))
        move = written(move, "moves")
        moves.append(move)
        step = edges.join(move.withColumnsRenamed({"node": "a", "to": "a2"}), "a").join(move.withColumnsRenamed({"node": "b", "to": "b2"}), "b")
        edges = written(step.filter(F.col("a2") != F.col("b2")).select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].withColumnRenamed("to", "root")
    for move in moves[1:]:
        out = out.join(move.withColumnsRenamed({"node": "root", "to": "next"}), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(out, "components") if len(moves) > 1 else out
