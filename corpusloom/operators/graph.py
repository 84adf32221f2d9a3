"""Citation graphs: edges out of texts, their weights and precedence, topics by rare evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Precedence of edge kinds.
PRECEDENCE = {"delegation": 5, "three_tier": 4, "family": 3}


def citations(docs: DataFrame, doc_id: str, names: Column, samples: int = 3) -> DataFrame:
    """doc_id, target, weight (mentions), samples (the first few distinct contexts by order). names: array of
    struct(target, context)."""
    long = docs.select(doc_id, F.posexplode(names).alias("pos", "n")).select(doc_id, "pos", "n.target", "n.context")
    return long.groupBy(doc_id, "target").agg(F.count(F.lit(1)).alias("weight"), F.transform(F.slice(F.array_sort(F.collect_set(F.struct("context"))), 1, samples), lambda s: s["context"]).alias("samples"))


def precedence(edges: DataFrame, source: str, target: str, kind: str, weight: str, most: int = 60) -> DataFrame:
    """One edge for each pair: the kind of highest precedence; citations weigh their count up to most, other kinds their
    precedence."""
    order = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in PRECEDENCE.items()], F.lit(0))
    w = F.when(order > 0, order).otherwise(F.least(F.col(weight), F.lit(most)))
    place = F.row_number().over(W.partitionBy(source, target).orderBy(order.desc(), w.desc(), F.col(kind)))
    return edges.withColumn("edge_weight", w.cast("long")).withColumn("_p", place).filter("_p = 1").drop("_p")


def canonical(nodes: DataFrame, name: str, node_id: str, has_doc: str) -> DataFrame:
    """One node for each name without spaces and dots: those with a document first, then clean names, then the id."""
    key = F.lower(F.regexp_replace(name, r"[\s·ㆍ]+", ""))
    place = F.row_number().over(W.partitionBy("node_key").orderBy(F.col(has_doc).desc(), F.col(name).rlike(r"[<>\[\]]").asc(), F.col(node_id).asc()))
    return nodes.withColumn("node_key", key).withColumn("_p", place).filter("_p = 1").drop("_p")


def topic_scores(evidence: DataFrame, topic: str, term: str, hits: DataFrame, least_hits: int = 2, least: float = 2.0, margin: float = 2.0) -> DataFrame:
    """topic, hits, score, picked: evidence terms that a question has, each worth 1 over the topics that have it.

    The best topic is picked if it has enough hits and score, and margin times the runner-up's.
    """
    own = evidence.select(topic, term).distinct()
    df = own.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    met = own.join(hits.select(term).distinct(), term).join(df, term)
    scored = met.groupBy(topic).agg(F.count(F.lit(1)).alias("hits"), F.round(F.sum(1 / F.col("df")), 6).alias("score"))
    w = W.orderBy(F.desc("score"), F.asc(topic))  # one row for each topic with a hit
    out = scored.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    picked = (F.col("_r") == 1) & (F.col("hits") >= least_hits) & (F.col("score") >= least) & (F.col("score") >= margin * F.coalesce("_next", F.lit(0.0)))
    return out.select(topic, "hits", "score", picked.alias("picked"))


def edge_verdicts(edges: DataFrame, wanted: str, articles: DataFrame, doc: str, key: str) -> DataFrame:
    """Adds verdict of each edge (doc, wanted: array of article keys): no_article, doc_missing, art_missing, art_partial
    or ok."""
    have = articles.groupBy(F.col(doc).alias("_d")).agg(F.collect_set(key).alias("_have"))
    out = edges.join(have, F.col(doc) == F.col("_d"), "left")
    met = F.size(F.array_intersect(wanted, "_have"))
    verdict = F.when(F.size(wanted) == 0, "no_article").when(F.col("_d").isNull(), "doc_missing").when(met == 0, "art_missing").when(met < F.size(wanted), "art_partial").otherwise("ok")
    return out.withColumn("verdict", verdict).drop("_d", "_have")


def snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as one JSON document; an export, as large as the graph."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    return n.join(e).select(F.to_json(F.struct("nodes", "edges")).alias("graph"))  # one row each


def family_edges(names: DataFrame, name: str) -> DataFrame:
    """parent, child: a decree belongs to the act of its name, a rule to the decree of its name if there is one, else to
    the act. names has a row for each document."""
    own = names.select(F.trim(F.col(name)).alias("child")).distinct()
    act = F.trim(F.regexp_replace("child", r"\s*시행(령|규칙)$", ""))
    wants = F.when(F.col("child").endswith("시행령"), F.array(act)).when(F.col("child").endswith("시행규칙"), F.array(F.trim(F.regexp_replace("child", r"\s*시행규칙$", " 시행령")), act))
    asked = own.select("child", F.posexplode(wants).alias("place", "parent"))
    met = asked.join(own.select(F.col("child").alias("parent")), "parent")
    return met.groupBy("child").agg(F.min_by("parent", "place").alias("parent")).select("parent", "child")


def self_references(docs: DataFrame, name: str, text: str, act_word: str = r"(?<![가-힣])법 제\s*\d+조", decree_word: str = r"(?<![가-힣])영 제\s*\d+조") -> DataFrame:
    """source, target, n: how often a decree or rule speaks of the act, and a rule of the decree, of its own family."""
    child = F.trim(F.col(name))
    act = F.trim(F.regexp_replace(child, r"\s*시행(령|규칙)$", ""))
    decree = F.trim(F.regexp_replace(child, r"\s*시행규칙$", " 시행령"))
    refs = F.array(
        F.when(child.rlike("시행(령|규칙)$") & (act != ""), F.struct(act.alias("target"), F.regexp_count(F.col(text), F.lit(act_word)).alias("n"))),
        F.when(child.rlike("시행규칙$"), F.struct(decree.alias("target"), F.regexp_count(F.col(text), F.lit(decree_word)).alias("n"))))
    rows = docs.select(child.alias("source"), F.explode(F.array_compact(refs)).alias("r"))
    return rows.groupBy("source", F.col("r.target").alias("target")).agg(F.sum("r.n").alias("n")).filter("n > 0")
