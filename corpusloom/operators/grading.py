"""Grading sets: deterministic stratified samples, agreement and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stratified(df: DataFrame, stratum: str, item: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """Up to the quota of each stratum, in the order of a seeded digest of the item; a stratum that is short lends what
    it lacks to the rows left, in the same order. Adds place (within the stratum) and borrowed."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string")), 256)
    wanted = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(q)) for s, q in quotas.items()], F.lit(0))
    ranked = df.withColumn("_d", digest).withColumn("place", F.row_number().over(W.partitionBy(stratum).orderBy("_d")))
    ranked = ranked.filter(F.col("place") <= sum(quotas.values()))  # a bounded pool: the quotas' sum for each stratum
    own = F.col("place") <= wanted
    spare = F.lit(sum(quotas.values())) - F.count_if(own).over(W.partitionBy())
    extra = F.row_number().over(W.orderBy(own.desc(), F.col("_d")))
    out = ranked.withColumn("_own", own).withColumn("_spare", spare).withColumn("_n", extra - F.count_if(own).over(W.partitionBy()))
    return out.filter(F.col("_own") | (F.col("_n") <= F.col("_spare"))).withColumn("borrowed", ~F.col("_own")).drop("_d", "_own", "_spare", "_n")


def agreement(answers: DataFrame, item: str, answer: str, grader: str, main: str) -> DataFrame:
    """item, n_known, gray (two or more distinct answers), answer (the main grader's, else the only one)."""
    out = answers.filter(F.col(answer).isNotNull()).groupBy(item).agg(F.count_distinct(answer).alias("n_known"), F.max(F.when(F.col(grader) == main, F.col(answer))).alias("_main"), F.max(answer).alias("_one"))
    return out.select(item, "n_known", (F.col("n_known") > 1).alias("gray"), F.coalesce("_main", F.when(F.col("n_known") == 1, F.col("_one"))).alias("answer"))


def advice(matches, base, total, missing):
    """The recommendation that follows from a trial's matches against the base's."""
    return F.when(total < 6, "too_few").when(missing > 0, "missing").when(matches - base <= -2, "worse").when(matches >= base, "recommend").otherwise("neutral")
