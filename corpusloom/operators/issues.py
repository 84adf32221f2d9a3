"""Issues: candidate clusters of news, the best match by state, exclusions, identity of regulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.clusters import star_clusters
from corpusloom.operators.pairs import cosine_pairs

#: Fixed value: titles of digests, which name many subjects at once.
DIGEST = r"위클리|주간\s*브리핑|\[통신 브리핑\]|소식_|뉴스\s*모음"


def candidate_clusters(news: DataFrame, news_id: str, at: str, level: str, title: str, tokens: str, clock: Column, days: int = 7, least: int = 3, digest: str = DIGEST) -> DataFrame:
    """news_id, seed_id: star clusters, newest first, of the last days' news of the upper two levels that are no digests."""
    fresh = F.col(at) >= clock - F.make_dt_interval(F.lit(days))
    rows = news.filter(fresh & F.col(level).isin("urgent", "normal") & ~F.coalesce(F.col(title), F.lit("")).rlike(digest))
    rows = rows.select(news_id, (-F.unix_micros(F.col(at).cast("timestamp"))).alias("_age"), tokens)
    return star_clusters(rows, [], "_age", news_id, tokens, least).select(news_id, "seed_id")


def best_by_state(clusters: DataFrame, cluster: str, vector: str, key: str, issues: DataFrame) -> DataFrame:
    """cluster, key_issue, key_state, active_issue, sim_active, sim_proposed, sim_rejected.

    The issue with the same key (the least id), the most similar active issue, and the greatest similarity to proposed and
    rejected ones, apart from one another: a rejected issue never hides an active one. Similarities of nothing are 0.
    issues: issue, state, key, vector. All clusters meet all issues, as products of matrices (see cosine_pairs).
    """
    states = clusters.select(cluster, F.col(vector).alias("_v"), F.explode(F.array(*map(F.lit, ("active", "proposed", "rejected")))).alias("state"))
    scored = cosine_pairs(states, cluster, "_v", issues, "issue", "vector", ["state"]).withColumnRenamed("similarity", "s").filter("s > 0")
    best = scored.groupBy(cluster).agg(
        F.max(F.when(F.col("state") == "active", F.struct("s", (-F.col("issue")).alias("i")))).alias("_a"),
        F.max(F.when(F.col("state") == "proposed", F.col("s"))).alias("_p"), F.max(F.when(F.col("state") == "rejected", F.col("s"))).alias("_r"))
    same = clusters.filter(F.col(key) != "").join(issues.select(F.col("issue").alias("_i"), F.col("state").alias("_s"), F.col("key").alias("_k")), F.col(key) == F.col("_k"))
    same = same.groupBy(F.col(cluster).alias("_c")).agg(F.min(F.struct("_i", "_s")).alias("_same"))
    out = clusters.select(cluster).join(best, cluster, "left").join(same, F.col(cluster) == F.col("_c"), "left")
    zero = F.lit(0.0)
    return out.select(
        cluster, F.col("_same._i").alias("key_issue"), F.col("_same._s").alias("key_state"), (-F.col("_a.i")).alias("active_issue"),
        F.coalesce("_a.s", zero).alias("sim_active"), F.coalesce("_p", zero).alias("sim_proposed"), F.coalesce("_r", zero).alias("sim_rejected"))


def undecided(members: DataFrame, links: DataFrame, excluded: DataFrame) -> DataFrame:
    """Members (issue, item) of a cluster that are neither linked to the issue nor taken out of it by people."""
    return members.join(links, ["issue", "item"], "left_anti").join(excluded, ["issue", "item"], "left_anti")


def regulation_keys(kind: Column, item: Column, origin: Column, bill: Column, law: Column, number: Column) -> Column:
    """What makes two items the same regulation: their own id, the bill that a comparison stands for, or the act by name
    and number, if it is no bill's."""
    own = F.concat_ws(":", kind, item.cast("string"))
    is_diff = kind == "diff"
    of_bill = is_diff & (F.coalesce(origin, F.lit("")) == "assembly") & (F.coalesce(bill, F.lit("")) != "")
    act = F.concat(F.lit("act:"), F.regexp_replace(F.coalesce(law, F.lit("")), r"\s+", ""), F.lit("|"), number)
    return F.array_compact(F.array(own, F.when(of_bill, F.concat(F.lit("bill:"), bill)).when(is_diff & (number != ""), act)))


def same_regulation(items: DataFrame, item: str, keys: str, issues: DataFrame) -> DataFrame:
    """item, state, issue: the issue that already has the item, active ones first, then proposed, then rejected, then the
    least id; items without one are left out. issues: issue, state, keys. The best issue of a key is found before the join,
    so an item meets one row a key, however many issues hold it."""
    place = F.when(F.col("state") == "active", 0).when(F.col("state") == "proposed", 1).when(F.col("state") == "rejected", 2)
    held = issues.filter(place.isNotNull()).select("issue", "state", place.alias("p"), F.explode("keys").alias("k"))
    held = held.groupBy("k").agg(F.min(F.struct("p", "issue", "state")).alias("h"))
    met = items.select(item, F.explode(F.array_distinct(keys)).alias("k")).join(held, "k")
    best = met.groupBy(item).agg(F.min("h").alias("b"))
    return best.select(item, F.col("b.state").alias("state"), F.col("b.issue").alias("issue"))
