"""Ordered blocks of speech: turns, labels carried forward, context, answers, and map-valued sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def turns(df: DataFrame, part: list[str], order: str, speaker: str) -> DataFrame:
    """Adds turn_id (from 1): it grows when the speaker changes."""
    w = W.partitionBy(*part).orderBy(order)
    new = F.coalesce(F.col(speaker) != F.lag(speaker).over(w), F.lit(True)).cast("int")
    return df.withColumn("_new", new).withColumn("turn_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def carried(df: DataFrame, part: list[str], order: str, label: Column, out: str) -> DataFrame:
    """Adds the last label that is not null, within part."""
    w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(label, ignorenulls=True).over(w))


def context(df: DataFrame, part: list[str], order: str, hit: Column, before: int = 1, after: int = 3) -> DataFrame:
    """Rows within before rows ahead of a hit and after rows behind one."""
    w = W.partitionBy(*part).orderBy(order)
    near = F.max(hit.cast("int")).over(w.rowsBetween(-after, before))
    return df.withColumn("_near", near).filter("_near = 1").drop("_near")


def answers(df: DataFrame, part: list[str], order: str, asks: Column, most: int = 3) -> DataFrame:
    """Adds question (the order of the question before a row, in the same part) and place; up to most rows each, until
    the next question."""
    w = W.partitionBy(*part).orderBy(order)
    out = df.withColumn("question", F.last(F.when(asks, F.col(order)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = out.filter(F.col("question").isNotNull() & ~asks)
    return out.withColumn("place", F.row_number().over(W.partitionBy(*part, "question").orderBy(order))).filter(F.col("place") <= most)


def field_weights(text: Column, fields: dict[str, dict[str, list[str]]], default: str) -> Column:
    """map(field -> share): strong patterns count 1 each, weak ones half up to 1; the best field takes all, unless
    others reach 0.8 of it, which share by score; without a score the default."""
    scores = []
    for name, words in fields.items():
        strong = sum((F.regexp_count(text, F.lit(w)) for w in words.get("strong", [])), F.lit(0))
        weak = sum((F.regexp_count(text, F.lit(w)) for w in words.get("weak", [])), F.lit(0))
        scores.append(F.struct(F.lit(name).alias("f"), (strong + F.least(F.lit(1.0), 0.5 * weak)).cast("double").alias("s")))
    all_scores = F.array(*scores)
    best = F.array_max(F.transform(all_scores, lambda x: x["s"]))
    top = F.filter(all_scores, lambda x: (x["s"] > 0) & (x["s"] >= 0.8 * best))
    total = F.aggregate(top, F.lit(0.0), lambda s, x: s + x["s"])
    shared = F.map_from_entries(F.transform(top, lambda x: F.struct(x["f"].alias("f"), (x["s"] / total).alias("w"))))
    return F.when(best > 0, shared).otherwise(F.create_map(F.lit(default), F.lit(1.0)))


def field_sums(df: DataFrame, keys: list[str], weights: str, chars: Column) -> DataFrame:
    """keys, fields (field -> weight), field_chars (field -> characters times weight)."""
    long = df.select(*keys, chars.alias("_c"), F.explode(weights).alias("field", "w"))
    per = long.groupBy(*keys, "field").agg(F.round(F.sum("w"), 6).alias("w"), F.round(F.sum(F.col("w") * F.col("_c")), 6).alias("c"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "w")))).alias("fields"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "c")))).alias("field_chars"))


def neighbours(df: DataFrame, doc: str, order: str, present: Column, chars: str, budget: int = 6_000, most: int = 4) -> DataFrame:
    """Rows to add to those present in a document: all that are left if their text fits the budget, else at most most
    rows next to a present one."""
    w = W.partitionBy(doc).orderBy(order)
    flag = present.cast("int")
    out = df.withColumns({"_p": flag, "_any": F.max(flag).over(W.partitionBy(doc)), "_left": F.sum(F.when(~present, F.col(chars))).over(W.partitionBy(doc)), "_next": F.greatest(F.coalesce(F.lag(flag).over(w), F.lit(0)), F.coalesce(F.lead(flag).over(w), F.lit(0)))})
    left = out.filter("_p = 0 and _any = 1").withColumn("_fits", F.col("_left") <= budget)
    left = left.filter(F.col("_fits") | (F.col("_next") == 1))
    return left.withColumn("_n", F.row_number().over(W.partitionBy(doc).orderBy(order))).filter(F.col("_fits") | (F.col("_n") <= most)).drop("_p", "_any", "_left", "_next", "_fits", "_n")


def agenda_labels(df: DataFrame, part: list[str], order: str, opened: Column, closed: Column) -> DataFrame:
    """Adds agenda: the one opened last, null again after it is closed."""
    event = F.when(opened.isNotNull(), F.struct(F.lit(True).alias("on"), opened.alias("a"))).when(closed, F.struct(F.lit(False).alias("on"), F.lit(None).cast("string").alias("a")))
    w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_e", F.last(event, ignorenulls=True).over(w)).withColumn("agenda", F.when(F.col("_e.on"), F.col("_e.a"))).drop("_e")


def capped(df: DataFrame, part: list[str], order: str, text: str, keywords: list[str], most: int, always: Column | None = None) -> DataFrame:
    """At most most rows of a part, the most relevant ones, in their own order: 100 for each keyword that the text has and
    1 for each 200 characters up to 5, nothing without a keyword; rows that are always wanted come on top of the cap."""
    own = F.lit(False) if always is None else F.coalesce(always, F.lit(False))
    found = sum((F.contains(F.col(text), F.lit(k)).cast("int") for k in keywords), F.lit(0))
    score = F.when(found > 0, found * 100 + F.least(F.floor(F.length(text) / 200), F.lit(5))).otherwise(0)
    rows = df.withColumns({"_own": own, "_score": score})
    room = F.greatest(F.lit(0), F.lit(most) - F.count_if("_own").over(W.partitionBy(*part)))
    place = F.row_number().over(W.partitionBy(*part, "_own").orderBy(F.desc("_score"), F.asc(order)))
    return rows.withColumns({"_room": room, "_place": place}).filter(F.col("_own") | (F.col("_place") <= F.col("_room"))).drop("_own", "_score", "_room", "_place").orderBy(*part, order)
