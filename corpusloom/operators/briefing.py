"""Briefings: what is carried over, clusters with their representatives, bill sections, merged blocks and terms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.terms import TermFold
from corpusloom.operators.clusters import star_clusters
from corpusloom.operators.shared import first_shared, words_in
from corpusloom.session import checkpointed, ship_package


def _age_hours(clock: Column, at: Column) -> Column:
    return (F.unix_micros(clock) - F.unix_micros(at.cast("timestamp"))) / 3.6e9


def carry_over(news: DataFrame, news_id: str, at: str, level: str, body: str, tokens: str, url: str, briefed: DataFrame, briefed_tokens: DataFrame, excluded: DataFrame, clock: Column, most: int = 40, covered: float = 0.34) -> DataFrame:
    """News of the top level, 24 to 72 hours old and with a body of over 50 characters, that no briefing has had: neither
    by id (briefed) nor by url (excluded), nor by their words (a third of the title's tokens in briefed_tokens). Newest
    first, at most most rows."""
    age = _age_hours(clock, F.col(at))
    rows = news.filter((age > 24) & (age <= 72) & (F.col(level) == "urgent") & (F.length(F.trim(F.col(body))) > 50))
    rows = rows.join(briefed.select(news_id), news_id, "left_anti").join(excluded.select(url), url, "left_anti")
    known = rows.select(news_id, F.explode(F.array_distinct(tokens)).alias("token")).join(briefed_tokens.select("token").distinct(), "token").groupBy(news_id).agg(F.count(F.lit(1)).alias("_met"))
    share = F.coalesce("_met", F.lit(0)) / F.size(F.array_distinct(tokens))
    left = rows.join(known, news_id, "left").filter((F.size(tokens) == 0) | (share < covered)).drop("_met")
    return left.orderBy(F.col(at).desc(), F.col(news_id).asc()).limit(most)


def briefing_clusters(items: DataFrame, item: str, at: str, tokens: str, has_body: str, earlier: DataFrame, earlier_tokens: str, least: int = 3) -> DataFrame:
    """rep, related, covered: star clusters, newest first; the representative is the seed, or the first member with a
    body if the seed has none; covered says whether it shares enough tokens with an earlier title."""
    rows = items.select(item, (-F.unix_micros(F.col(at).cast("timestamp"))).alias("_age"), F.col(tokens).alias("_tokens"), F.col(has_body).alias("_body"))
    stars = star_clusters(rows.select("_age", item, "_tokens"), [], "_age", item, "_tokens", least).select(F.col(item).alias("_i"), "seed_id")
    members = rows.join(stars, F.col(item) == F.col("_i"))
    order = F.struct(F.when(F.col("_body"), 0).otherwise(1), F.when(F.col(item) == F.col("seed_id"), 0).otherwise(1), F.col("_age"), F.col(item).alias("rep"))
    best = members.groupBy("seed_id").agg(F.min(order).alias("b"), F.bool_or("_body").alias("any_body"), F.count(F.lit(1)).alias("n"))
    reps = best.select(F.when(F.col("any_body"), F.col("b.rep")).otherwise(F.col("seed_id")).alias("rep"), (F.col("n") - 1).alias("related"))
    reps = checkpointed(reps.join(rows.select(F.col(item).alias("rep"), words_in("_tokens").alias("tokens")), "rep").withColumn("l", F.monotonically_increasing_id()))
    known = earlier.select(F.array_sort(words_in(earlier_tokens)).alias("tokens")).filter(F.size("tokens") >= least).distinct()
    seen = first_shared(reps.select("l", "tokens"), checkpointed(known.withColumn("r", F.monotonically_increasing_id())), least)
    return reps.join(seen, "l", "left").select("rep", "related", F.col("r").isNotNull().alias("covered"))


def bill_sections(bills: DataFrame, clock: Column, new_days: int = 7, remain_days: int = 9, skip: tuple[str, ...] = ("소관위 회부",)) -> DataFrame:
    """section (new, changed, deadline), bill_id, with_notice.

    bills: bill_id, bill_name, created_at, propose_day, updated_at, was, now, notice_end, briefed. New: stored in the last
    24 hours and proposed in the last new_days. Changed: updated in the last 24 hours, from one result to another that is
    none of skip. Deadline: a notice that runs for at least remain_days and was in no briefing; one whose bill is new, by id
    or name, is shown there instead.
    """
    day = F.to_date(clock)
    recent = lambda c: F.col(c) >= clock - F.expr("INTERVAL 24 HOURS")
    new = bills.filter(recent("created_at") & (F.col("propose_day") >= F.date_sub(day, new_days)))
    changed = bills.filter(recent("updated_at") & (F.col("was") != "") & ~F.col("was").eqNullSafe(F.col("now")) & ~F.trim(F.coalesce("now", F.lit(""))).isin(*skip))
    notices = bills.filter((F.col("notice_end") >= F.date_add(day, remain_days)) & ~F.coalesce("briefed", F.lit(False))).select("bill_id", "bill_name")
    ids, names = new.select("bill_id").distinct(), new.filter("bill_name != ''").select("bill_name").distinct()
    alone = notices.join(ids, "bill_id", "left_anti").join(names, "bill_name", "left_anti")
    noted = notices.select(F.col("bill_id").alias("_n")).distinct()
    named = notices.filter("bill_name != ''").select(F.col("bill_name").alias("_m")).distinct()
    new = new.join(noted, F.col("bill_id") == F.col("_n"), "left").join(named, F.col("bill_name") == F.col("_m"), "left")
    section = lambda df, name, noted=F.lit(False): df.select(F.lit(name).alias("section"), "bill_id", noted.alias("with_notice"))
    return section(new, "new", F.col("_n").isNotNull() | F.col("_m").isNotNull()).unionByName(section(changed, "changed")).unionByName(section(alone, "deadline"))


#: A block's head with its count, and how an item starts.
BLOCK_HEAD, ITEM_START = r"^(.*?)(\d+)(건.*)$", r"^\s*\d+\.\s"


def merged_blocks(queue: DataFrame, place: str, html: str) -> DataFrame:
    """place, text: queue rows in order; rows that are counted blocks with the same head become one block at the first
    one's place, its items renumbered, each text once. A row whose head does not say how many items follow stays as it is."""
    lines = F.split(F.replace(F.coalesce(F.col(html), F.lit("")), F.lit("\r"), F.lit("")), "\n")
    body = F.regexp_replace(F.array_join(lines, "\n"), r"^(\s*\n)+", "")
    rows = queue.select(place, F.col(html).alias("_html"), F.regexp_extract(body, r"^[^\n]*", 0).alias("_head"), F.regexp_extract(body, r"(?s)^[^\n]*\n?(.*)$", 1).alias("_rest"))
    items = F.filter(F.split("_rest", r"(?m)(?=^[ \t]*\d+\.\s)"), lambda x: x.rlike(r"\S"))
    rows = rows.withColumn("_items", F.transform(items, lambda x: F.regexp_replace(x, r"^\s*\n|\s+$", "")))
    count = F.regexp_extract("_head", BLOCK_HEAD, 2)
    counted = ~F.col("_head").rlike(ITEM_START) & (count != "") & (F.size("_items") > 0) & F.forall("_items", lambda x: x.rlike(ITEM_START)) & (count.try_cast("int") == F.size("_items"))
    rows = rows.withColumn("_key", F.when(counted, F.concat(F.regexp_extract("_head", BLOCK_HEAD, 1), F.lit("\x00"), F.regexp_extract("_head", BLOCK_HEAD, 3))))
    # A filter on _key would be pushed below the projections, and all that it is made of worked out again in it many times.
    long = rows.select(place, "_html", "_key", F.posexplode_outer(F.when(F.col("_key").isNotNull(), F.col("_items"))).alias("_n", "_item"))
    kept = long.filter("_n is null").select(place, F.col("_html").alias("text"))
    long = long.filter("_n is not null")
    own = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("_item", ITEM_START, ""), "<[^>]+>", ""), r"\s+", " "))
    own = F.when(own != "", own).otherwise(F.concat(F.lit("\x00"), F.col(place).cast("string"), F.lit(":"), F.col("_n").cast("string")))
    first = long.withColumn("_own", own).groupBy("_key", "_own").agg(F.min(F.struct(place, "_n", "_item")).alias("f"))
    blocks = first.groupBy("_key").agg(F.min(f"f.{place}").alias(place), F.array_sort(F.collect_list("f")).alias("fs"))
    numbered = F.transform("fs", lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), F.regexp_replace(f["_item"], ITEM_START, "")))
    head = F.concat(F.split_part("_key", F.lit("\x00"), F.lit(1)), F.size("fs").cast("string"), F.split_part("_key", F.lit("\x00"), F.lit(2)))
    return kept.unionByName(blocks.select(place, F.concat(head, F.lit("\n\n"), F.array_join(numbered, "\n\n")).alias("text")))


def distinct_terms(terms: DataFrame, part: list[str], order: str, term: str) -> DataFrame:
    """part, order, term: terms of a part (a day), in order, without variants. Terms whose keys (no white space, dots,
    dashes, underscores, brackets or case) are equal, or one inside the other, are variants; the longest of them stays, at
    the place of the first that it meets.

    The fold is sequential by definition: a part is in one task. Its rows are sorted and read as a stream; only the terms
    that stay are held (see TermFold)."""
    ship_package(terms.sparkSession)
    key = F.lower(F.regexp_replace(F.coalesce(F.col(term), F.lit("")), r"[\s·\-_()]", ""))
    rows = terms.select(*part, order, term, key.alias("_k")).filter("_k != ''")
    rows = rows.withColumn("_n", F.length(term))
    rows = (rows.repartition(*[F.col(c) for c in part]) if part else rows.repartition(1)).sortWithinPartitions(*part, order, term)
    names = [*part, order, term]
    schema = rows.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fold, kinds = None, TermFold(), None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in names]
            own = list(zip(*(batch.column(c).to_pylist() for c in part), strict=True)) if part else [()] * batch.num_rows
            for at, (k, n) in enumerate(zip(batch.column("_k").to_pylist(), batch.column("_n").to_pylist(), strict=True)):
                if own[at] != last:
                    yield from stayed(fold, kinds)
                    last, fold = own[at], TermFold()
                fold.add(k, n, lambda: tuple(batch.column(c)[at].as_py() for c in names))  # noqa: B023
        yield from stayed(fold, kinds)

    def stayed(fold: TermFold, kinds: list) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(fold.kept), 10_000):
            columns = zip(*(row for *_, row in fold.kept[at : at + 10_000]), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)
