"""Same-event clustering and the suppression of repeats."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.shared import first_shared, in_order, shared_counts, shared_pairs, words_in
from corpusloom.operators.tables import first_per
from corpusloom.session import checkpointed, ship_package

#: Sets of tokens whose pairs are made at a time: at first, and at most, while their pairs are few.
HEAD, MOST = 4_096, 32_768


def star_clusters(items: DataFrame, part: list[str], order: str, item_id: str, tokens: str, least: int = 3) -> DataFrame:
    """part, item_id, seed_id: in order, an item joins the first seed it shares at least least tokens with, or is a seed.

    Items are compared with seeds only, so membership is not transitive. Items of one part (a day, a topic; none: all)
    are put in order of order (nulls last), then of item_id, which is unique in its part; rows that repeat an item share
    its seed. Items of fewer than least tokens are seeds. least is at least 1.

    The walk is sequential by definition, but its result is not: an item is a seed exactly if no earlier neighbour (an
    item that it shares enough tokens with) is one. Items of equal tokens join the seed that the first of them joins, so
    sets of tokens are what is clustered. The first some thousands of the sets that are open are decided by their pairs, in
    rounds: one without an undecided earlier neighbour is a seed, and its later neighbours are not. Then all other open
    sets meet the new seeds, as block against block, and those that share enough tokens join the first one. So pairs are
    made of a bounded number of sets at a time, however many items share their words, and all others are compared with
    seeds only. No part is gathered in a task.
    """
    at = F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("at"), F.col(item_id).alias("id"), *(F.col(c).alias(f"p{k}") for k, c in enumerate(part)))
    marked = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit("="), c.cast("string")), F.lit("-"))
    word = F.concat(*(marked(F.col(c)) for c in part), marked(F.col("_word")))  # a word of its part
    words = items.select(at.alias("_n"), *part, F.explode(F.array_distinct(tokens)).alias("_word")).groupBy("_n").agg(F.array_sort(F.collect_set(word)).alias("tokens"))
    words = checkpointed(words.filter(F.size("tokens") >= least))
    sets = in_order(words.groupBy("tokens").agg(F.min("_n").alias("_first")), "l", F.col("_first"))
    firsts = checkpointed(sets.select("l", F.col("_first.id").alias("_seed")))
    open_, joined, size = checkpointed(sets.select("l", "tokens")), [], HEAD
    while True:
        counts = sorted(open_.groupBy(F.expr(f"l div {HEAD}")).agg(F.count(F.lit(1))).collect())  # a number for each HEAD sets
        if not counts:
            break
        held = 0
        for k, n in counts:
            if held and held + n > size:
                break
            held, cut = held + n, (k + 1) * HEAD
        head, rest = open_.filter(F.col("l") < cut), open_.filter(F.col("l") >= cut)
        pairs = checkpointed(shared_pairs(head, least))
        gone = _no_seeds(pairs)
        seeds = checkpointed(head.join(gone, F.col("l") == F.col("b"), "left_anti")) if gone is not None else head
        if gone is not None:
            own = pairs.join(seeds.select(F.col("l").alias("a")), "a", "left_semi").groupBy("b").agg(F.min("a").alias("r"))
            joined.append(checkpointed(own.select(F.col("b").alias("l"), "r")))
        if held == sum(n for _, n in counts):
            break
        met = checkpointed(first_shared(rest, seeds.select(F.col("l").alias("r"), "tokens"), least))
        joined.append(met)
        open_ = checkpointed(rest.join(met, "l", "left_anti"))
        near = pairs.count() / held
        size = min(2 * size, MOST) if near < 16 else max(size // 2, HEAD) if near > 64 else size
    rows = items.select(*part, item_id, at.alias("_n"))
    if joined:
        of = reduce(DataFrame.unionByName, joined)
        heads = firsts.join(of, "l", "left").select("l", F.coalesce("r", "l").alias("r"))
        firsts = heads.join(firsts.withColumnRenamed("l", "r"), "r").select("l", "_seed")
    known = words.join(sets.select("l", "tokens"), "tokens").join(firsts, "l").select(F.col("_n").alias("_m"), "_seed")
    return rows.join(known, F.col("_n") == F.col("_m"), "left").select(*part, item_id, F.coalesce("_seed", item_id).alias("seed_id"))


def _no_seeds(pairs: DataFrame) -> DataFrame | None:
    """b: items with an earlier neighbour that is a seed, of pairs (a, b) of neighbours, a the earlier one; None: there
    are no pairs. A round settles the first item of every chain of neighbours at least."""
    open_, joined = pairs, []
    while not open_.isEmpty():
        first = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = checkpointed(open_.join(first, "a", "left_semi").select("b").distinct())
        joined.append(gone)
        left = open_.join(gone, "b", "left_anti")
        open_ = checkpointed(left.join(gone.select(F.col("b").alias("a")), "a", "left_anti"))
    return reduce(DataFrame.unionByName, joined) if joined else None


def label_pairs(label: str | None) -> Counter:
    """The character pairs of a label, with multiplicity; case, white space and punctuation do not count."""
    bare = "".join(c for c in (label or "").lower() if c.isalnum())
    return Counter(bare[i : i + 2] for i in range(len(bare) - 1))


def overlap_coefficient(a: Counter, b: Counter) -> float:
    """Shared pairs, with multiplicity, over those of the shorter label; 0 if either has none."""
    return (a & b).total() / min(a.total(), b.total()) if a and b else 0.0


def event_groups(items: DataFrame, part: list[str], order: str, item_id: str, event: str, title_tokens: str, tags: str, published: str | None = None) -> DataFrame:
    """part, item_id, head_id: rows of one event; the head is the one published first (by order, if not told otherwise).

    Two rows are one event if their labels overlap by at least 0.45, or, where either has no label, their titles share at
    least two tokens and 15% of the longer; and if both have tags, these overlap. In order, a row joins the first group
    whose opener it is one event with, or opens one.
    """
    ship_package(items.sparkSession)
    kind = dict(items.dtypes)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in [*part, item_id]) + f", head_id {kind[item_id]}"
    given = [event, title_tokens, tags]

    def same(a: tuple, b: tuple) -> bool:
        if a[3] and b[3] and not (a[3] & b[3]):
            return False
        if a[0] and b[0]:
            return overlap_coefficient(a[1], b[1]) >= 0.45
        shared = sum(w in b[2] for w in a[2])
        return shared >= 2 and shared / max(len(a[2]), len(b[2])) >= 0.15

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(dict.fromkeys([order, item_id])), kind="stable")
        openers: list[tuple] = []
        group = []
        for label, words, own in zip(*(pdf[c] for c in given), strict=True):
            row = ((label or "").strip(), label_pairs(label), list(words) if words is not None else [], set(own) if own is not None else set())
            at = next((k for k, opener in enumerate(openers) if same(opener, row)), len(openers))
            if at == len(openers):
                openers.append(row)
            group.append(at)
        out = pdf[[*part, item_id]].assign(_group=group, _at=pdf[published or order])
        first = out.sort_values("_at", kind="stable", na_position="last").groupby("_group")[item_id].first()
        return out[[*part, item_id]].assign(head_id=out["_group"].map(first))

    return items.select(*dict.fromkeys([*part, order, published or order, item_id, *given])).groupBy(*part).applyInPandas(run, schema)


def follow_up(shared: Column, new_title: Column, old_title: Column, signals: list[str], least: int = 3) -> Column:
    """Enough shared tokens, and no signal word that only the new title has."""
    fresh = F.lit(False)
    for word in signals:
        fresh = fresh | (F.contains(new_title, F.lit(word)) & ~F.contains(old_title, F.lit(word)))
    return (shared >= least) & ~fresh


def representatives(links: DataFrame, child: str, parent: str, flag: str | None = None) -> DataFrame:
    """child, rep, judged: follows each chain of suppressions to its end. A walk that runs into a cycle stops at the first
    node that it meets again: a member of the cycle is its own representative, a row before it has the member it enters.

    judged says whether the walk passes a link whose flag is true. Pointer doubling: a round halves what is left of
    every chain; rounds go on until no pointer moves, and no walk is longer than the links.
    """
    own = F.col(flag) if flag else F.lit(False)
    at = checkpointed(links.select(F.col(child).alias("c"), F.col(parent).alias("p"), F.coalesce(own, F.lit(False)).alias("j")))
    end, rounds = _doubled(at, at.count())
    stuck = end.join(at.select(F.col("c").alias("c2")), F.col("p") == F.col("c2"), "left_semi")
    if stuck.isEmpty():
        return end.select(F.col("c").alias(child), F.col("p").alias("rep"), F.col("j").alias("judged"))
    # After 2**rounds steps, every pointer that still has a way to go is on a cycle, and the members point at all of it.
    members = checkpointed(stuck.select(F.col("p").alias("m")).distinct())
    outside = at.join(members, F.col("c") == F.col("m"), "left_anti")
    tails, _ = _doubled(checkpointed(outside), 1 << rounds)
    inside = end.join(members, F.col("c") == F.col("m"), "left_semi").select("c", F.col("c").alias("p"), "j")
    entry = inside.select(F.col("c").alias("c2"), F.col("j").alias("j2"))  # the whole cycle is walked from its entry
    tails = tails.join(entry, F.col("p") == F.col("c2"), "left").select("c", "p", (F.col("j") | F.coalesce("j2", F.lit(False))).alias("j"))
    return tails.unionByName(inside).select(F.col("c").alias(child), F.col("p").alias("rep"), F.col("j").alias("judged"))


def _doubled(at: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """Pointers after as many rounds of doubling as a walk of longest links needs, or until none moves."""
    rounds = 0
    while (1 << rounds) <= longest:
        nxt = at.select(F.col("c").alias("c2"), F.col("p").alias("p2"), F.col("j").alias("j2"))
        step = at.join(nxt, F.col("p") == F.col("c2"), "left")
        at = checkpointed(step.select("c", F.coalesce("p2", "p").alias("p"), (F.col("j") | F.coalesce("j2", F.lit(False))).alias("j"), F.col("c2").isNotNull().alias("moved")))
        rounds += 1
        if at.filter("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("c", "p", "j"), rounds


def suppression(candidates: DataFrame, age_hours: str, keyword_hit: str, judged_same: str, share: str) -> DataFrame:
    """Adds action: what becomes of an alert that may repeat an earlier one (its representative is age_hours old).

    A keyword hit on a representative younger than 18 hours suppresses. Else a verdict that both are the same suppresses
    below 24 hours; from 24 hours on, or at an unknown age, it is a reminder if the share is at least 0.5 or unknown, else
    held. No verdict or no representative lets it pass.
    """
    age, same = F.col(age_hours), F.coalesce(F.col(judged_same), F.lit(False))
    action = (
        F.when(F.coalesce(F.col(keyword_hit), F.lit(False)) & (age < 18), "suppress")
        .when(same & (age < 24), "suppress")
        .when(same & (F.coalesce(F.col(share), F.lit(1.0)) >= 0.5), "remind")
        .when(same, "hold")
        .otherwise("pass")
    )
    return candidates.withColumn("action", action)


def repeat_alerts(items: DataFrame, history: DataFrame, suppressed: DataFrame, window: DataFrame, verdicts: DataFrame, clock: Column, signals: list[str], least: int = 3) -> DataFrame:
    """item, action (suppress, remind, hold, merge, pass), matched, rep: the whole path of new alerts against old ones.

    items: item, at, title, tokens (candidates, in order of at and item); history: title, at, tokens (what was reported in
    the last three days; of equal titles the newest counts); suppressed: child, parent, judged (titles of earlier
    suppressions, each with what it was suppressed for; judged: by a verdict); window: title, tokens, kept (all items of
    three days, and whether they have the level of the channel); verdicts: item, matched (what a judge held to be the same).

    1. An item meets the newest report that shares at least least tokens with it, if the item brings no signal word that
       the report lacks. Reports whose own chain passes a verdict are no match.
    2. The age is that of the end of the report's chain. Below 18 hours the item is suppressed.
    3. A verdict on what is left (also on items without a match) counts against reports that went out themselves: below
       24 hours it suppresses, else it is a reminder or is held, by the share of kept items among those that share enough
       tokens with the item or the report.
    4. What passes or reminds is clustered: in order, an item joins the first one before it that it shares enough tokens
       with (stars, not chains), and is merged into it.

    Alerts meet reports and the window block by block (see shared.py): a block returns the newest report of an alert, or
    counts, and no pairs.
    """
    chains = representatives(suppressed, "child", "parent", "judged").select(F.col("child").alias("_c"), F.col("rep").alias("_rep"), F.col("judged").alias("_judged"))
    reports = first_per(history, ["title"], F.desc("at"), F.asc("title")).select(F.col("title").alias("m_title"), F.col("at").alias("m_at"), F.col("tokens").alias("m_tokens"))
    reports = reports.join(chains, F.col("m_title") == F.col("_c"), "left").drop("_c")
    ages = reports.select(F.col("m_title").alias("_t"), F.col("m_at").alias("rep_at"))
    reports = reports.withColumn("m_rep", F.coalesce("_rep", "m_title")).join(ages, F.col("m_rep") == F.col("_t"), "left").drop("_t")
    reports = reports.select("m_title", "m_at", "m_tokens", "m_rep", "rep_at", F.coalesce("_judged", F.lit(False)).alias("m_judged"), F.col("_rep").isNotNull().alias("m_down"))
    reports = checkpointed(in_order(reports, "r", F.desc("m_at"), F.asc("m_title")))
    fresh, old = _marks(F.col("title"), signals, (1 << len(signals)) - 1), _marks(F.col("m_title"), signals, 0)
    rows = checkpointed(items.withColumn("l", F.monotonically_increasing_id()))
    near = first_shared(rows.select("l", words_in("tokens").alias("tokens"), fresh.alias("marks")), reports.filter(~F.col("m_judged")).select("r", words_in("m_tokens").alias("tokens"), old.alias("marks")), least)
    match = near.join(reports, "r").select(F.col("l").alias("_l"), F.col("m_title").alias("kw_title"), F.col("m_rep").alias("kw_rep"), F.col("rep_at").alias("kw_at"))
    told = verdicts.select(F.col("item").alias("v_item"), F.col("matched").alias("v_title"))
    told = told.join(reports.filter(~F.col("m_down")).select(F.col("m_title").alias("v_title"), F.col("rep_at").alias("v_at"), F.col("m_tokens").alias("v_tokens")), "v_title")
    hours = lambda at: (F.unix_micros(clock) - F.unix_micros(at)) / 3.6e9
    rows = rows.join(match, F.col("l") == F.col("_l"), "left").join(told, F.col("item") == F.col("v_item"), "left")
    kw = F.coalesce(hours(F.col("kw_at")) < 18, F.lit(False))
    rows = checkpointed(rows.select("item", "at", "title", "tokens", kw.alias("kw"), "kw_title", "kw_rep", "v_title", "v_tokens", F.when(kw, hours(F.col("kw_at"))).otherwise(hours(F.col("v_at"))).alias("age")))
    asked = rows.filter(~F.col("kw") & F.col("v_title").isNotNull())
    rows = rows.join(_kept_share(asked, window, least), "item", "left")
    rows = suppression(rows.withColumn("same", F.col("v_title").isNotNull()), "age", "kw", "same", "share")
    rows = checkpointed(rows.withColumn("matched", F.when(F.col("kw"), F.col("kw_title")).when(F.col("action") != "pass", F.col("v_title"))))
    out = rows.filter(F.col("action").isin("pass", "remind"))
    stars = star_clusters(out, [], "at", "item", "tokens", least).select(F.col("item").alias("_i"), "seed_id")
    heads = items.select(F.col("item").alias("_h"), F.col("title").alias("_head"))
    rows = rows.join(stars, F.col("item") == F.col("_i"), "left").join(heads, F.col("seed_id") == F.col("_h"), "left")
    reminded = rows.filter("action = 'remind'").select(F.col("seed_id").alias("_s")).distinct()  # a star's head reminds for all of it
    rows = rows.join(reminded, F.col("seed_id") == F.col("_s"), "left")
    merged = F.col("seed_id").isNotNull() & (F.col("seed_id") != F.col("item"))
    passed_on = F.col("_s").isNotNull()
    action = F.when(merged, "merge").when(F.col("seed_id").isNotNull() & passed_on, "remind").otherwise(F.col("action"))
    rep = F.when(merged, F.col("_head")).when(F.col("kw"), F.col("kw_rep")).otherwise(F.col("matched"))
    return rows.select("item", action.alias("action"), F.when(merged, F.col("_head")).otherwise(F.col("matched")).alias("matched"), rep.alias("rep"))


def _kept_share(asked: DataFrame, window: DataFrame, least: int) -> DataFrame:
    """item, share: of the window's rows that share enough tokens with the item or with the report it is held against,
    the share that is kept; null without such rows."""
    pool = window.groupBy(F.array_sort(words_in("tokens")).alias("tokens")).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept"))
    pool = checkpointed(pool.filter(F.size("tokens") >= least).withColumn("r", F.monotonically_increasing_id()))
    ends = checkpointed(asked.select("item", words_in("tokens").alias("tokens"), words_in("v_tokens").alias("more"), F.monotonically_increasing_id().alias("l")))
    met = shared_counts(ends.drop("item"), pool, least).filter("n > 0")
    return ends.select("l", "item").join(met, "l").select("item", (F.col("kept") / F.col("n")).alias("share"))


def _marks(title: Column, signals: list[str], unknown: int) -> Column:
    """A bit for each signal word that a title has."""
    bits = F.lit(0).cast("long")
    for k, word in enumerate(signals):
        bits = bits + F.when(F.contains(title, F.lit(word)), 1 << k).otherwise(0)
    return F.when(title.isNull(), F.lit(unknown).cast("long")).otherwise(bits)


def issue_step(n_linked: Column, n_items: Column, overlap: Column, shared: Column, same_key: Column, similarity: Column, days: Column, urgent: Column) -> Column:
    """What a cluster does: the first rung of the assignment ladder that it reaches."""
    return (
        F.when(n_linked == n_items, "skip")
        .when((overlap >= 2) & (overlap * 2 >= n_items), "assign_overlap")
        .when((shared >= 3) | same_key | (similarity >= 0.80), "assign_match")
        .when((overlap >= 3) | (similarity >= 0.60), "judge")
        .when(((n_items >= 5) & (days >= 2)) | ((urgent >= 3) & (days >= 3)), "propose")
        .otherwise("none")
    )


def issue_life(idle_days: Column, open_days: Column, cool_days: Column) -> Column:
    """dormant after 30 idle days; resolve is proposed after 90, once in 30 days."""
    return F.when((idle_days >= 90) & (F.coalesce(cool_days, F.lit(999)) >= 30), "propose_resolve").when(idle_days >= 30, "dormant").otherwise("active")
