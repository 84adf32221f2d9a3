"""Hand-made cases for behaviour that SQL does not express well."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import udfs
from corpusloom.functions.trigrams import trigrams_of, word_similarity_of
from corpusloom.operators import clusters as cl
from corpusloom.operators import events as ev
from corpusloom.operators import rules as ru
from corpusloom.operators import search as se
from corpusloom.operators import speech as sp
from corpusloom.operators import tables as tb


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_star_clusters_are_not_transitive(spark):
    a, b, c = ["x", "y", "z", "p"], ["x", "y", "z", "q", "r", "s"], ["q", "r", "s", "t"]
    made = lambda *order: spark.createDataFrame([("d", i, n, t) for i, (n, t) in enumerate(order)], "day string, at int, id string, tokens array<string>")
    assert rows(cl.star_clusters(made(("A", a), ("B", b), ("C", c)), ["day"], "at", "id", "tokens"), "id", "seed_id") == [("A", "A"), ("B", "A"), ("C", "C")]
    assert rows(cl.star_clusters(made(("B", b), ("A", a), ("C", c)), ["day"], "at", "id", "tokens"), "id", "seed_id") == [("A", "B"), ("B", "B"), ("C", "B")]


def test_greedy_pick_frees_what_is_not_picked(spark):
    hits = [(i, 1) for i in range(6)] + [(5, 2), (9, 2)]
    got = se.greedy_pick(spark.createDataFrame(hits, "id int, ord int"), "id", [], 2, 4)
    assert rows(got, "ord", "id") == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 5), (2, 9)]


def test_follow_up_is_cancelled_by_a_new_signal(spark):
    df = spark.createDataFrame([(3, "fine imposed today", "fine planned"), (3, "same again", "same"), (2, "x", "x")], "n int, new string, old string")
    assert [r[0] for r in df.select(cl.follow_up(F.col("n"), F.col("new"), F.col("old"), ["imposed"])).collect()] == [False, True, False]


def test_first_rule_wins_even_without_effect(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id int, text string")
    rules = spark.createDataFrame([("low", 1, "min", "normal", ["alpha"], None, None, True), ("high", 2, "set", "urgent", ["alpha", "gamma"], [], [], True)], "id string, position int, mode string, level string, any_words array<string>, and_any array<array<string>>, none_words array<string>, enabled boolean")
    out = ru.first_rule(items, "text", "id", rules).withColumn("own", ru.combined(F.col("rule_mode"), F.col("rule_level"), F.lit("urgent")))
    assert rows(out, "id", "rule_id", "own") == [(1, "low", 2), (2, "high", 2)]


LEVEL = "source string, stored string, rule_team int, enabled boolean, mode string, level string, common string"


@pytest.mark.parametrize(("row", "eff", "alert"), [
    ((None, None, None, None, None, None, "normal"), 1, 1),  # no row: common
    (("human", "reference", None, None, None, None, "urgent"), 0, 0),  # people lower, also the alert
    (("human", "urgent", None, None, None, None, "normal"), 2, 1),  # people raise: shown, not alerted
    (("human", "high", None, None, None, None, "urgent"), 2, 2),  # an unknown level counts as none
    (("ai", "high", None, None, None, None, "normal"), 1, 1),
    (("ai", "urgent", None, None, None, None, "reference"), 2, 2),
    (("rule", "normal", 1, True, "set", "reference", "urgent"), 0, 0),  # the rule of today, not what was stored
    (("rule", "normal", 1, True, "min", "urgent", "normal"), 2, 2),
    (("rule", "normal", 1, True, "min", "normal", "urgent"), 2, 2),  # a floor below common
    (("rule", "urgent", 1, False, "min", "urgent", "reference"), 0, 0),  # off
    (("rule", "urgent", 2, True, "set", "urgent", "normal"), 1, 1),  # another team's
    (("rule", "urgent", None, None, None, None, "normal"), 1, 1),  # gone
    (("rule", "urgent", 1, True, "set", "high", "normal"), 1, 1),  # malformed
    (("rule", "urgent", 1, True, "put", "urgent", "normal"), 1, 1),
])
def test_override_layers(spark, row, eff, alert):
    df = spark.createDataFrame([row], LEVEL)
    now = ru.recomputed(F.col("rule_team"), F.lit(1), F.col("enabled"), F.col("mode"), F.col("level"), F.col("common"))
    shown = ru.effective(F.col("source"), F.col("stored"), now, F.col("common"))
    assert tuple(df.select(shown, ru.alert_rank(F.col("source"), shown, F.col("common"))).first()) == (eff, alert)


def test_division_levels(spark):
    """The teams' highest, in the order of the division; common is not among them; without teams it is common."""
    items = spark.createDataFrame([(1, "normal"), (2, "urgent"), (3, "urgent")], "item int, common string")
    members = spark.createDataFrame([(30, 0), (10, 1), (20, 2)], "team int, place int")
    ranks = spark.createDataFrame([(1, 10, 2), (2, 10, 0), (3, 10, 0), (3, 20, 1), (3, 30, 1)], "item int, team int, r int")
    assert rows(ru.division_levels(items, "item", "common", members, "team", "place", ranks, "r"), "item", "top", "teams") == [(1, 2, [10]), (2, 2, [30, 20]), (3, 1, [30, 20])]
    assert rows(ru.division_levels(items, "item", "common", members.limit(0), "team", "place", ranks, "r"), "item", "top", "teams") == [(1, 1, []), (2, 2, []), (3, 2, [])]


def test_rule_text(spark):
    df = spark.createDataFrame([("T", "seen", "sum"), ("T", "  \u3000", "sum"), ("T", "\ufeff\x85\x1c", "sum"), ("T", None, None), (None, "e\u0301", "x")], "t string, s string, m string")
    assert [r[0] for r in df.select(ru.rule_text(F.col("t"), F.col("s"), F.col("m"))).collect()] == ["T seen", "T sum", "T sum", "T ", " é"]


def test_version_pick(spark):
    df = spark.createDataFrame([("future", 1, "2030-01-01"), ("future", 2, "2029-01-01"), ("mixed", 3, "2020-01-01"), ("mixed", 4, "2021-01-01"), ("mixed", 5, "2031-01-01")], "law string, id int, d string").withColumn("d", F.to_timestamp("d"))
    assert rows(tb.in_force(df, ["law"], "d", F.lit("2026-01-01").cast("timestamp"), "id"), "law", "id") == [("future", 2), ("mixed", 4)]


def test_diff(spark):
    gone = "제2조(정의) 삭제 <2026. 1. 1.>"
    old = spark.createDataFrame([("1", "a b"), ("2", "x"), ("3", "gone"), ("4", "same text"), ("6", gone), ("7", "제7조 삭제")], "k string, t string")
    new = spark.createDataFrame([("1", "a  b "), ("2", " " + gone), ("4", "other text"), ("5", "fresh"), ("6", gone + " "), ("7", "제7조(재개) 다시"), ("8", "제8조의2 삭제")], "k string, t string")
    assert rows(tb.keyed_diff(old, new, ["k"], "t"), "k", "change", "old_text") == [("2", "deleted", "x"), ("3", "deleted", "gone"), ("4", "modified", "same text"), ("5", "added", ""), ("7", "modified", "제7조 삭제"), ("8", "deleted", "")]


def test_version_pick_of_day_text(spark):
    df = spark.createDataFrame([("a", 1, "20200101"), ("a", 2, "20260101"), ("a", 3, "20270101"), ("b", 4, "20280101"), ("b", 5, "20270601")], "law string, id int, d string")
    assert rows(tb.in_force(df, ["law"], "d", F.lit("20260301"), "id"), "law", "id") == [("a", 2), ("b", 5)]


def test_denied_calls_are_taken_back(spark):
    """One an hour, three a day: tries that are denied do not use up the day."""
    calls = [("u", i, datetime(2026, 1, 5, h, m)) for i, (h, m) in enumerate([(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (3, 0), (15, 30)])]
    calls += [("free", 20 + i, datetime(2026, 1, 5, 0, i)) for i in range(5)]
    df = spark.createDataFrame([(*c, c[0] == "free") for c in calls], "u string, id int, at timestamp, free boolean")
    got = {r["id"]: (r["hour_n"], r["day_n"], r["denied"]) for r in ev.quota(df, "u", "at", "id", 1, 3, "free").collect()}
    assert [got[i] for i in range(8)] == [(1, 1, False), (2, 2, True), (2, 2, True), (2, 2, True), (1, 2, False), (1, 3, False), (1, 4, True), (1, 1, False)]  # 15:30 is the next day in Seoul
    assert [got[20 + i][1:] for i in range(5)] == [(i + 1, False) for i in range(5)]


def test_quota_equals_a_fold_call_by_call(spark):
    import random

    rng = random.Random(3)
    calls = [(rng.randrange(4), i, datetime(2026, 1, 5, rng.randrange(24), rng.randrange(60))) for i in range(400)]
    got = {r["id"]: (r["hour_n"], r["day_n"], r["denied"]) for r in ev.quota(spark.createDataFrame(calls, "u int, id int, at timestamp"), "u", "at", "id", 2, 9).collect()}
    used: dict = {}
    for u, i, at in sorted(calls, key=lambda c: (c[2], c[1])):
        hour, day = (u, at.replace(minute=0)), (u, (at.toordinal() * 24 + at.hour + 9) // 24)
        h, d = used.get(hour, 0) + 1, used.get(day, 0) + 1
        assert got[i] == (h, d, h > 2 or d > 9)
        if not got[i][2]:
            used[hour], used[day] = h, d


def test_member_and_team_limits(spark):
    at = lambda m: datetime(2026, 1, 5, 1, m)
    calls = [("a", "t", 0, False), ("a", "t", 1, False), ("a", "t", 2, False), ("b", "t", 3, False), ("b", "t", 4, False), ("a", "t", 5, False), ("vip", "t", 6, True), ("c", None, 7, False)]
    df = spark.createDataFrame([(u, t, m, at(m), 2, 3, f, False) for u, t, m, f in calls], "u string, team string, id int, at timestamp, member int, sum int, free boolean, team_free boolean")
    got = ev.member_quota(df, "u", "team", "at", "id", "member", "sum", "free", "team_free")
    assert [r["reason"] for r in got.orderBy("id").collect()] == [None, None, "member_limit", None, "team_limit", "member_limit", "team_limit", None]


def test_a_key_is_quiet_after_a_kept_row(spark):
    hours = [("k", h) for h in (0, 15, 30, 49, 50, 51, 72)] + [("l", 3)]
    df = spark.createDataFrame([(k, i, datetime(2026, 1, 1 + h // 24, h % 24)) for i, (k, h) in enumerate(hours)], "k string, id int, at timestamp")
    assert [r["id"] for r in ev.first_within(df, ["k"], "at", "id", 20 * 3600).orderBy("id").collect()] == [0, 2, 5, 6, 7]


def test_watermark_moves_over_undelivered_rows(spark):
    t = lambda h: datetime(2026, 1, 5, h)
    queue = spark.createDataFrame([(1, t(9), ["a"]), (2, t(10), ["a"])], "item int, created_at timestamp, tags array<string>")
    subs = spark.createDataFrame([("s", t(8), ["b"]), ("late", t(11), ["a"]), ("new", None, [])], "subscriber string, watermark timestamp, tags array<string>")
    plan = ev.delivery_plan(queue, subs, F.lit("2026-01-05 12:00:00").cast("timestamp"), 15)
    assert rows(ev.advanced(plan, subs), "subscriber", "watermark", "delivered") == [("late", t(11), 0), ("new", t(10), 2), ("s", t(10), 0)]


def test_business_hours_over_a_weekend(spark):
    df = spark.createDataFrame([("2026-01-02 17:00:00", "2026-01-05 10:00:00"), ("2026-01-05 10:00:00", "2026-01-02 17:00:00")], "a string, b string")
    df = df.select(F.to_utc_timestamp("a", "Asia/Seoul").alias("a"), F.to_utc_timestamp("b", "Asia/Seoul").alias("b"))
    assert [r["hours"] for r in ev.business_hours(df, "a", "b").collect()] == [1.5, 0.0]


def test_fusion_prefers_two_lists(spark):
    lists = [("x", f"d{i}", 10.0 - i, "g") for i in range(3)] + [("y", "d2", 5.0, "g"), ("y", "d9", 4.0, "h")]
    got = se.fuse(spark.createDataFrame(lists, "list string, id string, score double, grp string"), "id", "grp", 3, 10)
    assert got.collect()[0]["id"] == "d2"


def test_chains_and_cycles_end(spark):
    links = [(i, i + 1, i == 40) for i in range(100)] + [(201, 202, False), (202, 203, False), (203, 201, True)]
    got = {r["c"]: (r["rep"], r["judged"]) for r in cl.representatives(spark.createDataFrame(links, "c int, p int, j boolean"), "c", "p", "j").collect()}
    assert all(got[i] == (100, i <= 40) for i in range(100))
    assert {i: got[i] for i in (201, 202, 203)} == {i: (i, True) for i in (201, 202, 203)}  # a walk round a cycle ends where it began


def test_tails_enter_cycles_where_they_meet_them(spark):
    links = [(1, 2, False), (2, 3, False), (3, 4, False), (4, 2, True), (10, 11, True), (11, 3, False), (20, 20, False), (21, 20, False), (30, 31, False)] + [(100 + i, 101 + i, False) for i in range(700)]
    got = {r["c"]: (r["rep"], r["judged"]) for r in cl.representatives(spark.createDataFrame(links, "c int, p int, j boolean"), "c", "p", "j").collect()}

    def walk(c):
        step, judged, seen = {a: (b, j) for a, b, j in links}, False, set()
        while c in step and c not in seen:
            seen.add(c)
            judged |= step[c][1]
            c = step[c][0]
        return c, judged

    assert got == {c: walk(c) for c, _, _ in links}


def test_suppression_ladder(spark):
    cases = [(17.0, True, None, 0.0, "suppress"), (18.0, True, None, 0.0, "pass"), (23.0, False, True, 0.0, "suppress"), (24.0, False, True, 0.5, "remind"), (24.0, False, True, 0.4, "hold"), (None, False, True, 0.9, "remind"), (None, True, None, 0.9, "pass"), (30.0, False, True, None, "remind"), (20.0, True, False, 0.9, "pass"), (30.0, None, True, 0.1, "hold")]
    df = spark.createDataFrame(cases, "age double, kw boolean, same boolean, share double, want string")
    assert all(r["action"] == r["want"] for r in cl.suppression(df, "age", "kw", "same", "share").collect())


def test_votes(spark):
    cases = [([1], 1), ([None], None), ([], None), ([1, 2], None), ([2, 2], 2), ([2, None], None), ([2, None, None], None), ([0, 1, 2], 1), ([0, 0, 2], 0), ([None, 1, 1], 1), ([None, 1, 2], None), ([0, 0, 2, 2], 0), ([2, 2, 2, 0, 1], 2)]
    df = spark.createDataFrame([(v,) for v, _ in cases], "v array<int>")
    assert [r[0] for r in df.select(ru.combined_votes(F.col("v"))).collect()] == [want for _, want in cases]


def test_events_group_by_label_title_and_tags(spark):
    items = [
        (1, 9, "License-fee RISE", ["fee", "rise"], ["a"]), (2, 8, "license fee rise, plan", ["other"], ["a"]),  # labels agree but for case and signs
        (3, 7, "", ["fee", "rise", "today"], []), (4, 6, "license fee rise", ["fee"], ["b"]),  # by title; other tags
        (5, 5, "quite another", ["fee", "rise"], ["a"]), (6, 4, None, ["fee", "fee"], None),  # labels decide where both have one; words that the opener has count once each
    ]
    df = spark.createDataFrame([("d", *i) for i in items], "day string, id int, published int, event string, words array<string>, tags array<string>")
    assert rows(cl.event_groups(df, ["day"], "id", "id", "event", "words", "tags"), "id", "head_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]
    assert rows(cl.event_groups(df, ["day"], "id", "id", "event", "words", "tags", "published"), "id", "head_id") == [(1, 3), (2, 3), (3, 3), (4, 4), (5, 5), (6, 6)]
    assert cl.overlap_coefficient(cl.label_pairs("aaaa"), cl.label_pairs("AA a")) == 1.0 and cl.overlap_coefficient(cl.label_pairs("a"), cl.label_pairs("ab")) == 0.0


def test_field_shares(spark):
    fields = {"a": {"strong": ["alpha"], "weak": ["omega"]}, "b": {"strong": ["beta"]}}
    df = spark.createDataFrame([("alpha alpha beta",), ("alpha beta",), ("omega",), ("none",)], "t string")
    assert [r[0] for r in df.select(sp.field_weights(F.col("t"), fields, "z")).collect()] == [{"a": 1.0}, {"a": 0.5, "b": 0.5}, {"a": 1.0}, {"z": 1.0}]


def test_text_functions(spark):
    df = spark.createDataFrame([("제48조의3 (x)", "Act on Things(law)(No. 12)(20260101)", "One. Two! Three", "2026.1.5 posted", "é")], "ref string, name string, s string, d string, u string")
    r = df.select(tx.article_key(F.col("ref")).alias("k"), tx.document_name(F.col("name")).alias("n"), tx.clipped(F.col("s"), 10).alias("c"), tx.any_date(F.col("d")).cast("string").alias("d"), udfs.nfc(F.col("u")).alias("u"), tx.longest_common(F.col("s"), F.lit("xx Two! y")).alias("l"), tx.guarded_hit(F.col("s"), "Two", after="x").alias("g")).first()
    assert (r["k"], tuple(r["n"]), r["c"], r["d"], r["u"], r["l"], r["g"]) == ("48-3", ("Act on Things", "law", "No. 12", "20260101"), "One. Two!", "2026-01-05", "é", 6, True)


def test_word_similarity():
    assert trigrams_of("cat") == ["  c", " ca", "cat", "at "]
    assert word_similarity_of("cat", "a black cat sat") == 1.0
    assert word_similarity_of("cat", "dog") == 0.0
    assert word_similarity_of("word", "two words") == pytest.approx(0.8)
    assert word_similarity_of("word", "two words", 0.9) == 0.0


def test_name_fallbacks_and_changes(spark):
    registry = spark.createDataFrame([("Radio Act",), ("Wave Act",), ("Wave Law",)], "name string")
    names = spark.createDataFrame([("RadioAct",), ("radio",), ("Old",), ("wave",)], "q string")
    got = tb.resolve_names(names, "q", registry, spark.createDataFrame([("old", "New Act")], "old string, new string"))
    assert rows(got.fillna("-"), "q", "resolved", "how") == [("Old", "New Act", "renamed"), ("RadioAct", "Radio Act", "exact"), ("radio", "Radio Act", "loose"), ("wave", "-", "-")]


def test_sentence_rules(spark):
    rowsin = [(1, 1, "w", True, None), (1, 2, "x", True, False), (1, 3, "y", True, True), (1, 4, "z", False, None), (2, 1, "a", True, None)]
    got = ru.sentence_decision(spark.createDataFrame(rowsin, "item int, position int, rule_id string, is_sentence boolean, verdict boolean"), "item")
    assert rows(got.withColumn("rule_id", F.coalesce("rule_id", F.lit("-"))), "item", "rule_id", "ask") == [(1, "y", ["w"]), (2, "-", ["a"])]


def test_sources(spark, tmp_path):
    from corpusloom.sources import feeds

    (tmp_path / "news.json").write_text(json.dumps({"keyword": "k", "items": [{"title": "<b>A</b> &amp; B", "link": "http://a", "description": "d", "pubDate": "Mon, 05 Jan 2026 10:00:00 +0900"}]}))
    r = feeds.news_json(spark, str(tmp_path / "news.json")).first()
    assert (r["title"], r["url"], r["published_at"]) == ("A & B", "http://a", datetime(2026, 1, 5, 1))
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>http://t</link><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate></item></channel></rss>")
    r = feeds.feed_xml(spark, str(tmp_path / "feed.xml")).first()
    assert (r["title"], r["url"], r["published_at"]) == ("T", "http://t", datetime(2026, 1, 5, 10))
    (tmp_path / "law.json").write_text(json.dumps({"law": "L", "articles": [{"no": "1", "content": "c"}], "addenda": [], "annexes": [{"no": "A", "content": "x"}]}))
    assert rows(feeds.law_articles(spark, str(tmp_path / "law.json")), "unit", "no") == [("annex", "A"), ("article", "1")]
    (tmp_path / "n.md").write_text("---\ntitle: My note\nkind: act\n---\n# One\n" + "a" * 40 + ".\n## Two\nshort\n# Three\n" + "b" * 1500)
    note = feeds.notes(spark, str(tmp_path / "n.md"))
    assert note.first()["meta"] == {"title": "My note", "kind": "act"}
    chunks = feeds.header_chunks(note.withColumn("title", F.col("meta")["title"]), ["path"], "title", "body").collect()
    assert [len(c["chunk"]) for c in chunks] == [len("[My note] ") + n for n in (47, 1000, 608)]
    pages = spark.createDataFrame([(1, '<title>x</title><meta property="og:title" content="Y"><article><p>Body <a href="/l">l</a></p></article><li><a>i1</a><i>2026-01-01</i></li>')], "id int, html string")
    a = feeds.page_articles(pages, "id", "html").first()
    assert (a["title"], a["body"], a["links"]) == ("Y", "Body l", ["/l"])
    assert rows(feeds.board_rows(pages, "id", "html", "(?s)<li>.*?</li>", {"name": "<a>(.*?)</a>", "day": "<i>(.*?)</i>"}), "name", "day") == [("i1", "2026-01-01")]


def test_streams_equal_batches(spark, tmp_path):
    from corpusloom.streaming import deliveries as dv

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    for i, part in enumerate(src.randomSplit([1.0, 1.0], 3)):
        part.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        for f in (tmp_path / f"p{i}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{i}.parquet")
    stream = dv.event_stream(spark, str(tmp_path / "in"))
    dv.run_once(dv.hourly_counts(stream, "60 days"), str(tmp_path / "h"), str(tmp_path / "ch"))
    dv.run_once(dv.first_seen(stream, ["user_id", "event_type"], "60 days"), str(tmp_path / "f"), str(tmp_path / "cf"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == batch.select("user_id", "event_type").distinct().count()
    seen = []
    counts = stream.groupBy("event_type").count()
    dv.upsert_batches(counts, str(tmp_path / "cu"), lambda df, i: seen.append({r["event_type"]: r["count"] for r in df.collect()}))
    merged = {}
    for s in seen:
        merged |= s
    assert merged == {r["event_type"]: r["count"] for r in batch.groupBy("event_type").count().collect()}


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_star_clusters_equal_the_sequential_walk(spark):
    """Random items in three parts, with ties, null orders, null and short token lists and repeated rows."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    items = [(i % 3, rng.choice([None, *range(40)]), i, rng.choice([None, [], *[rng.sample(words, rng.randrange(1, 9)) for _ in range(6)]])) for i in range(240)]
    items += items[:20]
    df = spark.createDataFrame(items, "p int, at int, id int, t array<string>")
    for part, least in ((["p"], 3), ([], 2)):
        want, seeds = {}, {}
        for p, at, i, t in sorted(items, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
            held = seeds.setdefault(p if part else None, [])
            own = set(t or [])
            want.setdefault(i, next((s for s, w in held if len(w & own) >= least), i))
            if want[i] == i:
                held.append((i, own))
        got = cl.star_clusters(df, part, "at", "id", "t", least).collect()
        assert len(got) == len(items) and {r["id"]: r["seed_id"] for r in got} == want


def test_watermarks_without_a_plan(spark):
    """Counts by set of tags equal those of the plan, at ties, edges, null and empty tags and watermarks."""
    rng = random.Random(12)
    clock = datetime(2024, 1, 30, 18, 0)
    times = [clock - timedelta(minutes=m) for m in [*range(0, 40), 59, 60, 61, 1079, 1080, 1081, 4319, 4320, 4321, 5000]]
    tags = lambda: rng.choice([None, [], ["a"], ["b"], ["a", "b"], ["b", "a"], ["c", None]])
    queue = spark.createDataFrame([(i, rng.choice(times), tags()) for i in range(400)] + [(999, None, ["a"])], "item int, created_at timestamp, tags array<string>")
    people = spark.createDataFrame([(i, rng.choice([None, *times, clock + timedelta(days=1)]), tags()) for i in range(80)], "subscriber int, watermark timestamp, tags array<string>")
    for normal in (False, True):
        args = (queue, people, F.lit(clock).cast("timestamp"), 15, 72, normal)
        want = {tuple(r) for r in ev.advanced(ev.delivery_plan(*args), people).collect()}
        assert {tuple(r) for r in ev.watermarks(*args).collect()} == want and len(want) == 80
    assert {tuple(r) for r in ev.watermarks(queue.limit(0), people, *args[2:]).collect()} == {(r["subscriber"], r["watermark"], 0) for r in people.collect()}


def test_quiet_times_leave_out_rows_without_an_instant(spark):
    rows = [("k", None, 0), ("k", datetime(2024, 1, 1), 1), (None, datetime(2024, 1, 1), 2), ("k", datetime(2024, 1, 1, 0, 0, 5), 3)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int")
    assert sorted(r["i"] for r in ev.first_within(df, ["k"], "at", "i", 10).collect()) == [1, 2]


@pytest.mark.parametrize("inline,block", [(64, 20_000), (0, 7), (0, 20_000)])
def test_rules_by_automaton_equal_a_walk(spark, inline, block):
    """Conditions in the plan, blocks of a few rules, one block: the same first rules, on null and empty texts and words too."""
    rng = random.Random(4)
    words = ["a", "ab", "bca", "가나", "나다", "zz", "b c", "x"]
    some = lambda n: rng.choice([None, [], *[rng.sample(words, k) for k in range(1, n)]])
    rules = [(rng.random() < 0.9, rng.randrange(20), f"r{i:02}", rng.choice(["set", "min"]), "urgent", some(3), rng.choice([None, [], [["a"], ["zz", "x"]], [["가나"]]]), some(2)) for i in range(40)]
    rules.append((True, 50, "last", "set", "normal", [""], None, ["zz"]))
    table = spark.createDataFrame(rules, "enabled boolean, position int, id string, mode string, level string, any_words array<string>, and_any array<array<string>>, none_words array<string>")
    texts = [None, "", *["".join(rng.choices(["a", "b", "c", " ", "가", "나", "다", "z", "x"], k=rng.randrange(1, 12))) for _ in range(200)]]
    got = ru.first_rule(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", "id", table, inline, block)
    assert got.columns == ["id", "text", "rule_id", "rule_mode", "rule_level"]

    def first(t):
        for on, _, i, mode, level, some_of, groups, none in sorted(rules, key=lambda r: (r[1], r[2])):
            if t is not None and on and any(w in t for w in some_of or []) and all(any(w in t for w in g) for g in groups or []) and not any(w in t for w in none or []):
                return i, mode, level
        return None, None, None

    assert {r["id"]: (r["rule_id"], r["rule_mode"], r["rule_level"]) for r in got.collect()} == {i: first(t) for i, t in enumerate(texts)}


def test_all_keywords_count(spark):
    words = [f"word{i:02}" for i in range(12)]
    chunk = spark.createDataFrame([(" ".join(words), "", "")], "content string, doc_name string, article_no string")
    score = lambda *most: chunk.select(se.keyword_score({c: c for c in chunk.columns}, words, [], [], [], *most)).first()[0]
    assert (score(), score(10)) == (12, 10)


def test_deliveries_go_on_after_a_restart(spark, tmp_path):
    """Rows in order over five files, the query stopped after two: what is sent equals the batch form, each row once."""
    from corpusloom.streaming import deliveries as dv

    rng = random.Random(2)
    start, schema = datetime(2024, 1, 1), "item long, created_at timestamp, audience string, tags array<string>"
    rows = [(i, start + timedelta(minutes=3 * i + rng.randrange(3)), rng.choice("xyz"), rng.choice([None, [], ["a"], ["b"]])) for i in range(100)]
    people = spark.createDataFrame([("p", "x", ["a"], start), ("q", "x", None, start + timedelta(minutes=60)), ("r", "y", ["b", "c"], start - timedelta(days=1))], "subscriber string, audience string, tags array<string>, since timestamp")
    (tmp_path / "in").mkdir()

    def land(part):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
        (f,) = (tmp_path / f"p{part}").glob("*.parquet")
        f.rename(tmp_path / "in" / f"{part}.parquet")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with dv.keyed_state(spark):
            dv.run_once(dv.deliveries(stream, people, 15, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
        return sorted((r["subscriber"], r["item"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    land(0), land(1)
    first = run()
    for part in (2, 3, 4):
        land(part)
    sent = run()
    clock = rows[-1][1]
    want = []
    for name, audience, tags, since in people.collect():
        want += [(name, i) for i, at, a, own in rows if a == audience and since < at <= clock - timedelta(minutes=15) and (not tags or not own or set(tags) & set(own))]
    assert sent == sorted(want) and set(first) < set(sent)
