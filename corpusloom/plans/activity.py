"""Queries over logs, queues and speech: quotas, deliveries, monitoring, sessions, context, and the sequential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import clusters as cl
from corpusloom.operators import events as ev
from corpusloom.operators import speech as sp
from corpusloom.plans.registry import register
from corpusloom.session import table

CLOCK = "2024-01-31 00:00:00"


def clock():
    return F.lit(CLOCK).cast("timestamp")


@register("hourly_buckets", "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_buckets(spark, sf):
    return ev.buckets(table(spark, sf, "events"), "ts", ["event_type"], "1 hour")


@register("quota_denials", """
    WITH c AS (SELECT event_id, user_id, ts, user_id % 10 = 0 AS free, (ts + INTERVAL 9 HOUR)::DATE AS day, date_trunc('hour', ts) AS hour FROM events),
    h AS (SELECT user_id, day, hour, CASE WHEN any_value(free) THEN count(*) ELSE least(count(*), 1) END AS let FROM c GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(let) OVER (PARTITION BY user_id, day ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
    r AS (SELECT c.*, row_number() OVER (PARTITION BY c.user_id, c.day, c.hour ORDER BY ts, event_id) AS r, CASE WHEN free THEN before ELSE least(before, 4) END AS before
          FROM c JOIN b ON c.user_id = b.user_id AND c.day = b.day AND c.hour = b.hour),
    n AS (SELECT event_id, free, CASE WHEN free THEN r - 1 ELSE least(r - 1, 1, 4 - before) END AS own, before FROM r)
    SELECT event_id, (own + 1)::INT AS hour_n, (before + own + 1)::INT AS day_n, NOT free AND (own + 1 > 1 OR before + own + 1 > 4) AS denied FROM n""")
def quota_denials(spark, sf):
    calls = table(spark, sf, "events").withColumn("free", F.col("user_id") % 10 == 0)
    return ev.quota(calls, "user_id", "ts", "event_id", 1, 4, "free").select("event_id", "hour_n", "day_n", "denied")


@register("team_quota", """
    WITH RECURSIVE c AS (SELECT event_id, user_id, user_id % 40 AS team, (ts + INTERVAL 9 HOUR)::DATE AS day, row_number() OVER (PARTITION BY user_id % 40, (ts + INTERVAL 9 HOUR)::DATE ORDER BY ts, event_id) AS k FROM events),
    step(team, day, k, event_id, used, reason) AS (
        SELECT team, day, 1, event_id, MAP {user_id: 1}, NULL::VARCHAR FROM c WHERE k = 1
        UNION ALL
        SELECT c.team, c.day, c.k, c.event_id,
               CASE WHEN coalesce(used[c.user_id], 0) < 2 AND list_sum(map_values(used)) < 3
                    THEN map_from_entries([e FOR e IN map_entries(used) IF e.key <> c.user_id] || [{'key': c.user_id, 'value': (coalesce(used[c.user_id], 0) + 1)::INT}]) ELSE used END,
               CASE WHEN coalesce(used[c.user_id], 0) >= 2 THEN 'member_limit' WHEN list_sum(map_values(used)) >= 3 THEN 'team_limit' END
        FROM step s JOIN c ON c.team = s.team AND c.day = s.day AND c.k = s.k + 1)
    SELECT event_id, reason FROM step""")
def team_quota(spark, sf):
    """The twin walks call by call; the operator works on ranks."""
    calls = table(spark, sf, "events").withColumns({"team": F.col("user_id") % 40, "member": F.lit(2), "sum": F.lit(3), "free": F.lit(False)})
    return ev.member_quota(calls, "user_id", "team", "ts", "event_id", "member", "sum", "free", "free").select("event_id", "reason")


@register("business_hours", """
    WITH e AS (SELECT event_id, epoch(ts + INTERVAL 9 HOUR)::BIGINT AS a, epoch(ts + INTERVAL 9 HOUR)::BIGINT + (value * 7200)::BIGINT AS b FROM (SELECT event_id, date_trunc('second', ts) AS ts, value FROM events)),
    d AS (SELECT event_id, a, b, unnest(range(a // 86400, b // 86400 + 1)) AS d FROM e)
    SELECT event_id, round(sum(CASE WHEN (d + 3) % 7 < 5 THEN greatest(0, least(b, d * 86400 + 64800) - greatest(a, d * 86400 + 34200)) ELSE 0 END) / 3600, 6) AS hours FROM d GROUP BY event_id""")
def business_hours(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").alias("a"), "value")
    rows = rows.withColumn("b", F.timestamp_seconds(F.unix_timestamp("a") + F.round(F.col("value") * 7200).cast("long")))
    return ev.business_hours(rows, "a", "b").select("event_id", "hours")


@register("heartbeat_ages", """
    WITH t AS (SELECT DISTINCT user_id + 20 AS user_id, 24.0 + user_id % 48 AS thresh_h FROM events), b AS (SELECT user_id, max(ts) AS last_at FROM events GROUP BY 1)
    SELECT user_id, age_h, age_h IS NULL OR age_h > thresh_h AS stale FROM (SELECT t.*, round((epoch(TIMESTAMP '2024-01-31') - floor(epoch(last_at))) / 3600, 6) AS age_h FROM t LEFT JOIN b USING (user_id))""")
def heartbeat_ages(spark, sf):
    events = table(spark, sf, "events")
    targets = events.select((F.col("user_id") + 20).alias("user_id"), (24.0 + F.col("user_id") % 48).alias("thresh_h")).distinct()
    return ev.heartbeat_ages(targets, events, "user_id", "ts", clock()).select("user_id", "age_h", "stale")


@register("watchdog_new_items", """
    WITH k AS (SELECT user_id % 7 AS grp, list_distinct(list(event_type) FILTER (value > 60)) AS now, list_distinct(list(event_type) FILTER (value > 61 AND event_id % 2 = 0)) AS old FROM events GROUP BY 1)
    SELECT grp, list_sort(list_filter(coalesce(now, []), lambda x: NOT list_contains(coalesce(old, []), x))) AS fresh FROM k""")
def watchdog_new_items(spark, sf):
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 7).alias("grp")).agg(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("now"), F.collect_set(F.when((F.col("value") > 61) & (F.col("event_id") % 2 == 0), F.col("event_type"))).alias("old"))
    return e.select("grp", ev.new_alerts(F.col("now"), F.col("old")).alias("fresh"))


PLAN_SQL = """
    WITH q AS (SELECT event_id AS item, ts AS created_at, CASE WHEN event_id % 5 = 0 THEN [] WHEN event_id % 7 = 0 THEN NULL ELSE [event_type] END AS tags FROM events),
    s AS (SELECT DISTINCT user_id AS subscriber, CASE WHEN user_id % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-29' + INTERVAL (user_id) MINUTE END AS watermark, CASE user_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['click'] ELSE ['view', 'error'] END AS tags FROM events),
    p AS (SELECT subscriber, item, created_at, len(s.tags) = 0 OR coalesce(len(q.tags), 0) = 0 OR list_has_any(q.tags, s.tags) AS deliver FROM q JOIN s ON
        created_at > coalesce(watermark, date_trunc('day', TIMESTAMP '2024-01-30 18:00:00')) AND created_at <= TIMESTAMP '2024-01-30 18:00:00' - INTERVAL 15 MINUTE AND created_at >= TIMESTAMP '2024-01-30 18:00:00' - INTERVAL 72 HOUR)
"""


def _plan(spark, sf):
    events, u = table(spark, sf, "events"), F.col("user_id")
    none = F.array().cast("array<string>")
    queue = events.select(F.col("event_id").alias("item"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 5 == 0, none).when(F.col("event_id") % 7 != 0, F.array("event_type")).alias("tags"))
    tags = F.when(u % 4 == 0, none).when(u % 4 == 1, F.array(F.lit("click"))).otherwise(F.array(F.lit("view"), F.lit("error")))
    mark = F.when(u % 3 != 0, F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-29 00:00:00")) + u * 60))
    subscribers = events.select("user_id").distinct().select(u.alias("subscriber"), mark.alias("watermark"), tags.alias("tags"))
    return queue, subscribers, F.lit("2024-01-30 18:00:00").cast("timestamp"), 15


@register("subscriber_plan", PLAN_SQL + "SELECT subscriber, item, deliver FROM p")
def subscriber_plan(spark, sf):
    return ev.delivery_plan(*_plan(spark, sf)).select("subscriber", "item", "deliver")


@register("watermark_advance", PLAN_SQL + "SELECT s.subscriber, coalesce(max(created_at), any_value(watermark)) AS watermark, count(*) FILTER (deliver) AS delivered FROM s LEFT JOIN p ON s.subscriber = p.subscriber GROUP BY s.subscriber")
def watermark_advance(spark, sf):
    return ev.watermarks(*_plan(spark, sf))


@register("hold_recheck", """
    SELECT o_orderkey FROM orders LEFT JOIN (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'urgent' ELSE 'normal' END lv FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey WHERE c_custkey IS NOT NULL AND (o_orderkey % 2 = 0 OR lv = 'urgent')""")
def hold_recheck(spark, sf):
    queue = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "unit").alias("unit"))
    articles = table(spark, sf, "customer").filter("c_custkey % 4 != 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") == "MACHINERY", "urgent").otherwise("normal").alias("level"))
    return ev.hold_recheck(queue, articles, "o_custkey", "level", "unit").select("o_orderkey")


@register("daily_cost_spike", """
    WITH d AS (SELECT ts::DATE AS day, round(sum(CASE event_type WHEN 'click' THEN 0.01 WHEN 'view' THEN 0.02 ELSE 0.1 END * value), 6) AS cost FROM events GROUP BY 1),
    m AS (SELECT day, cost, round(median(cost) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS usual FROM d)
    SELECT day, cost, usual, cost >= 1 AND cost > 1.2 * usual AS spike FROM m""")
def daily_cost_spike(spark, sf):
    price = F.when(F.col("event_type") == "click", 0.01).when(F.col("event_type") == "view", 0.02).otherwise(0.1)
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum(price * F.col("value")), 6).alias("cost"))
    return ev.cost_spikes(days, "day", "cost", 1.0, 1.2)  # a row for each day


@register("sessions", """
    SELECT event_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN epoch(ts)::BIGINT IS NULL OR floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600 THEN 0 ELSE 1 END AS n FROM events)""")
def sessions(spark, sf):
    return ev.sessions(table(spark, sf, "events"), ["user_id"], "ts", "event_id", 360).select("event_id", "session")


@register("dedup_within_horizon", """
    WITH RECURSIVE kept(user_id, event_type, ts, event_id) AS (
        SELECT user_id, event_type, m.ts, m.event_id FROM (SELECT user_id, event_type, min({'ts': ts, 'event_id': event_id}) AS m FROM events GROUP BY ALL)
        UNION ALL
        SELECT user_id, event_type, m.ts, m.event_id FROM (
            SELECT k.user_id, k.event_type, min({'ts': e.ts, 'event_id': e.event_id}) AS m FROM kept k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts > k.ts + INTERVAL 20 HOUR GROUP BY ALL))
    SELECT event_id FROM kept""")
def dedup_within_horizon(spark, sf):
    return ev.first_within(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id", 20 * 3600).select("event_id")


@register("screening_cache", """
    SELECT p.page_id, c.page_id IS NOT NULL AS cached FROM pages p LEFT JOIN (SELECT * FROM pages WHERE page_id % 3 = 0) c ON p.url = c.url AND left(sha256(p.html), 16) = left(sha256(c.html), 16)""")
def screening_cache(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.substring(F.sha2("html", 256), 1, 16).alias("h"))
    cache = pages.filter("page_id % 3 = 0").select("url", "h", F.lit(True).alias("cached"))
    return pages.join(cache, ["url", "h"], "left").select("page_id", F.coalesce("cached", F.lit(False)).alias("cached"))


@register("speech_turns", """
    SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_id FROM (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END n FROM conversations)""")
def speech_turns(spark, sf):
    return sp.turns(table(spark, sf, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "turn_id")


@register("speech_carry", """
    SELECT conv_id, turn, last_value(CASE WHEN length(text) % 3 = 0 THEN left(text, 4) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS label FROM conversations""")
def speech_carry(spark, sf):
    label = F.when(F.length("text") % 3 == 0, F.substring("text", 1, 4))
    return sp.carried(table(spark, sf, "conversations"), ["conv_id"], "turn", label, "label").select("conv_id", "turn", "label")


@register("context_window", """
    SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN contains(text, 'ment') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) near FROM conversations) WHERE near = 1""")
def context_window(spark, sf):
    return sp.context(table(spark, sf, "conversations"), ["conv_id"], "turn", F.contains("text", F.lit("ment"))).select("conv_id", "turn")


@register("question_answers", """
    WITH q AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations)
    SELECT conv_id, question, turn, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, question ORDER BY turn) place FROM q WHERE question IS NOT NULL AND role <> 'user') WHERE place <= 3""")
def question_answers(spark, sf):
    return sp.answers(table(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "question", "turn", "place")


@register("agenda_labels", """
    WITH e AS (SELECT *, last_value(CASE WHEN turn % 3 = 0 THEN left(text, 5) WHEN turn % 5 = 4 THEN '' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) a FROM conversations) SELECT conv_id, turn, nullif(a, '') AS agenda FROM e""")
def agenda_labels(spark, sf):
    opened = F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 5))
    return sp.agenda_labels(table(spark, sf, "conversations"), ["conv_id"], "turn", opened, F.col("turn") % 5 == 4).select("conv_id", "turn", "agenda")


@register("neighbour_articles", """
    WITH d AS (SELECT conv_id, turn, length(text) AS n, contains(text, 'tion') AS p FROM conversations), x AS (SELECT *, max(p::INT) OVER (PARTITION BY conv_id) a, sum(n) FILTER (NOT p) OVER (PARTITION BY conv_id) l,
        greatest(coalesce(lag(p::INT) OVER w, 0), coalesce(lead(p::INT) OVER w, 0)) nx FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) r FROM x WHERE NOT p AND a = 1 AND (l <= 600 OR nx = 1)) SELECT conv_id, turn FROM y WHERE l <= 600 OR r <= 4""")
def neighbour_articles(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("n", F.length("text"))
    return sp.neighbours(rows, "conv_id", "turn", F.contains("text", F.lit("tion")), "n", budget=600).select("conv_id", "turn")


@register("field_aggregate")
def field_aggregate(spark, sf):
    """Map-valued sums; compared with a plain form in the tests (maps have no portable order)."""
    fields = {"law": {"strong": ["tion"], "weak": ["ment"]}, "market": {"strong": ["ung"], "weak": ["der"]}, "net": {"strong": ["que"]}}
    rows = table(spark, sf, "conversations").withColumn("w", sp.field_weights(F.col("text"), fields, "other"))
    out = sp.field_sums(rows, ["role"], "w", F.length("text"))
    return out.select("role", F.to_json("fields").alias("fields"), F.to_json("field_chars").alias("field_chars"))


@register("speech_search", """
    SELECT conv_id, turn, count(*) OVER () AS total FROM conversations WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') AND role = 'assistant' ORDER BY conv_id DESC, turn LIMIT 20""")
def speech_search(spark, sf):
    hit = F.contains(F.lower("text"), F.lit("the")) & F.contains(F.lower("text"), F.lit("ing")) & (F.col("role") == "assistant")
    found = table(spark, sf, "conversations").filter(hit).select("conv_id", "turn")
    return found.orderBy(F.desc("conv_id"), "turn").limit(20).join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))  # one row


@register("trend_score", """
    SELECT conv_id, sum(CASE WHEN turn = 0 THEN 3 WHEN turn = 1 THEN 2 ELSE 1 END)::BIGINT AS score FROM conversations WHERE contains(text, 'ment') OR contains(text, 'ing') GROUP BY conv_id ORDER BY score DESC, conv_id LIMIT 40""")
def trend_score(spark, sf):
    weight = F.when(F.col("turn") == 0, 3).when(F.col("turn") == 1, 2).otherwise(1)
    hits = table(spark, sf, "conversations").filter(F.contains("text", F.lit("ment")) | F.contains("text", F.lit("ing")))
    return hits.groupBy("conv_id").agg(F.sum(weight).alias("score")).orderBy(F.desc("score"), "conv_id").limit(40)


@register("carryover", """
    WITH h AS (SELECT event_id, user_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR AND ts < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AND event_type = 'error')
    SELECT event_id FROM h WHERE value > 10 AND user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AND event_type = 'purchase')""")
def carryover(spark, sf):
    events = table(spark, sf, "events")
    age = (F.unix_micros(clock()) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    briefed = events.filter((age <= 24) & (F.col("event_type") == "purchase")).select("user_id")
    return events.filter((age <= 72) & (age > 24) & (F.col("event_type") == "error") & (F.col("value") > 10)).join(briefed, "user_id", "left_anti").select("event_id")


@register("suppression", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 AND age < 18 THEN 'suppress' WHEN event_id % 4 = 0 AND age < 24 THEN 'suppress' WHEN event_id % 4 = 0 AND coalesce(share, 1) >= 0.5 THEN 'remind' WHEN event_id % 4 = 0 THEN 'hold' ELSE 'pass' END AS action
    FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value END AS age, CASE WHEN event_id % 13 <> 0 THEN (event_id % 10) / 10.0 END AS share FROM events)""")
def suppression(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", F.when(k % 11 != 0, F.col("value")).alias("age"), (k % 3 == 0).alias("kw"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("same"), F.when(k % 13 != 0, (k % 10) / 10.0).alias("share"))
    return cl.suppression(rows, "age", "kw", "same", "share").select("event_id", "action")


@register("issue_ladder", """
    WITH c AS (SELECT o_custkey, count(*) n, count(*) FILTER (o_orderkey % 3 = 0) o, count(DISTINCT o_orderdate) d, count(*) FILTER (o_orderpriority = '1-URGENT') u, max(o_totalprice) / 500000 s, max(o_orderkey % 4)::INT sh FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN o = n THEN 'skip' WHEN o >= 2 AND o * 2 >= n THEN 'assign_overlap' WHEN sh >= 3 OR s >= 0.99 THEN 'assign_match' WHEN o >= 3 OR s >= 0.9 THEN 'judge' WHEN (n >= 5 AND d >= 2) OR (u >= 3 AND d >= 3) THEN 'propose' ELSE 'none' END AS step FROM c""")
def issue_ladder(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("o"), F.count_distinct("o_orderdate").alias("d"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"),
        (F.max("o_totalprice") / 500000).alias("s"), F.max(F.col("o_orderkey") % 4).alias("sh"))
    scaled = F.when(F.col("s") >= 0.99, 0.85).when(F.col("s") >= 0.9, 0.7).otherwise(0.0)
    return c.select("o_custkey", cl.issue_step(F.col("o"), F.col("n"), F.col("o"), F.col("sh"), F.lit(False), scaled, F.col("d"), F.col("u")).alias("step"))


@register("issue_lifecycle", """
    SELECT o_custkey, CASE WHEN i >= 90 AND c >= 30 THEN 'propose_resolve' WHEN i >= 30 THEN 'dormant' ELSE 'active' END AS state FROM (SELECT o_custkey, date_diff('day', max(o_orderdate)::DATE, DATE '2001-08-01') i, date_diff('day', min(o_orderdate)::DATE, DATE '2001-08-01') % 60 c FROM orders GROUP BY 1)""")
def issue_lifecycle(spark, sf):
    day = F.lit("2001-08-01").cast("date")
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.date_diff(day, F.to_date(F.max("o_orderdate"))).alias("i"), (F.date_diff(day, F.to_date(F.min("o_orderdate"))) % 60).alias("c"))
    return rows.select("o_custkey", cl.issue_life(F.col("i"), F.col("i"), F.col("c")).alias("state"))


@register("suppression_chains", """
    WITH RECURSIVE l AS (SELECT event_id AS c, event_id - 1 - event_id % 3 AS p, event_id % 17 = 0 AS j FROM events WHERE event_id % 50 > 3),
    w(c, u, j) AS (SELECT c, p, j FROM l UNION ALL SELECT w.c, l.p, w.j OR l.j FROM w JOIN l ON w.u = l.c)
    SELECT c AS child, u AS rep, j AS judged FROM w WHERE u NOT IN (SELECT c FROM l)""")
def suppression_chains(spark, sf):
    k = F.col("event_id")
    links = table(spark, sf, "events").filter(k % 50 > 3).select(k.alias("child"), (k - 1 - k % 3).alias("parent"), (k % 17 == 0).alias("flag"))
    return cl.representatives(links, "child", "parent", "flag")


TITLES_SQL = r"""
    WITH RECURSIVE p AS (SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
    i AS (SELECT page_id, host, title, list_filter(list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}]{2,}')),
        lambda w: w NOT IN ('the', 'and', 'of', 'to', 'a', 'in', 'is', 'that', 'de', 'la', 'le', 'der', 'die', 'und', 'el', 'los')) AS words,
        row_number() OVER (PARTITION BY host ORDER BY page_id) AS k FROM p)
"""


@register("star_cluster", TITLES_SQL + """
    , walk(host, k, page_id, seeds, seed) AS (
        SELECT host, k, page_id, [{'id': page_id, 'w': words}], page_id FROM i WHERE k = 1
        UNION ALL
        SELECT n.host, n.k, n.page_id, CASE WHEN hit IS NULL THEN n.seeds || [{'id': n.page_id, 'w': n.words}] ELSE n.seeds END, coalesce(hit, n.page_id)
        FROM (SELECT w.host, w.k + 1 AS k, w.seeds, i.page_id, i.words, list_filter(w.seeds, lambda s: len(list_intersect(s.w, i.words)) >= 2)[1].id AS hit FROM walk w JOIN i ON i.host = w.host AND i.k = w.k + 1) n)
    SELECT host, page_id, seed AS seed_id FROM walk""")
def star_cluster(spark, sf):
    """Star clusters of page titles by host; the twin walks page by page."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    items = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"https?://([^/]+)", 1).alias("host"), tx.tokens(title).alias("tokens"))
    return cl.star_clusters(items, ["host"], "page_id", "page_id", "tokens", 2)


@register("event_groups")
def event_groups(spark, sf):
    """Groups of one event (sequential; held against plain Python over whole pages in the tests)."""
    title, heading = (F.regexp_extract("html", f"(?s)<{t}>(.*?)</{t}>", 1) for t in ("title", "h1"))
    words = F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    tags = F.when(F.col("page_id") % 3 != 0, F.array((F.col("page_id") % 2).cast("string")))
    label = F.when(F.col("page_id") % 4 != 0, heading)
    items = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"https?://([^/]+)", 1).alias("host"), label.alias("event"), words.alias("words"), tags.alias("tags"))
    return cl.event_groups(items, ["host"], "page_id", "page_id", "event", "words", "tags")


ALERTS_SQL = """
    WITH RECURSIVE t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, TIMESTAMP '2026-01-10' - INTERVAL (page_id % 80) HOUR AS seen FROM pages),
    tok AS (SELECT page_id, title, seen, list_distinct(regexp_extract_all(lower(title || ' ' || h1), '[a-zà-ÿ]{2,}')) AS w FROM t WHERE title <> ''),
    items AS (SELECT page_id AS item, title, seen, w FROM tok WHERE page_id % 10 = 1),
    hist AS (SELECT title, seen, w FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY seen DESC) r FROM tok WHERE page_id % 10 <> 1) WHERE r = 1),
    sup AS (SELECT title AS child, any_value(parent ORDER BY page_id) AS parent, any_value(j ORDER BY page_id) AS j FROM (SELECT a.page_id, a.title, b.title AS parent, a.page_id % 20 = 4 AS j FROM tok a JOIN tok b ON b.page_id = a.page_id - 2 WHERE a.page_id % 10 IN (4, 6) AND a.title <> b.title AND a.title > b.title) GROUP BY title),
    walk(child, u, j) AS (SELECT child, parent, j FROM sup UNION ALL SELECT w.child, s.parent, w.j OR s.j FROM walk w JOIN sup s ON w.u = s.child),
    chain AS (SELECT child, u AS rep, j FROM walk WHERE u NOT IN (SELECT child FROM sup)),
    rep AS (SELECT h.title, h.seen, h.w, coalesce(c.rep, h.title) AS rep, coalesce(c.j, false) AS j, c.rep IS NOT NULL AS down FROM hist h LEFT JOIN chain c ON h.title = c.child),
    rep2 AS (SELECT r.*, a.seen AS rep_at FROM rep r LEFT JOIN hist a ON r.rep = a.title),
    m AS (SELECT i.item, r.title, r.rep, r.rep_at, row_number() OVER (PARTITION BY i.item ORDER BY r.seen DESC, r.title) k FROM items i JOIN rep2 r ON NOT r.j AND len(list_intersect(i.w, r.w)) >= 3
          WHERE NOT (contains(i.title, 'tion') AND NOT contains(r.title, 'tion'))),
    v AS (SELECT i.item, r.title, r.rep_at AS seen, r.w FROM items i JOIN tok x ON x.page_id = i.item + 1 JOIN rep2 r ON r.title = x.title AND NOT r.down WHERE i.item % 20 = 1),
    a AS (SELECT i.item, i.title, i.seen, i.w, m.title AS kw_title, m.rep AS kw_rep, v.title AS v_title, v.w AS v_w, coalesce(date_diff('microsecond', m.rep_at, TIMESTAMP '2026-01-10') / 3.6e9 < 18, false) AS kw,
                 date_diff('microsecond', v.seen, TIMESTAMP '2026-01-10') / 3.6e9 AS age FROM items i LEFT JOIN m ON i.item = m.item AND m.k = 1 LEFT JOIN v ON i.item = v.item),
    share AS (SELECT a.item, count(*) FILTER (x.page_id % 3 = 0) / count(*) AS share FROM a JOIN tok x ON len(list_intersect(a.w, x.w)) >= 3 OR len(list_intersect(a.v_w, x.w)) >= 3 WHERE NOT kw AND v_title IS NOT NULL GROUP BY a.item),
    acted AS (SELECT a.*, CASE WHEN kw THEN 'suppress' WHEN v_title IS NULL THEN 'pass' WHEN age < 24 THEN 'suppress' WHEN coalesce(share, 1) >= 0.5 THEN 'remind' ELSE 'hold' END AS action,
                     CASE WHEN kw THEN kw_title ELSE v_title END AS matched FROM a LEFT JOIN share USING (item)),
    out AS (SELECT *, row_number() OVER (ORDER BY seen, item) AS k FROM acted WHERE action IN ('pass', 'remind')),
    star(k, item, seeds, seed) AS (
        SELECT k, item, [{'id': item, 'w': w}], item FROM out WHERE k = 1
        UNION ALL
        SELECT n.k, n.item, CASE WHEN hit IS NULL THEN seeds || [{'id': n.item, 'w': n.w}] ELSE seeds END, coalesce(hit, n.item)
        FROM (SELECT s.seeds, o.k, o.item, o.w, list_filter(seeds, lambda s: len(list_intersect(s.w, o.w)) >= 3)[1].id AS hit FROM star s JOIN out o ON o.k = s.k + 1) n),
    f AS (SELECT a.item, a.action, a.matched, a.kw, a.kw_rep, s.seed, h.title AS head, max(CASE WHEN a.action = 'remind' THEN 1 END) OVER (PARTITION BY s.seed) AS passed_on FROM acted a LEFT JOIN star s USING (item) LEFT JOIN items h ON h.item = s.seed)
    SELECT item, CASE WHEN seed <> item THEN 'merge' WHEN seed IS NOT NULL AND passed_on = 1 THEN 'remind' ELSE action END AS action,
           CASE WHEN seed <> item THEN head ELSE matched END AS matched, CASE WHEN seed <> item THEN head WHEN kw THEN kw_rep ELSE matched END AS rep FROM f
"""


@register("repeat_alerts", ALERTS_SQL)
def repeat_alerts(spark, sf):
    """New alerts against three days of reports: history, chains, verdicts, shares and stars; every tenth page is an alert
    (that is the role it plays), all others are reports."""
    k = F.col("page_id")
    title, h1 = (F.regexp_extract("html", f"(?s)<{t}>(.*?)</{t}>", 1) for t in ("title", "h1"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-10 00:00:00")) - (k % 80) * 3600)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat(title, F.lit(" "), h1)), F.lit("[a-zà-ÿ]{2,}"), F.lit(0)))
    tok = table(spark, sf, "pages").select("page_id", title.alias("title"), at.alias("at"), words.alias("tokens")).filter("title != ''")
    items = tok.filter(k % 10 == 1).select(k.alias("item"), "title", "at", "tokens")
    parents = tok.select((k + 2).alias("page_id"), F.col("title").alias("parent"))
    links = tok.filter((k % 10).isin(4, 6)).join(parents, "page_id").filter((F.col("title") != F.col("parent")) & (F.col("title") > F.col("parent")))
    links = links.groupBy(F.col("title").alias("child")).agg(F.min_by("parent", "page_id").alias("parent"), F.min_by(k % 20 == 4, "page_id").alias("judged"))
    told = items.filter("item % 20 = 1").join(tok.select((k - 1).alias("item"), F.col("title").alias("matched")), "item").select("item", "matched")
    window = tok.select("title", "tokens", (k % 3 == 0).alias("kept"))
    return cl.repeat_alerts(items, tok.filter(k % 10 != 1), links, window, told, F.lit("2026-01-10").cast("timestamp"), ["tion"])
