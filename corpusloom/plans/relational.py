"""Keyed tables, versions, listings and rules over the star schema and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import rules as ru
from corpusloom.operators import tables as tb
from corpusloom.plans.registry import register
from corpusloom.session import table

TODAY = "1998-06-01"


def today():
    return F.lit(TODAY).cast("timestamp")


@register("latest_order_per_customer", """
    SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders)
    WHERE r = 1 AND o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 180 DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def latest_order_per_customer(spark, sf):
    latest = tb.first_per(table(spark, sf, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return latest.filter(F.col("o_orderdate") >= today() - F.expr("INTERVAL 180 DAY")).select("o_custkey", "o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)


@register("in_force_version", """
    SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
        (o_orderdate <= TIMESTAMP '1998-06-01') DESC, CASE WHEN o_orderdate <= TIMESTAMP '1998-06-01' THEN -epoch(o_orderdate) ELSE epoch(o_orderdate) END, o_orderkey DESC) r FROM orders) WHERE r = 1""")
def in_force_version(spark, sf):
    return tb.in_force(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", today(), "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@register("pending_versions", """
    SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01' GROUP BY ALL""")
def pending_versions(spark, sf):
    return tb.pending(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", today()).select("o_custkey", "o_orderdate", "o_orderkey")


@register("promotion_states", """
    SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1998-06-01' THEN 'pending' WHEN row_number() OVER (PARTITION BY o_custkey, o_orderdate <= TIMESTAMP '1998-06-01'
        ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'current' ELSE 'superseded' END AS state FROM orders""")
def promotion_states(spark, sf):
    return tb.promotion(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", today()).select("o_orderkey", "state")


@register("version_noop_removal", """
    SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) was FROM orders)
    WHERE o_orderstatus IS DISTINCT FROM was""")
def version_noop_removal(spark, sf):
    return tb.drop_noops(table(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], F.col("o_orderstatus")).select("o_custkey", "o_orderkey", "o_orderstatus")


@register("article_diff", r"""
    WITH a AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 13 = 0 THEN '제3조 삭제' ELSE o_orderpriority END t FROM orders WHERE o_orderkey % 3 <> 0),
         b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 26 = 0 THEN ' 제3조의2(목적) 삭제 <2024>' WHEN o_orderkey % 7 = 0 THEN o_orderpriority || o_orderstatus ELSE replace(o_orderpriority, ' ', '  ') END t FROM orders WHERE o_orderkey % 5 <> 0),
         f AS (SELECT coalesce(a.k, b.k) k, a.t o, b.t n, regexp_matches(trim(a.t), '^제\s*[0-9]+조(의[0-9]+)?(\([^)]*\))?\s*삭제') od, regexp_matches(trim(b.t), '^제\s*[0-9]+조(의[0-9]+)?(\([^)]*\))?\s*삭제') nd FROM a FULL JOIN b ON a.k = b.k)
    SELECT k AS o_orderkey, change, coalesce(o, '') AS old_text, coalesce(n, '') AS new_text FROM (
        SELECT *, CASE WHEN n IS NULL THEN 'deleted' WHEN o IS NULL THEN CASE WHEN nd THEN 'deleted' ELSE 'added' END WHEN nd AND NOT od THEN 'deleted'
                       WHEN regexp_replace(o, '\s+', '', 'g') <> regexp_replace(n, '\s+', '', 'g') THEN 'modified' END change FROM f) WHERE change IS NOT NULL""")
def article_diff(spark, sf):
    orders = table(spark, sf, "orders")
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    old = orders.filter(k % 3 != 0).select("o_orderkey", F.when(k % 13 == 0, "제3조 삭제").otherwise(p).alias("t"))
    gone = (k % 11 == 0) | (k % 26 == 0)
    new = orders.filter(k % 5 != 0).select("o_orderkey", F.when(gone, " 제3조의2(목적) 삭제 <2024>").when(k % 7 == 0, F.concat(p, "o_orderstatus")).otherwise(F.replace(p, F.lit(" "), F.lit("  "))).alias("t"))
    return tb.keyed_diff(old, new, ["o_orderkey"], "t")


@register("doc_listing", """
    SELECT source, count(*) AS docs, count(*) FILTER (n_chars > 2000) AS long_docs, min(doc_id) AS first_id, max(n_chars) AS most_chars, bool_and(n_chars > 0) AS all_filled,
           bool_or(lang IS DISTINCT FROM 'en') AS any_foreign FROM documents GROUP BY source""")
def doc_listing(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n_chars") > 2000).alias("long_docs"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("most_chars"),
        F.bool_and(F.col("n_chars") > 0).alias("all_filled"), F.bool_or(~F.col("lang").eqNullSafe("en")).alias("any_foreign"))


@register("guide_listing", """
    SELECT n_nationkey, n_name, coalesce(c, 0)::BIGINT AS suppliers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) c FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey""")
def guide_listing(spark, sf):
    counts = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("c"))
    return table(spark, sf, "nation").join(counts, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("c", F.lit(0)).alias("suppliers"))


@register("quality_low_docs", """
    SELECT doc_id, lang, n_chars FROM documents d WHERE n_chars < CASE lang WHEN 'en' THEN 800 WHEN 'de' THEN 300 ELSE 2000 END AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
    ORDER BY n_chars, doc_id LIMIT 15""")
def quality_low_docs(spark, sf):
    least = F.when(F.col("lang") == "en", 800).when(F.col("lang") == "de", 300).otherwise(2000)
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf, "documents").filter(F.col("n_chars") < least).join(good, "doc_id", "left_anti").select("doc_id", "lang", "n_chars").orderBy("n_chars", "doc_id").limit(15)


@register("quality_parse_rate", """
    SELECT source, count(*) AS n, round(100.0 * count(*) FILTER (text LIKE '%.%') / count(*), 1)::DOUBLE AS rate FROM documents GROUP BY source HAVING count(*) >= 3""")
def quality_parse_rate(spark, sf):
    out = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("text", F.lit("."))).alias("k"))
    return out.filter("n >= 3").select("source", "n", F.round(100.0 * F.col("k") / F.col("n"), 1).cast("double").alias("rate"))


@register("known_items", """
    WITH s AS (SELECT * FROM pages WHERE page_id % 3 = 0), c AS (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) t FROM pages), st AS (SELECT url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) t FROM s)
    SELECT * FROM (SELECT page_id, CASE WHEN url IN (SELECT url FROM st) THEN 'url' WHEN t IN (SELECT t FROM st) THEN 'title' END AS known_by FROM c) WHERE known_by IS NOT NULL""")
def known_items(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("t"))
    return tb.known(pages, pages.filter("page_id % 3 = 0"), "url", "t").select("page_id", "known_by")


@register("ack_exclusion", """
    SELECT event_id, user_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND a.user_id = e.user_id AND a.value > 60)""")
def ack_exclusion(spark, sf):
    events = table(spark, sf, "events")
    acks = events.filter("event_type = 'purchase' and value > 60").select("user_id")
    return events.filter("event_type = 'error'").join(acks, "user_id", "left_anti").select("event_id", "user_id")


@register("category_ladder", """
    SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%nut%' THEN 'small' WHEN p_name LIKE '%red%' THEN 'colour' ELSE 'other' END AS category FROM part""")
def category_ladder(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ru.category(F.col("p_name"), [("small", ["ring", "nut"]), ("colour", ["red"])], "other").alias("category"))


@register("tag_filter_fail_open", """
    SELECT p_partkey FROM part WHERE p_size % 4 = 0 OR p_type = 'NONE' OR list_has_any([p_type, p_brand], ['ECONOMY', 'Brand#17'])""")
def tag_filter_fail_open(spark, sf):
    wanted = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("ECONOMY"), F.lit("Brand#17")))
    tags = F.when(F.col("p_type") == "NONE", F.array().cast("array<string>")).otherwise(F.array("p_type", "p_brand"))
    return table(spark, sf, "part").filter(ru.tag_match(tags, wanted)).select("p_partkey")


#: id, position, mode, level, any_words, and_any, none_words, enabled
RULES = [
    ("r1", 3, "min", "normal", ["the"], [["and", "und"]], [], True),
    ("r2", 1, "set", "urgent", ["tion"], [["ing", "ble"], ["that", "was"]], ["###", "!!"], True),
    ("r3", 2, "min", "urgent", ["der"], [], ["@"], True),
    ("r4", 0, "set", "reference", ["the"], [], [], False),
    ("r5", 4, "set", "reference", [], [], [], True),
]
RULE_SCHEMA = "id string, position int, mode string, level string, any_words array<string>, and_any array<array<string>>, none_words array<string>, enabled boolean"
RULE_SQL = """
    WITH hit AS (SELECT doc_id, n_chars, CASE
        WHEN contains(text, 'tion') AND (contains(text, 'ing') OR contains(text, 'ble')) AND (contains(text, 'that') OR contains(text, 'was')) AND NOT contains(text, '###') AND NOT contains(text, '!!') THEN 'r2'
        WHEN contains(text, 'der') AND NOT contains(text, '@') THEN 'r3' WHEN contains(text, 'the') AND (contains(text, 'and') OR contains(text, 'und')) THEN 'r1' END AS rule_id,
        CASE WHEN n_chars > 3000 THEN 2 WHEN n_chars > 800 THEN 1 ELSE 0 END AS common FROM documents),
    lv AS (SELECT *, CASE rule_id WHEN 'r2' THEN 2 WHEN 'r3' THEN greatest(2, common) WHEN 'r1' THEN greatest(1, common) ELSE common END AS own FROM hit)
"""


def ruled(spark, sf):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    common = F.when(F.col("n_chars") > 3000, "urgent").when(F.col("n_chars") > 800, "normal").otherwise("reference")
    out = ru.first_rule(docs, "text", "doc_id", rules).withColumn("common", common)
    return out.withColumn("own", ru.combined(F.col("rule_mode"), F.col("rule_level"), F.col("common")))


@register("rule_first_match", RULE_SQL + "SELECT doc_id, rule_id, own::INT AS own FROM lv")
def rule_first_match(spark, sf):
    return ruled(spark, sf).select("doc_id", "rule_id", "own")


@register("rule_table_match", r"""
    WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(text, '[^\s.,]+')) AS w FROM benchmark),
    r AS (SELECT item_id, list_filter(w, lambda x: length(x) >= 8) AS any_words, list_filter(w, lambda x: length(x) = 3) AS three, list_filter(w, lambda x: length(x) = 7) AS none FROM w),
    m AS (SELECT doc_id, min(item_id) AS rule FROM documents, r WHERE len(list_filter(any_words, lambda x: contains(text, x))) > 0 AND len(list_filter(three, lambda x: contains(text, x))) > 0 AND len(list_filter(none, lambda x: contains(text, x))) = 0 GROUP BY 1)
    SELECT doc_id, rule::VARCHAR AS rule_id, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule % 2 = 0 THEN 'set' ELSE 'min' END END AS rule_mode FROM documents LEFT JOIN m USING (doc_id)""")
def rule_table_match(spark, sf):
    """A rule for each benchmark item, of its own words, by the automaton and in blocks of a few."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\s.,]+"), F.lit(0)))
    of = lambda test: F.filter("w", lambda x: test(F.length(x)))
    k = F.col("item_id")
    rules = table(spark, sf, "benchmark").select(k, words.alias("w")).select(
        F.lit(True).alias("enabled"), k.alias("position"), k.cast("string").alias("id"), F.when(k % 2 == 0, "set").otherwise("min").alias("mode"), F.lit("urgent").alias("level"),
        of(lambda n: n >= 8).alias("any_words"), F.array(of(lambda n: n == 3)).alias("and_any"), of(lambda n: n == 7).alias("none_words"))
    out = ru.first_rule(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id", rules, inline=0, block=16)
    return out.select("doc_id", "rule_id", "rule_mode")


@register("team_override", RULE_SQL + """
    SELECT doc_id, eff::INT AS eff, (CASE WHEN doc_id % 6 IN (0, 4) THEN least(eff, common) ELSE eff END)::INT AS alert FROM (
        SELECT doc_id, common, CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN rule_id = 'r2' OR rule_id = 'r1' THEN own ELSE common END WHEN 3 THEN 1 ELSE common END AS eff FROM lv)""")
def team_override(spark, sf):
    """Six kinds of rows: people, rules (r3 is another team's), none, a model, and people and models with unknown levels."""
    k = F.col("doc_id") % 6
    source = F.when(k.isin(0, 4), "human").when(k == 1, "rule").when(k.isin(3, 5), "ai")
    stored = F.when(k == 0, "reference").when(k == 3, "normal").when(k.isin(4, 5), "high")
    now = ru.recomputed(F.when(F.col("rule_id") == "r3", 9).otherwise(1), F.lit(1), F.col("rule_id").isNotNull(), F.col("rule_mode"), F.col("rule_level"), F.col("common"))
    out = ruled(spark, sf).withColumn("eff", ru.effective(source, stored, now, F.col("common")))
    return out.select("doc_id", F.col("eff"), ru.alert_rank(source, F.col("eff"), F.col("common")).alias("alert"))


@register("division_level", """
    SELECT o_custkey, max(o_orderkey % 3)::INT AS top, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderkey % 3 = m)) AS teams
    FROM (SELECT *, max(o_orderkey % 3) OVER (PARTITION BY o_custkey) m FROM orders) GROUP BY o_custkey""")
def division_level(spark, sf):
    ranks = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max(F.col("o_orderkey") % 3).cast("int").alias("r"))
    return ru.division(ranks, ["o_custkey"], "o_orderpriority", "r")


@register("sentence_rules", """
    WITH c AS (SELECT doc_id % 300 AS item, (doc_id % 7)::INT AS position, 'q' || (doc_id % 7) AS rule_id, doc_id % 2 = 0 AS is_sentence, CASE WHEN doc_id % 5 < 2 THEN NULL ELSE doc_id % 3 = 0 END AS verdict FROM documents),
    d AS (SELECT item, min({'p': position, 'r': rule_id}) AS hit FROM c WHERE NOT is_sentence OR coalesce(verdict, false) GROUP BY item)
    SELECT c.item, any_value(hit.r) AS rule_id, coalesce(list_transform(list_sort(list({'p': position, 'r': c.rule_id}) FILTER (is_sentence AND verdict IS NULL AND (hit IS NULL OR position < hit.p))), lambda x: x.r), []) AS ask
    FROM c LEFT JOIN d ON c.item = d.item GROUP BY c.item""")
def sentence_rules(spark, sf):
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").select((k % 300).alias("item"), (k % 7).cast("int").alias("position"), F.concat(F.lit("q"), k % 7).alias("rule_id"), (k % 2 == 0).alias("is_sentence"), F.when(k % 5 < 2, None).otherwise(k % 3 == 0).alias("verdict"))
    return ru.sentence_decision(rows, "item")


@register("rule_faults", """
    WITH r AS (SELECT 'q' || (p_partkey % 900) AS id, CASE p_partkey % 4 WHEN 0 THEN 'sat' WHEN 1 THEN 'min' ELSE 'set' END AS mode, CASE WHEN p_size > 48 THEN 'high' ELSE 'normal' END AS level, CASE WHEN p_size % 9 = 0 THEN []::VARCHAR[] ELSE [p_type] END AS any_words, CASE WHEN p_size % 7 = 0 THEN [[]::VARCHAR[]] ELSE [[p_brand]] END AS and_any FROM part)
    SELECT id, fault FROM (SELECT id, unnest([CASE WHEN len(any_words) = 0 THEN 'no any_words' END, CASE WHEN mode NOT IN ('min', 'set') THEN 'mode' END, CASE WHEN level = 'high' THEN 'level' END, CASE WHEN len(and_any[1]) = 0 THEN 'empty group' END]) AS fault FROM r) WHERE fault IS NOT NULL
    UNION ALL SELECT id, 'duplicate id' FROM r GROUP BY id HAVING count(*) > 1""")
def rule_faults(spark, sf):
    p = table(spark, sf, "part")
    none = F.array().cast("array<string>")
    rules = p.select(
        F.concat(F.lit("q"), F.col("p_partkey") % 900).alias("id"), F.when(F.col("p_partkey") % 4 == 0, "sat").when(F.col("p_partkey") % 4 == 1, "min").otherwise("set").alias("mode"),
        F.when(F.col("p_size") > 48, "high").otherwise("normal").alias("level"), F.when(F.col("p_size") % 9 == 0, none).otherwise(F.array("p_type")).alias("any_words"),
        F.when(F.col("p_size") % 7 == 0, F.array(none)).otherwise(F.array(F.array("p_brand"))).alias("and_any"))
    return ru.faults(rules)


@register("vote_combination", """
    WITH v AS (SELECT o_custkey, list_sort(list((o_orderkey % 3)::INT) FILTER (o_orderkey % 5 <> 0)) AS s, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN n = 1 THEN s[1] WHEN coalesce(len(s), 0) < 2 THEN NULL WHEN len(s) = 2 THEN CASE WHEN s[1] = s[2] THEN s[1] END WHEN len(s) = 3 THEN s[2] ELSE
        (SELECT x FROM (SELECT unnest(s) x) GROUP BY x ORDER BY count(*) DESC, x LIMIT 1) END AS vote FROM v""")
def vote_combination(spark, sf):
    """Votes with nulls in place: collect_list would leave them out."""
    v = F.struct(F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 3).cast("int")).alias("v"))
    votes = F.transform("s", lambda x: x["v"])
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(v).alias("s")).select("o_custkey", ru.combined_votes(votes).alias("vote"))


@register("numeric_key_sort", """
    SELECT ref, row_number() OVER (ORDER BY n, b, ref) AS place FROM (SELECT DISTINCT n, b, CASE WHEN b = 0 THEN n::VARCHAR ELSE n || '-' || b END AS ref FROM (SELECT o_orderkey % 60 AS n, o_custkey % 4 AS b FROM orders))""")
def numeric_key_sort(spark, sf):
    n, b = (F.col("o_orderkey") % 60).cast("string"), (F.col("o_custkey") % 4).cast("string")
    raw = F.when(b == "0", F.concat(F.lit("제"), n, F.lit("조"))).otherwise(F.concat(n, F.lit("조의"), b))
    keys = table(spark, sf, "orders").select(tx.article_key(raw).alias("ref")).distinct()  # at most 240 keys
    from pyspark.sql import Window as W

    return keys.withColumn("place", F.row_number().over(W.orderBy(*tx.article_order(F.col("ref")), "ref")))


@register("briefing_priority", """
    SELECT p_partkey, related >= 10 AS promoted FROM (SELECT p.*, count(*) OVER (PARTITION BY p_brand, p_type) AS related FROM part p)
    ORDER BY promoted DESC, p_size DESC, p_retailprice DESC, p_partkey LIMIT 40""")
def briefing_priority(spark, sf):
    part = table(spark, sf, "part")
    related = part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("related"))
    out = part.join(related, ["p_brand", "p_type"]).withColumn("promoted", F.col("related") >= 10)
    return out.orderBy(F.desc("promoted"), F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(40).select("p_partkey", "promoted")


@register("upsert_ignore", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 GROUP BY 1")
def upsert_ignore(spark, sf):
    orders = table(spark, sf, "orders")
    return tb.insert_absent(orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 3 = 0"), ["o_orderkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@register("replace_groups", """
    SELECT conv_id, count(*) AS n, sum(turn)::BIGINT AS turns FROM conversations WHERE conv_id % 4 <> 0 OR turn < 2 GROUP BY conv_id""")
def replace_groups(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn")
    return tb.replace_groups(conv, conv.filter("conv_id % 4 = 0 and turn < 2"), ["conv_id"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("turn").alias("turns"))


@register("retention", """
    SELECT event_id FROM events, (SELECT max(ts) m FROM events) WHERE ts >= m - INTERVAL 20 DAY OR event_type = 'purchase'""")
def retention(spark, sf):
    events = table(spark, sf, "events")
    clock = events.agg(F.max("ts").alias("m"))
    return tb.retain(events.join(F.broadcast(clock)), F.col("ts"), F.col("m"), 20, F.col("event_type") == "purchase").select("event_id")  # one row


@register("prune_stale", "SELECT event_id FROM (SELECT *, max(ts::DATE) OVER (PARTITION BY user_id) m FROM events) WHERE ts::DATE = m")
def prune_stale(spark, sf):
    return tb.prune_stale(table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["user_id"], "day").select("event_id")


@register("renumber", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations WHERE role <> 'system'")
def renumber(spark, sf):
    return tb.renumber(table(spark, sf, "conversations").filter("role != 'system'"), ["conv_id"], [F.asc("turn")], "idx").select("conv_id", "turn", "idx")


@register("chunk_ledger", """
    SELECT conv_id, count(*) AS chunks, min(turn) AS first_index, max(turn) AS last_index, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS complete FROM conversations GROUP BY conv_id""")
def chunk_ledger(spark, sf):
    return tb.chunk_ledger(table(spark, sf, "conversations"), "conv_id", "turn")


@register("sentence_revisions", """
    SELECT o_orderkey, sum(ch) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS revision FROM (
        SELECT *, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) THEN 1 ELSE 0 END AS ch FROM orders)""")
def sentence_revisions(spark, sf):
    return tb.revisions(table(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], F.col("o_orderstatus")).select("o_orderkey", "revision")


@register("change_detection", """
    WITH s AS (SELECT c_custkey k, c_mktsegment st, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END f FROM customer WHERE c_custkey % 5 <> 0),
         n AS (SELECT c_custkey k, CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END st, 'filled' f FROM customer WHERE c_custkey % 7 <> 0)
    SELECT coalesce(s.k, n.k) AS c_custkey, CASE WHEN s.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'gone' WHEN s.st IS DISTINCT FROM n.st THEN 'status_changed' ELSE 'unchanged' END AS what,
           coalesce(n.st, s.st) AS status, list_sort(list_distinct([x FOR x IN [s.st, n.st] IF x IS NOT NULL])) AS tags, coalesce(nullif(s.f, ''), n.f) AS fill
    FROM s FULL JOIN n ON s.k = n.k""")
def change_detection(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    stored = c.filter(k % 5 != 0).select("c_custkey", F.col("c_mktsegment").alias("status"), F.array("c_mktsegment").alias("tags"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("fill"))
    status = F.when(k % 4 == 0, "X").otherwise(F.col("c_mktsegment"))
    seen = c.filter(k % 7 != 0).select("c_custkey", status.alias("status"), F.array(status).alias("tags"), F.lit("filled").alias("fill"))
    return tb.changes(stored, seen, ["c_custkey"], "status", "tags", "fill")


@register("name_resolution", """
    SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN 'moved' END AS resolved, CASE n_nationkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'loose' WHEN 2 THEN 'renamed' END AS how FROM nation""")
def name_resolution(spark, sf):
    nation, k = table(spark, sf, "nation"), F.col("n_nationkey")
    asked = nation.select("n_nationkey", F.when(k % 4 == 0, F.concat(F.lit(" "), "n_name")).when(k % 4 == 1, F.concat("n_name", F.lit(" Act"))).when(k % 4 == 2, F.lit("Old Name")).otherwise(F.lit("nobody")).alias("q"))
    renamed = spark.createDataFrame([("OldName", "moved")], "old string, new string")
    return tb.resolve_names(asked, "q", nation.select(F.col("n_name").alias("name")), renamed).select("n_nationkey", "resolved", "how")


@register("inner_join_rollup", """
    SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def inner_join_rollup(spark, sf):
    out = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("semi_join", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def semi_join(spark, sf):
    return table(spark, sf, "part").join(table(spark, sf, "lineitem").filter("l_quantity >= 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@register("three_way_key_join", """
    SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE regexp_replace(p_brand, '[^0-9]', '', 'g') = (s_nationkey::VARCHAR)""")
def three_way_key_join(spark, sf):
    out = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.regexp_replace("p_brand", "[^0-9]", "") == F.col("s_nationkey").cast("string")))
    return out.select("l_orderkey", "l_linenumber", "p_name", "s_name")


@register("reassembly", "SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def reassembly(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.length("text")).alias("t"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.array_join("p.t", "|").alias("body"))


@register("json_export", """
    SELECT n_regionkey, '[' || string_agg('{"k":' || n_nationkey || ',"n":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS body, count(*) AS n FROM nation GROUP BY n_regionkey""")
def json_export(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(rows).alias("body"), F.count(F.lit(1)).alias("n"))


@register("distinct_and_mode", """
    SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities, count(DISTINCT o_orderdate) AS days,
           (SELECT o_orderstatus FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_status FROM orders o GROUP BY o_custkey""")
def distinct_and_mode(spark, sf):
    orders = table(spark, sf, "orders")
    status = orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("c"))
    top = status.groupBy("o_custkey").agg(F.min(F.struct((-F.col("c")).alias("c"), "o_orderstatus")).alias("m")).select("o_custkey", F.col("m.o_orderstatus").alias("top_status"))
    out = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), F.count_distinct("o_orderdate").alias("days"))
    return out.join(top, "o_custkey")


@register("json_fields", "SELECT event_type, sum(CAST(props::JSON->>'k' AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type")
def json_fields(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(F.lit(1)).alias("n"))


@register("set_operations", "SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount = 0 UNION ALL SELECT p_partkey FROM part WHERE p_size = 1")
def set_operations(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.filter("l_quantity > 45").select("l_partkey").distinct().join(line.filter("l_discount = 0").select("l_partkey"), "l_partkey", "left_anti").unionAll(table(spark, sf, "part").filter("p_size = 1").select("p_partkey"))


@register("grading_agreement", """
    SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_known, count(DISTINCT o_orderstatus) > 1 AS gray,
           coalesce(max(o_orderstatus) FILTER (o_orderpriority = '1-URGENT'), CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END) AS answer FROM orders GROUP BY o_custkey""")
def grading_agreement(spark, sf):
    from corpusloom.operators.grading import agreement

    return agreement(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority", "1-URGENT")


@register("stratified_sample", """
    WITH q(s, n) AS (VALUES ('en', 6), ('de', 4), ('fr', 6), ('es', 4)), d AS (SELECT doc_id, lang, sha256('7:' || doc_id) AS h FROM documents),
    r AS (SELECT d.*, row_number() OVER (PARTITION BY lang ORDER BY h) AS place, coalesce(n, 0) AS n FROM d LEFT JOIN q ON s = lang),
    p AS (SELECT *, place <= n AS own FROM r WHERE place <= 20), x AS (SELECT *, count(*) FILTER (own) OVER () AS k, row_number() OVER (PARTITION BY own ORDER BY h) AS e FROM p)
    SELECT doc_id, lang, place::INT AS place, NOT own AS borrowed FROM x WHERE own OR e <= 20 - k""")
def stratified_sample(spark, sf):
    from corpusloom.operators.grading import stratified

    return stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 6, "de": 4, "fr": 6, "es": 4}, 7)
