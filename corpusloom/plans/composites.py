"""Composite queries: issues, briefings, watched versions, parsers, and what search and grading need beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import parsers as pr
from corpusloom.operators import briefing as br
from corpusloom.operators import events as ev
from corpusloom.operators import graph as gr
from corpusloom.operators import index as ix
from corpusloom.operators import issues as iss
from corpusloom.operators import questions as qs
from corpusloom.operators import rules as ru
from corpusloom.operators import search as se
from corpusloom.operators import speech as sp
from corpusloom.operators import tables as tb
from corpusloom.plans.registry import register
from corpusloom.plans.retrieval import CHUNKS_SQL, chunks
from corpusloom.session import checkpoint_dir, table

CLOCK = "2026-01-10 00:00:00"


def clock():
    return F.lit(CLOCK).cast("timestamp")


PAGES_SQL = r"""
    p AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, TIMESTAMP '2026-01-10' - INTERVAL (page_id % 240) HOUR AS seen,
          CASE page_id % 3 WHEN 0 THEN 'urgent' WHEN 1 THEN 'normal' ELSE 'reference' END AS level FROM pages),
    t AS (SELECT *, list_distinct(regexp_extract_all(lower(title || ' ' || h1), '[a-zà-ÿ]{2,}')) AS w FROM p)
"""


def news(spark, sf):
    """Pages as news: title, instant, level and words, made from the id and the page's title and heading."""
    k = F.col("page_id")
    title, h1 = (F.regexp_extract("html", f"(?s)<{t}>(.*?)</{t}>", 1) for t in ("title", "h1"))
    return table(spark, sf, "pages").select(
        "page_id", title.alias("title"), h1.alias("h1"), F.timestamp_seconds(F.unix_timestamp(F.lit(CLOCK)) - (k % 240) * 3600).alias("at"),
        F.when(k % 3 == 0, "urgent").when(k % 3 == 1, "normal").otherwise("reference").alias("level"),
        F.array_distinct(F.regexp_extract_all(F.lower(F.concat(title, F.lit(" "), h1)), F.lit("[a-zà-ÿ]{2,}"), F.lit(0))).alias("w"))


def _walk(source: str, least: int) -> str:
    """Stars of the rows of source (k from 1, id, w), walked one by one."""
    return f"""
    star(k, id, seeds, seed) AS (
        SELECT k, id, [{{'id': id, 'w': w}}], id FROM {source} WHERE k = 1
        UNION ALL
        SELECT n.k, n.id, CASE WHEN hit IS NULL THEN seeds || [{{'id': n.id, 'w': n.w}}] ELSE seeds END, coalesce(hit, n.id)
        FROM (SELECT s.seeds, o.k, o.id, o.w, list_filter(s.seeds, lambda s: len(list_intersect(s.w, o.w)) >= {least})[1].id AS hit FROM star s JOIN {source} o ON o.k = s.k + 1) n)
"""


@register("issue_candidates", "WITH RECURSIVE " + PAGES_SQL + """
    , c AS (SELECT page_id AS id, w, row_number() OVER (ORDER BY seen DESC, page_id) AS k FROM t WHERE seen >= TIMESTAMP '2026-01-10' - INTERVAL 7 DAY AND level <> 'reference' AND NOT regexp_matches(title, 'Th|soc')), """ + _walk("c", 3) + """
    SELECT id AS page_id, seed AS seed_id FROM star""")
def issue_candidates(spark, sf):
    """A week of news of the upper levels; the pattern of digests fits the pages' language."""
    return iss.candidate_clusters(news(spark, sf), "page_id", "at", "level", "title", "w", clock(), digest="Th|soc")


@register("issue_best_match", """
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 8 = 0 THEN '' ELSE 'k' || (vec_id % 60) END AS key FROM embeddings),
    i AS (SELECT vec_id AS issue, CASE vec_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'proposed' WHEN 2 THEN 'rejected' ELSE 'merged' END AS state, key, CASE WHEN vec_id % 9 <> 0 THEN e END AS e FROM v WHERE vec_id % 13 = 5),
    c AS (SELECT * FROM v WHERE vec_id % 17 = 3),
    s AS (SELECT c.vec_id, issue, state, list_dot_product(c.e, i.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(i.e, i.e))) AS s FROM c, i WHERE i.e IS NOT NULL),
    b AS (SELECT vec_id, max_by(issue, (s, -issue)) FILTER (state = 'active' AND s > 0) AS a, max(s) FILTER (state = 'active' AND s > 0) AS sa, max(s) FILTER (state = 'proposed' AND s > 0) AS sp, max(s) FILTER (state = 'rejected' AND s > 0) AS sr FROM s GROUP BY 1),
    k AS (SELECT c.vec_id, min(issue) AS issue, arg_min(state, issue) AS state FROM c JOIN i ON c.key = i.key AND c.key <> '' GROUP BY 1)
    SELECT c.vec_id, k.issue AS key_issue, k.state AS key_state, b.a AS active_issue, round(coalesce(sa, 0), 6) AS sim_active, round(coalesce(sp, 0), 6) AS sim_proposed, round(coalesce(sr, 0), 6) AS sim_rejected
    FROM c LEFT JOIN b USING (vec_id) LEFT JOIN k USING (vec_id)""")
def issue_best_match(spark, sf):
    """Some vectors play clusters, some issues: that is their role here."""
    k = F.col("vec_id")
    v = table(spark, sf, "embeddings").select("vec_id", "embedding", F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("k"), k % 60)).alias("key"))
    state = F.when(k % 4 == 0, "active").when(k % 4 == 1, "proposed").when(k % 4 == 2, "rejected").otherwise("merged")
    issues = v.filter(k % 13 == 5).select(k.alias("issue"), state.alias("state"), "key", F.when(k % 9 != 0, F.col("embedding")).alias("vector"))
    out = iss.best_by_state(v.filter(k % 17 == 3), "vec_id", "embedding", "key", issues)
    return out.withColumns({c: F.round(c, 6) for c in ("sim_active", "sim_proposed", "sim_rejected")})


@register("issue_undecided", """
    SELECT o_custkey AS issue, o_orderkey AS item FROM orders WHERE o_orderkey % 3 <> 0 AND NOT (o_orderkey % 7 = 1 AND o_custkey % 2 = 0)""")
def issue_undecided(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("issue"), F.col("o_orderkey").alias("item"))
    return iss.undecided(o, o.filter("item % 3 = 0"), o.filter("item % 7 = 1 and issue % 2 = 0"))


@register("issue_regulations", """
    WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'bill' ELSE 'diff' END AS kind, CASE WHEN o_orderkey % 5 = 1 THEN 'assembly' END AS origin, (o_orderkey % 40)::VARCHAR AS bill, 'Law ' || (o_custkey % 9) AS law, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE (o_custkey % 50)::VARCHAR END AS number FROM orders),
    k AS (SELECT id, list_filter([kind || ':' || CASE WHEN kind = 'bill' THEN bill ELSE id::VARCHAR END, CASE WHEN kind = 'diff' AND origin = 'assembly' THEN 'bill:' || bill WHEN kind = 'diff' AND number <> '' THEN 'act:' || replace(law, ' ', '') || '|' || number END], lambda y: y IS NOT NULL) AS ks FROM x),
    i AS (SELECT id % 200 AS issue, CASE (id % 200) % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'proposed' WHEN 2 THEN 'rejected' ELSE 'merged' END AS state, unnest(ks) AS key FROM k WHERE id % 11 = 4),
    m AS (SELECT k.id, min({'p': CASE state WHEN 'active' THEN 0 WHEN 'proposed' THEN 1 ELSE 2 END, 'i': issue, 's': state}) AS b FROM (SELECT id, unnest(ks) AS key FROM k WHERE id % 11 = 5) k JOIN i USING (key) WHERE state <> 'merged' GROUP BY 1)
    SELECT id, b.s AS state, b.i AS issue FROM m""")
def issue_regulations(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 2 == 0, "bill").otherwise("diff")
    bill = (k % 40).cast("string")
    keys = iss.regulation_keys(kind, F.when(kind == "bill", bill).otherwise(k.cast("string")), F.when(k % 5 == 1, "assembly"), bill, F.concat(F.lit("Law "), c % 9), F.when(k % 3 == 0, "").otherwise((c % 50).cast("string")))
    rows = table(spark, sf, "orders").select(k.alias("id"), keys.alias("keys"))
    s = F.col("issue") % 4
    issues = rows.filter("id % 11 = 4").select((F.col("id") % 200).alias("issue"), "keys").withColumn("state", F.when(s == 0, "active").when(s == 1, "proposed").when(s == 2, "rejected").otherwise("merged"))
    return iss.same_regulation(rows.filter("id % 11 = 5"), "id", "keys", issues)


@register("carry_over", "WITH " + PAGES_SQL + """
    , b AS (SELECT DISTINCT unnest(w) AS token FROM t WHERE page_id % 9 = 0),
    c AS (SELECT * FROM t WHERE date_diff('second', seen, TIMESTAMP '2026-01-10') > 24 * 3600 AND date_diff('second', seen, TIMESTAMP '2026-01-10') <= 72 * 3600 AND level = 'urgent' AND length(trim(h1)) > 20 AND page_id % 5 <> 0 AND page_id % 7 <> 0)
    SELECT page_id FROM c, (SELECT list(token) AS known FROM b) WHERE len(w) = 0 OR len(list_intersect(w, known)) / len(w) < 0.7 ORDER BY seen DESC, page_id LIMIT 40""")
def carry_over(spark, sf):
    """Headings stand for bodies, repeated to be long enough; a share of 0.7 fits the pages' few words."""
    rows = news(spark, sf).withColumn("body", F.when(F.length(F.trim("h1")) > 20, F.repeat("h1", F.lit(3)))).withColumn("url", F.concat(F.lit("u"), "page_id"))
    k = F.col("page_id")
    tokens = rows.filter(k % 9 == 0).select(F.explode("w").alias("token"))
    out = br.carry_over(rows, "page_id", "at", "level", "body", "w", "url", rows.filter(k % 5 == 0), tokens, rows.filter(k % 7 == 0), clock(), covered=0.7)
    return out.select("page_id")


@register("briefing_clusters", "WITH RECURSIVE " + PAGES_SQL + """
    , c AS (SELECT page_id AS id, w, seen, page_id % 4 <> 1 AS body, row_number() OVER (ORDER BY seen DESC, page_id) AS k FROM t WHERE seen > TIMESTAMP '2026-01-10' - INTERVAL 60 HOUR), """ + _walk("c", 3) + """
    , m AS (SELECT c.*, seed FROM c JOIN star USING (id)), r AS (SELECT seed, CASE WHEN bool_or(body) THEN arg_min(id, (NOT body, id <> seed, k)) ELSE seed END AS rep, count(*) - 1 AS related FROM m GROUP BY seed),
    e AS (SELECT w FROM t WHERE seen <= TIMESTAMP '2026-01-10' - INTERVAL 100 HOUR AND page_id % 6 = 0)
    SELECT rep, related, EXISTS (SELECT 1 FROM e WHERE len(list_intersect(e.w, c.w)) >= 3) AS covered FROM r JOIN c ON c.id = r.rep""")
def briefing_clusters(spark, sf):
    rows = news(spark, sf)
    fresh = rows.filter(F.col("at") > clock() - F.expr("INTERVAL 60 HOURS")).withColumn("body", F.col("page_id") % 4 != 1)
    earlier = rows.filter((F.col("at") <= clock() - F.expr("INTERVAL 100 HOURS")) & (F.col("page_id") % 6 == 0))
    return br.briefing_clusters(fresh, "page_id", "at", "w", "body", earlier, "w")


@register("bill_sections", """
    WITH b AS (SELECT o_orderkey AS bill_id, 'bill ' || (o_orderkey % 900) AS bill_name, TIMESTAMP '1998-06-10' - INTERVAL (o_orderkey % 50) HOUR AS created_at, o_orderdate::DATE AS propose_day, TIMESTAMP '1998-06-10' - INTERVAL (o_custkey % 60) HOUR AS updated_at,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS was, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE o_orderpriority END AS now, DATE '1998-06-10' + (o_orderkey % 20)::INT AS notice_end, o_orderkey % 6 = 0 AS briefed FROM orders),
    n AS (SELECT * FROM b WHERE created_at >= TIMESTAMP '1998-06-09' AND propose_day >= DATE '1998-06-03'), e AS (SELECT * FROM b WHERE notice_end >= DATE '1998-06-19' AND NOT briefed)
    SELECT 'new' AS section, bill_id, bill_id IN (SELECT bill_id FROM e) OR bill_name IN (SELECT bill_name FROM e) AS with_notice FROM n
    UNION ALL SELECT 'changed', bill_id, false FROM b WHERE updated_at >= TIMESTAMP '1998-06-09' AND was <> '' AND was IS DISTINCT FROM now AND now <> '2-HIGH'
    UNION ALL SELECT 'deadline', bill_id, false FROM e WHERE bill_id NOT IN (SELECT bill_id FROM n) AND bill_name NOT IN (SELECT bill_name FROM n)""")
def bill_sections(spark, sf):
    k, c, at = F.col("o_orderkey"), F.col("o_custkey"), F.lit("1998-06-10 00:00:00")
    ago = lambda h: F.timestamp_seconds(F.unix_timestamp(at) - h * 3600)
    bills = table(spark, sf, "orders").select(
        k.alias("bill_id"), F.concat(F.lit("bill "), k % 900).alias("bill_name"), ago(k % 50).alias("created_at"), F.to_date("o_orderdate").alias("propose_day"), ago(c % 60).alias("updated_at"),
        F.when(k % 4 != 0, F.col("o_orderstatus")).alias("was"), F.when(k % 3 == 0, "P").otherwise(F.col("o_orderpriority")).alias("now"), F.date_add(F.to_date(at), (k % 20).cast("int")).alias("notice_end"), (k % 6 == 0).alias("briefed"))
    return br.bill_sections(bills, at.cast("timestamp"), skip=("2-HIGH",))


@register("merged_blocks", """
    WITH l AS (SELECT l_orderkey AS place, l_orderkey % 3 AS head, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'item ' || (l_partkey % 40) || '</b>') AS n, 'item ' || (l_partkey % 40) AS txt FROM lineitem WHERE l_orderkey % 10 <> 9),
    f AS (SELECT head, txt, min({'p': place, 'n': n}) AS f FROM l GROUP BY ALL),
    b AS (SELECT head, min(f.p) AS place, count(*) AS c, string_agg(r || '. <b>' || txt || '</b>', chr(10) || chr(10) ORDER BY r) AS body FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY f) AS r FROM f) GROUP BY head)
    SELECT place, '[' || head || '] news ' || c || '건 today' || chr(10) || chr(10) || body AS text FROM b
    UNION ALL SELECT l_orderkey, 'bill ' || l_orderkey || ' passed' FROM lineitem WHERE l_orderkey % 10 = 9 GROUP BY 1""")
def merged_blocks(spark, sf):
    """Orders as queue rows: their lines are the numbered items; every tenth order is a notice of another form."""
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(". <b>item "), F.col("l_partkey") % 40, F.lit("</b>"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), line.alias("t")))).alias("ls"))
    items = F.transform("ls", lambda x, i: F.concat((i + 1).cast("string"), F.lit("."), F.split_part(x["t"], F.lit("."), F.lit(2))))
    block = F.concat(F.lit("["), F.col("l_orderkey") % 3, F.lit("] news "), F.size("ls"), F.lit("건 today\n\n"), F.array_join(items, "\n\n"))
    html = F.when(F.col("l_orderkey") % 10 == 9, F.concat(F.lit("bill "), "l_orderkey", F.lit(" passed"))).otherwise(block)
    return br.merged_blocks(rows.select(F.col("l_orderkey").alias("place"), html.alias("html")), "place", "html")


@register("distinct_terms", """
    WITH RECURSIVE x AS (SELECT p_size AS day, p_partkey AS o, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN upper(string_split(p_name, ' ')[1]) ELSE p_name || ' (' || (p_partkey % 5) || ')' END AS t FROM part),
    k AS (SELECT *, lower(regexp_replace(t, '[\\s·\\-_()]', '', 'g')) AS k, row_number() OVER (PARTITION BY day ORDER BY o) AS n FROM x),
    w(day, n, kept) AS (
        SELECT day, 1, [{'o': o, 't': t, 'k': k}] FROM k WHERE n = 1
        UNION ALL
        SELECT day, n, CASE WHEN hit IS NULL THEN kept || [{'o': o, 't': t, 'k': k}] WHEN length(t) > length(kept[hit].t) THEN kept[1:hit - 1] || [{'o': o, 't': t, 'k': k}] || kept[hit + 1:] ELSE kept END
        FROM (SELECT w.day, k.n, w.kept, k.o, k.t, k.k, list_position([contains(y.k, k.k) OR contains(k.k, y.k) FOR y IN w.kept], true) AS hit FROM w JOIN k ON k.day = w.day AND k.n = w.n + 1))
    SELECT day, e.o AS o, e.t AS t FROM (SELECT day, unnest(kept) AS e FROM (SELECT *, max(n) OVER (PARTITION BY day) AS last FROM w) WHERE n = last)""")
def distinct_terms(spark, sf):
    k = F.col("p_partkey")
    t = F.when(k % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).when(k % 3 == 1, F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise(F.concat("p_name", F.lit(" ("), k % 5, F.lit(")")))
    return br.distinct_terms(table(spark, sf, "part").select(F.col("p_size").alias("day"), k.alias("o"), t.alias("t")), ["day"], "o", "t")


@register("parallel_table", r"""
    WITH l AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT * 10000000000 + l_partkey * 10000 + l_suppkey AS n, CASE WHEN l_linenumber % 3 = 1 AND l_partkey % 4 <> 0 THEN '제' || l_linenumber || '조(x) ' || l_linestatus ELSE l_linestatus END AS o,
               CASE WHEN l_linenumber % 3 = 1 AND l_partkey % 5 = 0 THEN '<삭 제>' WHEN l_linenumber % 3 = 1 AND l_partkey % 7 = 0 THEN '제' || l_linenumber || '조(x) 삭제' WHEN l_linenumber % 3 = 1 THEN '제' || l_linenumber || '조(x) ' || l_returnflag ELSE l_returnflag END AS w FROM lineitem),
    g AS (SELECT *, regexp_matches(o, '^제\s*[0-9]+조') AS oh, regexp_matches(w, '^제\s*[0-9]+조') AS nh, sum((regexp_matches(o, '^제\s*[0-9]+조') OR regexp_matches(w, '^제\s*[0-9]+조'))::INT) OVER (PARTITION BY doc ORDER BY n, o, w ROWS UNBOUNDED PRECEDING) AS g FROM l),
    a AS (SELECT doc, g, first(oh ORDER BY n, o, w) AS oh, first(nh ORDER BY n, o, w) AS nh, first(CASE WHEN nh THEN w ELSE o END ORDER BY n, o, w) AS head, string_agg(o, chr(10) ORDER BY n, o, w) AS ot, string_agg(w, chr(10) ORDER BY n, o, w) AS nt FROM g WHERE g > 0 GROUP BY doc, g),
    c AS (SELECT *, CASE WHEN NOT oh AND nh THEN 'added' WHEN oh AND NOT nh THEN 'deleted' WHEN regexp_matches(nt, '^제\s*[0-9]+조(의[0-9]+)?(\([^)]*\))?\s*삭제') THEN 'deleted' ELSE 'modified' END AS change FROM a)
    SELECT doc, regexp_extract(head, '^제([0-9]+조)', 1) AS key, change, CASE change WHEN 'added' THEN '' ELSE ot END AS old_text, CASE WHEN oh AND NOT nh THEN '' ELSE nt END AS new_text FROM c""")
def parallel_table(spark, sf):
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    head = F.concat(F.lit("제"), n, F.lit("조(x) "))
    old = F.when((n % 3 == 1) & (k % 4 != 0), F.concat(head, F.lit("<P>"), "l_linestatus", F.lit("</P>"))).otherwise(F.col("l_linestatus"))
    new = F.when((n % 3 == 1) & (k % 5 == 0), "<삭 제>").when((n % 3 == 1) & (k % 7 == 0), F.concat(head, F.lit("삭제"))).when(n % 3 == 1, F.concat(head, "l_returnflag")).otherwise(F.col("l_returnflag"))
    return tb.parallel_changes(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (n.cast("long") * 10_000_000_000 + k * 10_000 + F.col("l_suppkey")).alias("n"), old.alias("o"), new.alias("w")), "doc", "n", "o", "w")


@register("summary_drift", """
    WITH c AS (SELECT c_custkey AS k, 'Act ' || c_custkey AS name, c_mktsegment AS agency FROM customer),
    w AS (SELECT k, name, agency, '제' || k || '-' || v || '호' AS no, (20200101 + v * 10000)::VARCHAR AS enf, v FROM c, (VALUES (1), (2)) t(v) WHERE k % 6 <> 5 AND (v = 1 OR k % 4 = 0)),
    s AS (SELECT k, CASE WHEN k % 9 = 0 THEN 'OldAct ' || k ELSE name END AS title, CASE WHEN k % 5 = 0 THEN '' WHEN k % 7 = 0 THEN 'other' ELSE agency END AS agency, '제0' || k || '-' || CASE WHEN k % 8 = 0 THEN 2 ELSE 1 END || '호' AS number,
                 CASE WHEN k % 10 = 3 THEN '2031-01-01' WHEN k % 8 = 0 THEN '2022.01.01' ELSE '2021-01-01' END AS enforced FROM c),
    n AS (SELECT w.*, row_number() OVER (PARTITION BY k ORDER BY enf DESC) r FROM w)
    SELECT 'p' || s.k AS path, s.title, s.number AS own_no, regexp_replace(enforced, '[^0-9]', '', 'g') AS own_enf, n.no AS now_no, n.enf AS now_enf, n.name || '(' || n.agency || ')(' || n.no || ')(' || n.enf || ')' AS now_doc, CASE WHEN s.k % 9 = 0 THEN n.name END AS renamed_to
    FROM s JOIN n ON n.k = s.k AND r = 1 WHERE (s.agency = '' OR s.agency = n.agency) AND regexp_replace(enforced, '[^0-9]', '', 'g') <= '20260101' AND (n.enf <> regexp_replace(enforced, '[^0-9]', '', 'g') OR (CASE WHEN s.k % 8 = 0 THEN 2 ELSE 1 END) <> n.v)""")
def summary_drift(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k, F.concat(F.lit("Act "), k).alias("name"), F.col("c_mktsegment").alias("agency"))
    versions = c.filter(k % 6 != 5).withColumn("v", F.explode(F.when(k % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    watched = versions.select(F.concat("name", F.lit("("), "agency", F.lit(")(제"), k, F.lit("-"), "v", F.lit("호)("), (20200101 + F.col("v") * 10000).cast("string"), F.lit(")")).alias("doc_name"))
    title = F.when(k % 9 == 0, F.concat(F.lit("OldAct "), k)).otherwise(F.col("name"))
    summaries = c.select(
        F.concat(F.lit("p"), k).alias("path"), title.alias("title"), F.when(k % 5 == 0, "").when(k % 7 == 0, "other").otherwise(F.col("agency")).alias("agency"),
        F.concat(F.lit("제0"), k, F.lit("-"), F.when(k % 8 == 0, 2).otherwise(1), F.lit("호")).alias("number"), F.when(k % 10 == 3, "2031-01-01").when(k % 8 == 0, "2022.01.01").otherwise("2021-01-01").alias("enforced"))
    renamed = c.filter(k % 9 == 0).select(F.concat(F.lit("OldAct "), k).alias("old"), F.col("name").alias("new"))
    return tb.drift(summaries, watched, renamed, "20260101")


@register("watched_items", """
    WITH o AS (SELECT c_custkey AS key, c_mktsegment AS source, c_nationkey::VARCHAR AS hash FROM customer WHERE c_custkey % 5 <> 0), f AS (SELECT c_custkey AS key, c_mktsegment AS source, CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE c_nationkey::VARCHAR END AS hash FROM customer WHERE c_custkey % 7 <> 0 AND c_mktsegment <> 'MACHINERY')
    SELECT coalesce(f.key, o.key) AS key, coalesce(f.source, o.source) AS source, CASE WHEN f.key IS NULL THEN o.hash ELSE f.hash END AS hash, CASE WHEN o.key IS NULL THEN 'new' WHEN f.key IS NULL THEN CASE WHEN o.source = 'MACHINERY' THEN 'kept' ELSE 'gone' END WHEN f.hash = o.hash THEN 'same' ELSE 'changed' END AS what
    FROM o FULL JOIN f ON o.key = f.key""")
def watched_items(spark, sf):
    """One source failed: its items keep their state."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("key"), F.col("c_mktsegment").alias("source"), F.col("c_nationkey").cast("string").alias("hash"))
    fresh = c.filter((F.col("key") % 7 != 0) & (F.col("source") != "MACHINERY")).withColumn("hash", F.when(F.col("key") % 6 == 0, "x").otherwise(F.col("hash")))
    return tb.watch(c.filter("key % 5 != 0"), fresh, c.select("source").distinct().withColumn("ok", F.col("source") != "MACHINERY"))


@register("late_verdicts", "SELECT event_id FROM events WHERE value * 60 <= 15 * 60 AND event_id % 4 <> 0")
def late_verdicts(spark, sf):
    later = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 60_000_000).cast("long") * F.when(F.col("event_id") % 4 == 0, -1).otherwise(1) - F.when(F.col("event_id") % 4 == 0, 1).otherwise(0))
    return ev.late_verdicts(table(spark, sf, "events").withColumn("asked", later), "asked", "ts").select("event_id")


@register("retry_due", """
    WITH c AS (SELECT max(ts) AS m FROM events) SELECT e.event_id FROM events e WHERE e.event_type = 'click' AND NOT EXISTS (
        SELECT 1 FROM events f, c WHERE f.event_type = 'error' AND f.event_id % 2000 = e.event_id % 2000 AND f.ts <= m AND epoch_us(m) - epoch_us(f.ts) < 7200 * 60000000::BIGINT)""")
def retry_due(spark, sf):
    events = table(spark, sf, "events").withColumn("item", F.col("event_id") % 2000)
    last = events.agg(F.max("ts")).first()[0]
    failures = events.filter("event_type = 'error'").select("item", F.col("ts").alias("failed_at"))
    return ev.due_for_retry(events.filter("event_type = 'click'"), "item", failures, F.lit(last).cast("timestamp"), 7200).select("event_id")


@register("capped_speech", """
    WITH s AS (SELECT conv_id, turn, contains(text, 'qu') AS own, contains(text, 'tion')::INT + contains(text, 'ing')::INT + contains(text, 'der')::INT AS f, length(text) AS n FROM conversations),
    r AS (SELECT *, greatest(0, 3 - count(*) FILTER (own) OVER (PARTITION BY conv_id)) AS room, row_number() OVER (PARTITION BY conv_id, own ORDER BY CASE WHEN f > 0 THEN f * 100 + least(n // 200, 5) ELSE 0 END DESC, turn) AS place FROM s)
    SELECT conv_id, turn FROM r WHERE own OR place <= room""")
def capped_speech(spark, sf):
    rows = table(spark, sf, "conversations").filter("text is not null")
    return sp.capped(rows, ["conv_id"], "turn", "text", ["tion", "ing", "der"], 3, F.contains("text", F.lit("qu"))).select("conv_id", "turn")


@register("bill_stages", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus WHEN o_orderkey % 5 = 0 THEN '폐기' WHEN o_orderkey % 5 = 1 THEN '위원회 의결' WHEN o_custkey % 2 = 0 THEN '법사위 심사중' WHEN o_custkey % 3 = 0 THEN '법사위 회부' WHEN o_custkey % 5 = 0 THEN '소관위 심사중' WHEN o_custkey % 7 = 0 THEN '소관위 회부' ELSE '접수' END AS stage FROM orders""")
def bill_stages(spark, sf):
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("string")
    blank = lambda hit: F.when(hit, day).otherwise(" ")
    verdict = F.when(k % 5 == 0, "폐기").when(k % 5 == 1, "원안가결").when(k % 5 == 2, "")
    stage = pr.bill_stage(F.when(k % 7 == 0, F.col("o_orderstatus")), verdict, blank(c % 2 == 0), F.when(c % 3 == 0, day), blank(c % 5 == 0), F.when(c % 7 == 0, day), ("폐기", "철회"), ("원안가결", "수정가결"))
    return table(spark, sf, "orders").select("o_orderkey", stage.alias("stage"))


@register("noise_titles", r"""
    WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '3G 연속 안타 ' WHEN 1 THEN '[LTE/리포트] ' WHEN 2 THEN '3G 종료 ' WHEN 3 THEN '과기정통부 인사이동 ' WHEN 4 THEN '많이 본 뉴스 ' ELSE '다음은 김 위원님 ' END || p_name AS t, CASE WHEN p_size % 9 = 0 THEN 'http://Sports.naver.com/x' ELSE 'http://news' END AS u FROM part)
    SELECT p_partkey, p_partkey % 6 IN (0, 1) OR contains(lower(u), 'sports.naver.com') AS sports, p_partkey % 6 = 3 AS personnel, p_partkey % 6 = 4 AS no_body, length(t) < 18 OR (p_partkey % 6 = 5 AND length(t) < 60) AS noise FROM t""")
def noise_titles(spark, sf):
    k = F.col("p_partkey")
    lead = F.element_at(F.array(*map(F.lit, ["3G 연속 안타 ", "[LTE/리포트] ", "3G 종료 ", "과기정통부 인사이동 ", "많이 본 뉴스 ", "다음은 김 위원님 "])), (k % 6 + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", F.concat(lead, "p_name").alias("t"), F.when(F.col("p_size") % 9 == 0, "http://Sports.naver.com/x").otherwise("http://news").alias("u"))
    t, u = F.col("t"), F.col("u")
    return rows.select("p_partkey", pr.sports_noise(t, u).alias("sports"), pr.personnel_news(t).alias("personnel"), pr.non_body(t).alias("no_body"), pr.noise_speech(t).alias("noise"))


@register("claim_relevance", r"""
    WITH t AS (SELECT conv_id, max(text) FILTER (turn = 0) a, max(text) FILTER (turn = 1) s FROM conversations GROUP BY 1),
    w AS (SELECT conv_id, list_filter(list_distinct(regexp_split_to_array(regexp_replace(regexp_replace(a, '\[[^\]]*\]', ' ', 'g'), '\*\*', ' ', 'g'), '[^가-힣A-Za-z0-9]+')), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$')) AS w, regexp_replace(regexp_replace(regexp_replace(s, '\*\*', '', 'g'), '\[[^\]]*\]', '', 'g'), '[\s·ㆍ‧•''"“”‘’「」『』()（）\[\],.:;、。…\-—–|]', '', 'g') AS s FROM t WHERE a IS NOT NULL AND s IS NOT NULL),
    h AS (SELECT conv_id, len(w)::INT AS n, len(list_filter(w, lambda x: contains(s, x)))::INT AS hits FROM w)
    SELECT conv_id, n, hits, CASE WHEN n > 0 THEN round(hits / n, 6) ELSE 0 END AS score, hits >= 2 AND (CASE WHEN n > 0 THEN round(hits / n, 6) ELSE 0 END) >= 0.2 AS evidence FROM h""")
def claim_relevance(spark, sf):
    """The first turn as a claim, the second as its source."""
    turn = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(turn(0).alias("a"), turn(1).alias("s")).filter("a is not null and s is not null")
    rows = rows.select("conv_id", pr.claim_relevance(F.col("a"), F.col("s")).alias("r"))
    return rows.select("conv_id", "r.n", "r.hits", "r.score", pr.is_evidence(F.col("r")).alias("evidence"))


@register("definitions", """
    SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::VARCHAR AS item_no, p_name AS term, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS alias FROM part WHERE p_partkey % 5 <> 0
    """)
def definitions(spark, sf):
    """Parts as items of one article a brand, written out and parsed; every fifth part is a deleted item."""
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))).alias("ps"))
    live = F.filter("ps", lambda p: p["p_partkey"] % 5 != 0)
    gone = F.filter("ps", lambda p: p["p_partkey"] % 5 == 0)
    said = lambda p: F.when(p["p_partkey"] % 3 == 0, F.concat(F.lit('"'), p["p_name"], F.lit('"('), p["p_type"], F.lit(")란"))).when(p["p_partkey"] % 3 == 1, F.concat(F.lit('"'), p["p_name"], F.lit('(이하 "'), p["p_type"], F.lit('"라 한다)"이라 함은'))).otherwise(F.concat(p["p_name"], F.lit(" :")))
    items = F.transform(live, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), said(p), F.lit(" a part that\nis sold <개정 2020. 1. 1.>")))
    deleted = F.transform(gone, lambda p, i: F.concat((i + 500).cast("string"), F.lit(". 삭제 <2020. 1. 1.>")))
    body = F.concat(F.lit("제2조(정의) 이 법에서 쓰는 말의 뜻이다.\n"), F.array_join(F.concat(items, deleted), "\n"))
    return rows.select("p_brand", F.explode(pr.definitions(body)).alias("d")).select("p_brand", "d.item_no", "d.term", "d.alias")


@register("speech_blocks", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT - 1 AS pos, role AS label, md5(trim(regexp_replace(text, '\\n{2,}', chr(10), 'g'))) AS digest FROM conversations WHERE trim(text) <> ''")
def speech_blocks(spark, sf):
    """Conversations written as one text with marks, and cut again."""
    turns = table(spark, sf, "conversations").filter(F.trim("text") != "").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    whole = F.concat(F.lit("front matter\n"), F.array_join(F.transform("ts", lambda t: F.concat(F.lit("◯"), t["role"], F.lit("\n"), t["text"])), "\n"))
    cut = turns.select("conv_id", F.posexplode(pr.speech_blocks(whole)).alias("pos", "b"))
    return cut.select("conv_id", "pos", F.col("b.label").alias("label"), F.md5("b.text").alias("digest"))


@register("article_rank", CHUNKS_SQL + r"""
    , s AS (SELECT doc_name, coalesce(article_no, '') AS article_no, doc_name || ' ' || coalesce(article_no, '') AS hay, (id % 3) * 5 AS act, dom, CASE WHEN doc_name LIKE '% act' THEN 2 WHEN doc_name LIKE '%.pdf' THEN 0 ELSE 1 END AS tier FROM cur),
    l AS (SELECT *, greatest(CASE WHEN contains(hay, 'the') THEN 3 ELSE 0 END, list_max([CASE WHEN contains(hay, 'thation ness'[i:j]) THEN j - i + 1 ELSE 0 END FOR i IN range(1, 13) FOR j IN range(i + 3, 13)])) AS best FROM s),
    r AS (SELECT doc_name, article_no, (2 * act + best + dom::INT)::INT AS score, tier FROM l), o AS (SELECT *, row_number() OVER (PARTITION BY doc_name, article_no ORDER BY score DESC, tier DESC) k FROM r)
    SELECT doc_name, article_no, score, row_number() OVER (ORDER BY score DESC, tier DESC, doc_name, article_no)::INT AS place FROM o WHERE k = 1 ORDER BY place LIMIT 12""".replace("[CASE WHEN contains(hay, 'thation ness'[i:j]) THEN j - i + 1 ELSE 0 END FOR i IN range(1, 13) FOR j IN range(i + 3, 13)]", "flatten([[CASE WHEN contains(hay, 'thation ness'[i:j]) THEN j - i + 1 ELSE 0 END FOR j IN range(i + 3, 13)] FOR i IN range(1, 10)])"))
def article_rank(spark, sf):
    rows = se.current_only(chunks(spark, sf)).withColumn("act", (F.col("id") % 3) * 5)
    tier = F.when(F.col("doc_name").endswith(" act"), 2).when(F.col("doc_name").endswith(".pdf"), 0).otherwise(1)
    return se.article_rank(rows, "doc_name", "article_no", "act", ["the", "thation ness"], F.col("dom"), tier, 12)


@register("query_expansion", """
    SELECT conv_id, turn, w AS words, CASE WHEN len(w) > 0 THEN text || ' ' || array_to_string(w, ' ') ELSE text END AS expanded FROM (
        SELECT *, (CASE WHEN contains(text, 'tion') THEN ['close', 'end'] ELSE [] END || CASE WHEN contains(text, 'ung') AND NOT contains(text, 'tion') THEN ['end', 'stop'] WHEN contains(text, 'ung') THEN ['stop'] ELSE [] END)::VARCHAR[] AS w FROM conversations)""")
def query_expansion(spark, sf):
    conv = table(spark, sf, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    return se.expanded(conv, "id", "text", {"tion": ["close", "end"], "ung": ["end", "stop"]}).select("id.conv_id", "id.turn", "words", "expanded")


@register("term_search", r"""
    WITH i AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents) GROUP BY ALL)
    SELECT doc_id, sum(tf)::BIGINT AS tf FROM i WHERE term IN ('the', 'tion', 'of') GROUP BY doc_id HAVING count(*) = 3""")
def term_search(spark, sf):
    """The index is written once; the search reads the folders of its three terms."""
    return ix.all_terms(spark, _indexed(spark, sf), ["the", "tion", "of"]).withColumnRenamed("id", "doc_id")


@register("phrase_search", r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)
    SELECT doc_id, count(*)::INT AS n, (min(i) - 1)::INT AS first_place FROM p WHERE w[i] = 'of' AND w[i + 1] = 'the' GROUP BY doc_id""")
def phrase_search(spark, sf):
    """Two words in a row, by the positions of the stored index."""
    found = ix.phrase(spark, _indexed(spark, sf), ["of", "the"])
    return found.select(F.col("id").alias("doc_id"), F.size("places").alias("n"), F.array_min("places").alias("first_place"))


@register("question_parts", """
    WITH c AS (SELECT c_custkey AS id, c_custkey % 5 AS v, c_custkey % 9 AS k FROM customer)
    SELECT id, CASE v WHEN 0 THEN CASE WHEN k > 4 THEN '김성수' ELSE '박영선' END END AS speaker, CASE v WHEN 2 THEN 2016 + k END AS year, CASE v WHEN 1 THEN 2026 - k WHEN 4 THEN 2016 + k END AS year_from, CASE v WHEN 1 THEN 2026 WHEN 4 THEN 2017 + k END AS year_to,
           CASE WHEN v = 3 AND 16 + k BETWEEN 20 AND 22 THEN 16 + k END AS term, CASE WHEN v = 3 AND 16 + k NOT BETWEEN 20 AND 22 THEN 16 + k END AS other_term,
           CASE v WHEN 2 THEN '국정감사' WHEN 4 THEN '상임위' ELSE '' END AS kinds, CASE v WHEN 0 THEN '주파수 정책' WHEN 1 THEN '통신비' WHEN 2 THEN '번호이동' WHEN 3 THEN '5G 품질' ELSE '위성' END AS query FROM c""")
def question_parts(spark, sf):
    """A question for each customer, in five forms."""
    k, v = F.col("c_custkey") % 9, F.col("c_custkey") % 5
    ask = (
        F.when(v == 0, F.concat(F.when(k > 4, "김성수").otherwise("박영선"), F.lit(" 의원이 발언한 주파수 정책을 찾아줘")))
        .when(v == 1, F.concat(F.lit("최근 "), k + 1, F.lit("년간 통신비 논의")))
        .when(v == 2, F.concat(2016 + k, F.lit("년 국감 번호이동 내용")))
        .when(v == 3, F.concat(F.lit("제"), 16 + k, F.lit("대 국회에서 5G 품질 관련")))
        .otherwise(F.concat(2016 + k, F.lit("~"), 2017 + k, F.lit("년 상임위에서 위성 발언")))
    )
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), ask.alias("q"))
    out = qs.parsed_questions(rows, "q", 2016, 2026)
    return out.select("id", "speaker", "year", "year_from", "year_to", "term", "other_term", F.array_join("kinds", ",").alias("kinds"), "query")


@register("trigram_names", r"""
    WITH g AS (SELECT p_partkey, list_distinct(flatten(list_transform(regexp_extract_all(lower(p_name), '\w+'), lambda w: [('  ' || w || ' ')[i:i + 2] FOR i IN range(1, length(w) + 2)]))) AS g FROM part),
    q AS (SELECT g AS q FROM g WHERE p_partkey = 7), s AS (SELECT p_partkey, len(list_intersect(g, q)) AS shared, len(g) + len(q) - len(list_intersect(g, q)) AS whole FROM g, q)
    SELECT p_partkey, shared::BIGINT AS shared, round(shared / whole, 6) AS sim FROM s WHERE shared / whole >= 0.6""")
def trigram_names(spark, sf):
    """Names alike to that of part 7, by the trigram index: only those with enough shared trigrams are compared."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    path = f"{checkpoint_dir(spark)}/trigrams-{uuid.uuid4().hex}"
    ix.write_trigrams(parts, "p_partkey", "p_name", path)
    (asked,) = parts.filter("p_partkey = 7").select("p_name").first()
    return ix.jaccard_texts(parts, "p_partkey", "p_name", path, asked, 0.6).withColumn("sim", F.round("sim", 6))


def _indexed(spark, sf):
    path = f"{checkpoint_dir(spark)}/terms-{uuid.uuid4().hex}"
    ix.write_index(table(spark, sf, "documents"), "doc_id", ix.words_of(F.col("text")), path)
    return path


@register("family_edges", """
    WITH n AS (SELECT DISTINCT p_brand || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' 시행령' WHEN 2 THEN ' 시행규칙' ELSE '규정' END AS n FROM part WHERE NOT (p_size % 4 = 1 AND right(p_brand, 1) = '3') AND NOT (p_size % 4 = 0 AND right(p_brand, 1) = '5')),
    w AS (SELECT n AS child, 1 AS place, regexp_replace(n, ' 시행규칙$', ' 시행령') AS parent FROM n WHERE n LIKE '% 시행규칙' UNION ALL SELECT n, 2, regexp_replace(n, ' 시행(령|규칙)$', '') FROM n WHERE n LIKE '% 시행규칙' OR n LIKE '% 시행령')
    SELECT arg_min(parent, place) AS parent, child FROM w WHERE parent IN (SELECT n FROM n) GROUP BY child""")
def family_edges(spark, sf):
    size = F.col("p_size") % 4
    suffix = F.when(size == 0, "").when(size == 1, " 시행령").when(size == 2, " 시행규칙").otherwise("규정")
    lost = ((size == 1) & F.col("p_brand").endswith("3")) | ((size == 0) & F.col("p_brand").endswith("5"))
    return gr.family_edges(table(spark, sf, "part").filter(~lost).select(F.concat("p_brand", suffix).alias("n")), "n")


@register("article_kinds", """
    SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN CASE WHEN doc_id % 3 <> doc_id % 2 THEN 'rule_changed' ELSE 'rule_same' END WHEN doc_id % 7 = 0 THEN 'word_hit_false' WHEN contains(text, 'ment') THEN 'near' ELSE 'unrelated' END AS kind FROM documents""")
def article_kinds(spark, sf):
    k = F.col("doc_id")
    kind = ru.article_kind(F.when((k % 5).isin(0, 1), F.concat(F.lit("r"), k)), k % 3, k % 2, F.when(k % 7 == 0, True), F.contains("text", F.lit("ment")))
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"))


@register("lowered_pool", """
    WITH f AS (SELECT user_id AS id, max(ts) AS at FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT id, f.at FROM f WHERE id % 3 <> 0 AND id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0""".replace("AS at", "AS \"at\"").replace("f.at", "f.\"at\""))
def lowered_pool(spark, sf):
    e, k = table(spark, sf, "events"), F.col("user_id")
    feedback = e.select(k.alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "normal").otherwise("urgent").alias("was"), F.when(F.col("event_type") == "click", "normal").when(F.col("event_type") == "view", "reference").otherwise("urgent").alias("now"))
    items = e.select(k.alias("id")).distinct().select("id", F.when(F.col("id") % 3 == 0, "urgent").otherwise("normal").alias("level"), (F.col("id") % 7 == 0).alias("lowered_by_like"), (F.col("id") % 11 == 0).alias("restored"), F.when(F.col("id") % 13 == 0, True).alias("omnibus"))
    return ru.lowered_pool(feedback, items, F.lit("2024-01-20").cast("timestamp"))


@register("context_budget", """
    WITH i AS (SELECT o_custkey AS q, o_orderkey AS id, o_orderpriority AS sec, (o_orderkey % 900)::BIGINT AS c FROM orders),
    o AS (SELECT *, CASE sec WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECI' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 END AS r, sum(c) OVER (PARTITION BY q) AS total FROM i),
    g AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY q ORDER BY r NULLS LAST, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM o)
    SELECT q, id FROM g WHERE r IS NULL OR 1000 + total - gone <= 3500""")
def context_budget(spark, sf):
    """A customer's orders as the items of one context; the highest priority is never dropped."""
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("sec"))
    return se.within_budget(items, "q", "sec", "id", (F.col("id") % 900).cast("long"), F.lit(1000), 3500, ["5-LOW", "4-NOT SPECI", "3-MEDIUM", "2-HIGH"]).select("q", "id")


@register("paged_feed", """
    WITH p AS (SELECT o_custkey AS feed, (o_orderkey % 12)::INT AS page, count(*) AS n FROM orders GROUP BY ALL), f AS (SELECT feed, min(page) AS first FROM p GROUP BY 1),
    r AS (SELECT p.*, page - row_number() OVER (PARTITION BY p.feed ORDER BY page) = first - 1 AS unbroken, coalesce(max((n < 2)::INT) OVER (PARTITION BY p.feed ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM p JOIN f ON p.feed = f.feed)
    SELECT feed, page, n FROM r WHERE unbroken AND stopped = 0""")
def paged_feed(spark, sf):
    pages = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("feed"), (F.col("o_orderkey") % 12).cast("int").alias("page")).agg(F.count(F.lit(1)).alias("n"))
    return se.until_short_page(pages, "feed", "page", "n", 2)


@register("lost_characters", """
    SELECT p_partkey, '「' || p_name || '」 of ' || p_brand || ' · size ' || p_size || CASE WHEN p_partkey % 5 = 0 THEN ' why?' ELSE '' END AS text, (3)::INT AS fixed FROM part""")
def lost_characters(spark, sf):
    """Brackets and dots lost in one form of a text and found in the other; true question marks stay."""
    from corpusloom.functions import udfs
    from corpusloom.session import ship_package

    ship_package(spark)
    whole = F.concat(F.lit("「"), "p_name", F.lit("」 of "), "p_brand", F.lit(" · size "), "p_size", F.when(F.col("p_partkey") % 5 == 0, " why?").otherwise(""))
    rows = table(spark, sf, "part").select("p_partkey", whole.alias("whole"))
    rows = rows.withColumn("r", udfs.repaired(F.translate("whole", "「」·", "???"), F.concat(F.lit("page 1\n"), "whole", F.lit("\nend"))))
    return rows.select("p_partkey", "r.text", "r.fixed")
