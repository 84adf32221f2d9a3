"""Keyword, text and vector queries, and their fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import chunks as ch
from corpusloom.functions import text as tx
from corpusloom.functions import udfs
from corpusloom.operators import cells as ce
from corpusloom.operators import graph as gr
from corpusloom.operators import pairs as pr
from corpusloom.operators import search as se
from corpusloom.plans.registry import register
from corpusloom.session import checkpoint_dir, checkpointed, table

KEYWORDS = ["that", "tion", "und", "les", "para"]
HITS_SQL = """
    WITH kw(ord, k) AS (VALUES (1, 'that'), (2, 'tion'), (3, 'und'), (4, 'les'), (5, 'para')),
    hits AS (SELECT doc_id, n_chars, ord FROM documents, kw WHERE contains(lower(text), k))
"""


@register("keyword_hit_matrix", HITS_SQL + "SELECT doc_id, ord FROM hits")
def keyword_hit_matrix(spark, sf):
    return se.hit_matrix(table(spark, sf, "documents"), "doc_id", "text", KEYWORDS)


CHUNKS_SQL = r"""
    WITH ch AS (SELECT doc_id AS id, source || CASE WHEN doc_id % 9 = 0 THEN '.pdf' WHEN doc_id % 4 = 1 THEN ' act' ELSE '' END AS doc_name, source = 'wiki' AS dom, lang AS doc_category,
        CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '부칙' WHEN doc_id % 7 = 2 THEN '별표 ' || doc_id ELSE (doc_id % 90) || '조(' || string_split(text, chr(10))[1] || ')' END AS article_no,
        CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 11 <> 0 END AS is_approved, CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'superseded' ELSE 'current' END AS status, text AS content FROM documents),
    cur AS (SELECT * FROM ch WHERE is_approved AND status = 'current'),
    kw(ord, k) AS (VALUES (1, 'that'), (2, 'tion'), (3, 'und'), (4, 'les'), (5, 'para')),
    m AS (SELECT id, any_value(dom) AS dom, any_value(article_no) AS article_no, list(ord) FILTER (contains(lower(content), k)) AS c, list(ord) FILTER (contains(lower(coalesce(article_no, '')), k)) AS t FROM cur, kw GROUP BY id)
"""


def chunks(spark, sf):
    """The documents as chunks of a knowledge base: name, article, approval and version made from id and first line."""
    k, first = F.col("doc_id"), F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, sf, "documents").select(
        k.alias("id"), F.concat("source", F.when(k % 9 == 0, ".pdf").when(k % 4 == 1, " act").otherwise("")).alias("doc_name"), (F.col("source") == "wiki").alias("dom"), F.col("lang").alias("doc_category"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, "부칙").when(k % 7 == 2, F.concat(F.lit("별표 "), k)).otherwise(F.concat((k % 90).cast("string"), F.lit("조("), first, F.lit(")"))).alias("article_no"),
        F.when(k % 13 != 0, k % 11 != 0).alias("is_approved"), F.when(k % 5 == 0, "pending").when(k % 5 == 1, "superseded").otherwise("current").alias("status"), F.col("text").alias("content"))


def _greedy_sql(n=5, per=4):
    parts = [CHUNKS_SQL + ", h AS (SELECT id, unnest(c) AS ord, len(c) AS m, coalesce(t, []) AS t, coalesce(regexp_matches(article_no, '^[0-9]+조'), false) AS art, dom FROM m)"]
    for i in range(1, n + 1):
        before = " UNION ALL ".join(f"SELECT id FROM p{j}" for j in range(1, i))
        parts.append(f", p{i} AS (SELECT id, ord FROM h WHERE ord = {i} {f'AND id NOT IN ({before})' if before else ''} ORDER BY m DESC, list_contains(t, {i}) DESC, art DESC, dom DESC, id LIMIT {per})")
    return "".join(parts) + " ".join(f"{'UNION ALL' if i > 1 else ''} SELECT * FROM p{i}" for i in range(1, n + 1))


@register("keyword_greedy_pick", _greedy_sql())
def keyword_greedy_pick(spark, sf):
    """Approved, current chunks; most keywords first, then the keyword in the title, articles, the domain, the id."""
    rows = se.current_only(chunks(spark, sf))
    in_title = [tx.keyword_hit(F.coalesce("article_no", F.lit("")), F.lit(k)) for k in KEYWORDS]
    rows = rows.select("id", "content", "dom", F.coalesce(F.col("article_no").rlike(r"^\d+조"), F.lit(False)).alias("art"), F.array(*in_title).alias("t"))
    met = F.array_compact(F.array(*[F.when(tx.keyword_hit(F.col("content"), F.lit(k)), F.lit(i)) for i, k in enumerate(KEYWORDS, 1)]))
    hits = rows.select("id", "dom", "art", "t", met.alias("c")).select("id", "dom", "art", F.size("c").alias("m"), "t", F.explode("c").alias("ord")).withColumn("thit", F.get("t", F.col("ord") - 1)).drop("t")
    return se.greedy_pick(checkpointed(hits), "id", [F.desc("m"), F.desc("thit"), F.desc("art"), F.desc("dom")], len(KEYWORDS), 4)


@register("article_dual_quota", CHUNKS_SQL + r"""
    , a AS (SELECT id, any_value(dom) AS dom, coalesce(list(ord) FILTER (contains(lower(content), k)), []) AS c, coalesce(list(ord) FILTER (contains(lower(article_no), k)), []) AS t FROM cur, kw
            WHERE article_no IS NOT NULL AND NOT regexp_matches(doc_name, '(?i)\.(pdf|md|docx|hwp)$') GROUP BY id),
    r AS (SELECT unnest(t) AS ord, 'title' AS hit_col, id, len(t) AS own, len(c) AS other, dom FROM a UNION ALL SELECT unnest(c), 'content', id, len(c), len(t), dom FROM a),
    p AS (SELECT *, row_number() OVER (PARTITION BY ord, hit_col ORDER BY own DESC, other DESC, dom DESC, id) AS place FROM r)
    SELECT ord, hit_col, id, place::INT AS place FROM p WHERE place <= CASE hit_col WHEN 'title' THEN 40 ELSE 10 END""")
def article_dual_quota(spark, sf):
    rows = se.current_only(chunks(spark, sf)).filter(F.col("article_no").isNotNull() & ~F.col("doc_name").rlike(r"(?i)\.(pdf|md|docx|hwp)$"))
    return se.dual_quota(rows, "id", "article_no", "content", KEYWORDS, 40, 10, F.col("dom"))


@register("any_keyword_score", HITS_SQL + """
    SELECT h.doc_id, count(*)::INT AS score, any_value(length(text))::INT AS chars FROM hits h JOIN documents d USING (doc_id) GROUP BY 1 ORDER BY score DESC, chars, h.doc_id LIMIT 50""")
def any_keyword_score(spark, sf):
    return se.any_keyword_score(table(spark, sf, "documents"), "doc_id", "text", KEYWORDS, 50)


@register("chunk_fixed_overlap", r"""
    WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE regexp_matches(text, '\S')),
    p AS (SELECT doc_id, i, CASE WHEN length(t) <= 800 THEN t ELSE t[i + 1:i + 800] END AS piece FROM b, unnest(CASE WHEN length(t) <= 800 THEN [0] ELSE range(0, length(t), 700) END) u(i)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk FROM p WHERE length(regexp_replace(piece, '^\s+|\s+$', '', 'g')) > 50)
    SELECT doc_id, chunk, md5(piece) AS digest FROM k""")
def chunk_fixed_overlap(spark, sf):
    """The article chunker on texts without article heads: pieces of 800 characters, 700 apart, to the end of the text."""
    pieces = table(spark, sf, "documents").select("doc_id", F.posexplode(ch.article_chunks(F.col("text"))).alias("chunk", "c"))
    return pieces.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("c.content").alias("digest"))


@register("article_chunks", r"""
    WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\S')) AS ls FROM documents),
    h AS (SELECT doc_id, len(ls) AS n, list_transform(ls, lambda l, i: '제' || i || '조(' || l || ')') AS hs FROM s),
    b AS (SELECT doc_id, i, regexp_replace(CASE WHEN n >= 5 THEN hs[i] ELSE array_to_string(hs, chr(10)) END, '^\s+|\s+$', '', 'g') AS t FROM h, unnest(range(1, CASE WHEN n >= 5 THEN n WHEN n > 0 THEN 1 ELSE 0 END + 1)) u(i)),
    c AS (SELECT *, regexp_extract(t, '^제(\d+조(?:의\d+)?\([^)]*\))', 1) AS no FROM b),
    p AS (SELECT doc_id, i, j, no, CASE WHEN length(t) <= 800 THEN t ELSE t[j + 1:j + 800] END AS piece FROM c, unnest(CASE WHEN length(t) <= 800 THEN [0] ELSE range(0, length(t), 700) END) u(j)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk FROM p WHERE length(regexp_replace(piece, '^\s+|\s+$', '', 'g')) > 50)
    SELECT doc_id, chunk, nullif(no, '') AS article_no, md5(piece) AS digest FROM k""")
def article_chunks(spark, sf):
    """Texts whose lines are made articles, each with its number; texts of fewer than five are cut by size alone."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("제"), (i + 1).cast("string"), F.lit("조("), x, F.lit(")"))), "\n")
    docs = table(spark, sf, "documents").select("doc_id", body.alias("body"))
    pieces = docs.select("doc_id", F.posexplode(ch.article_chunks(F.col("body"))).alias("chunk", "c"))
    return pieces.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("c.article_no").alias("article_no"), F.md5("c.content").alias("digest"))


@register("section_split", r"""
    SELECT doc_id, i - 1 AS part, length(s) AS chars FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT i, ls[i] AS s FROM unnest(range(1, len(ls) + 1)) u(i)) WHERE length(s) > 0""")
def section_split(spark, sf):
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n(?=.)|\n")).alias("part", "s"))
    return parts.filter(F.length("s") > 0).select("doc_id", F.col("part").cast("long").alias("part"), F.length("s").cast("long").alias("chars"))


@register("title_tokens", r"""
    SELECT page_id, list_filter(list_distinct(regexp_extract_all(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[\p{L}\p{N}]{2,}')),
        lambda w: w NOT IN ('the', 'and', 'of', 'to', 'a', 'in', 'is', 'that', 'de', 'la', 'le', 'der', 'die', 'und', 'el', 'los')).list_sort() AS tokens FROM pages""")
def title_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_sort(tx.tokens(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))).alias("tokens"))


PAIRS_SQL = r"""
    WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}'), lambda w: w NOT IN ('the', 'and', 'of', 'to', 'a', 'in', 'is', 'that', 'de', 'la', 'le', 'der', 'die', 'und', 'el', 'los'))) AS w FROM benchmark),
    x AS (SELECT item_id, unnest(w) AS w FROM t)
"""


@register("shared_keyword_pairs", PAIRS_SQL + "SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM x a JOIN x b ON a.w = b.w AND a.item_id < b.item_id GROUP BY ALL HAVING count(*) >= 3")
def shared_keyword_pairs(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("w"))
    return se.shared_token_pairs(items, "item_id", "w", 3)


@register("bigram_jaccard", r"""
    WITH t AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', '', 'g') AS a, regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\s+', '', 'g') AS b FROM pages),
    g AS (SELECT page_id, list_distinct([a[i:i + 1] FOR i IN range(1, length(a))]) AS x, list_distinct([b[i:i + 1] FOR i IN range(1, length(b))]) AS y FROM t)
    SELECT page_id, CASE WHEN len(list_distinct(x || y)) > 0 THEN round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) ELSE 0 END AS j FROM g""")
def bigram_jaccard(spark, sf):
    a, b = (tx.bigrams(F.regexp_extract("html", f"(?s)<{t}>(.*?)</{t}>", 1)) for t in ("title", "h1"))
    rows = table(spark, sf, "pages").select("page_id", a.alias("a"), b.alias("b"))
    return rows.select("page_id", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


@register("ngram_containment", r"""
    WITH s AS (SELECT item_id, regexp_replace(lower(text), '[\s·ㆍ]+', '', 'g') t FROM benchmark), d AS (SELECT doc_id, regexp_replace(lower(text), '[\s·ㆍ]+', '', 'g') t FROM documents),
    sp AS (SELECT DISTINCT item_id, t[i:i + 5] g FROM s, unnest(range(1, length(t) - 4, 7)) u(i)), sg AS (SELECT DISTINCT item_id, t[i:i + 5] g FROM s, unnest(range(1, length(t) - 4)) u(i)),
    dp AS (SELECT DISTINCT doc_id, t[i:i + 5] g FROM d, unnest(range(1, length(t) - 4, 7)) u(i)), dg AS (SELECT DISTINCT doc_id, t[i:i + 5] g FROM d, unnest(range(1, length(t) - 4)) u(i)),
    sn AS (SELECT item_id, count(*) n FROM sp GROUP BY 1), dn AS (SELECT doc_id, count(*) n FROM dp GROUP BY 1),
    f AS (SELECT doc_id, item_id, count(*) h FROM dg JOIN sp USING (g) GROUP BY ALL), r AS (SELECT doc_id, item_id, round(h / n, 6) AS ratio FROM f JOIN sn USING (item_id) WHERE round(h / n, 6) >= 0.15),
    b AS (SELECT r.doc_id, r.item_id, ratio, count(*) h FROM r JOIN dp ON dp.doc_id = r.doc_id JOIN sg ON sg.item_id = r.item_id AND sg.g = dp.g GROUP BY ALL)
    SELECT b.doc_id AS target, item_id AS source, ratio, round(h / n, 6) AS back_ratio FROM b JOIN dn ON b.doc_id = dn.doc_id WHERE round(h / n, 6) >= 0.15""")
def ngram_containment(spark, sf):
    return se.containment(table(spark, sf, "benchmark"), "item_id", table(spark, sf, "documents"), "doc_id", "text")


@register("verbatim_windows", r"""
    WITH t AS (SELECT conv_id, max(text) FILTER (turn = 0) a, max(text) FILTER (turn = 1) s FROM conversations GROUP BY 1), q AS (SELECT conv_id, regexp_replace(a, '[\s·ㆍ]+', '', 'g') a, regexp_replace(s, '[\s·ㆍ]+', '', 'g') s FROM t WHERE a IS NOT NULL AND s IS NOT NULL)
    SELECT conv_id, CASE WHEN length(a) >= 12 THEN round(len(list_filter(CASE WHEN length(a) > 18 THEN range(1, length(a) - 16, 8) ELSE [1] END, lambda i: contains(s, a[i:i + 17]))) / len(CASE WHEN length(a) > 18 THEN range(1, length(a) - 16, 8) ELSE [1] END), 6) END AS share FROM q""")
def verbatim_windows(spark, sf):
    turn = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(turn(0).alias("a"), turn(1).alias("s")).filter("a is not null and s is not null")
    return rows.select("conv_id", se.verbatim_share(F.col("a"), F.col("s")).alias("share"))


@register("page_title", r"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.title(F.col("html")).alias("title"))


@register("page_links", r"""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def page_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.explode(links).alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@register("page_text", r"""
    SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.plain(F.col("html"))).alias("digest"))


@register("citation_edges", r"""
    WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages)
    SELECT page_id, target, least(count(*), 60) AS weight, [min(left(target, 3))] AS samples FROM c WHERE length(target) >= 3 GROUP BY ALL""")
def citation_edges(spark, sf):
    found = F.filter(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), lambda t: F.length(t) >= 3)
    names = F.transform(found, lambda t: F.struct(t.alias("target"), F.substring(t, 1, 3).alias("context")))
    return gr.citations(table(spark, sf, "pages"), "page_id", names).withColumn("weight", F.least("weight", F.lit(60)))


@register("edge_precedence", """
    WITH e AS (SELECT l_suppkey % 20 AS s, l_partkey % 20 AS t, CASE l_linenumber WHEN 1 THEN 'delegation' WHEN 2 THEN 'three_tier' WHEN 3 THEN 'family' ELSE 'citation' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL),
    w AS (SELECT *, CASE kind WHEN 'delegation' THEN 5 WHEN 'three_tier' THEN 4 WHEN 'family' THEN 3 ELSE 0 END AS o, CASE kind WHEN 'delegation' THEN 5 WHEN 'three_tier' THEN 4 WHEN 'family' THEN 3 ELSE least(n, 60) END AS edge_weight FROM e)
    SELECT s, t, kind, edge_weight FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY o DESC, edge_weight DESC, kind) r FROM w) WHERE r = 1""")
def edge_precedence(spark, sf):
    kind = F.when(F.col("l_linenumber") == 1, "delegation").when(F.col("l_linenumber") == 2, "three_tier").when(F.col("l_linenumber") == 3, "family").otherwise("citation")
    edges = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("s"), (F.col("l_partkey") % 20).alias("t"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return gr.precedence(edges, "s", "t", "kind", "n").select("s", "t", "kind", "edge_weight")


@register("canonical_nodes", """
    SELECT node_key, p_partkey FROM (SELECT lower(replace(p_name, ' ', '')) AS node_key, p_partkey, row_number() OVER (PARTITION BY lower(replace(p_name, ' ', '')) ORDER BY (p_size > 40) DESC, p_partkey) r FROM part) WHERE r = 1""")
def canonical_nodes(spark, sf):
    nodes = table(spark, sf, "part").withColumn("has_doc", F.col("p_size") > 40)
    return gr.canonical(nodes, "p_name", "p_partkey", "has_doc").select("node_key", "p_partkey")


@register("topic_score", """
    WITH e AS (SELECT DISTINCT p_brand AS topic, unnest(string_split(p_name, ' ')) || '/' || p_type AS term FROM part), d AS (SELECT term, count(*) df FROM e GROUP BY 1),
    h AS (SELECT DISTINCT term FROM e WHERE term LIKE 'red/%' OR term LIKE '%/ECONOMY'), s AS (SELECT topic, count(*) AS hits, round(sum(1 / df), 6) AS score FROM e JOIN h USING (term) JOIN d USING (term) GROUP BY 1),
    w AS (SELECT *, row_number() OVER (ORDER BY score DESC, topic) r, lead(score) OVER (ORDER BY score DESC, topic) nx FROM s)
    SELECT topic, hits, score, r = 1 AND hits >= 2 AND score >= 2.0 AND score >= 2 * coalesce(nx, 0) AS picked FROM w""")
def topic_score(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("topic"), F.explode(F.split("p_name", " ")).alias("w"), "p_type").select("topic", F.concat("w", F.lit("/"), "p_type").alias("term")).distinct()
    return gr.topic_scores(rows, "topic", "term", rows.filter("term like 'red/%' or term like '%/ECONOMY'"))


@register("graph_snapshot", """
    SELECT '{"nodes":[' || (SELECT string_agg('{"id":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) FROM nation) || '],"edges":[' ||
           (SELECT string_agg('{"s":' || n_nationkey || ',"t":' || n_regionkey || '}', ',' ORDER BY n_nationkey) FROM nation) || ']}' AS graph""")
def graph_snapshot(spark, sf):
    nation = table(spark, sf, "nation")
    return gr.snapshot(nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), nation.select(F.col("n_nationkey").alias("s"), F.col("n_regionkey").alias("t")))


@register("edge_verdicts", """
    WITH a AS (SELECT l_orderkey AS d, list(DISTINCT l_linenumber) AS have FROM lineitem GROUP BY 1), e AS (SELECT o_orderkey AS d, CASE WHEN o_orderkey % 9 = 0 THEN []::INT[] ELSE [1, (o_orderkey % 6 + 1)::INT] END AS w FROM orders)
    SELECT e.d AS o_orderkey, CASE WHEN len(w) = 0 THEN 'no_article' WHEN have IS NULL THEN 'doc_missing' WHEN len(list_intersect(list_distinct(w), have)) = 0 THEN 'art_missing'
        WHEN len(list_intersect(list_distinct(w), have)) < len(list_distinct(w)) THEN 'art_partial' ELSE 'ok' END AS verdict FROM e LEFT JOIN a ON e.d = a.d""")
def edge_verdicts(spark, sf):
    wanted = F.when(F.col("o_orderkey") % 9 == 0, F.array().cast("array<int>")).otherwise(F.array_distinct(F.array(F.lit(1), (F.col("o_orderkey") % 6 + 1).cast("int"))))
    edges = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("d"), wanted.alias("w"))
    return gr.edge_verdicts(edges.withColumnRenamed("d", "l_orderkey"), "w", table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").select("o_orderkey", "verdict")


@register("content_fingerprint", r"SELECT doc_id, left(sha256(regexp_replace(coalesce(text, ''), '[\s·ㆍ]+', '', 'g')), 16) AS fp FROM documents")
def content_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.fingerprint(F.coalesce("text", F.lit(""))).alias("fp"))


@register("snapshot_changes", """
    WITH o AS (SELECT doc_id, md5(text) h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 7 THEN text || '!' ELSE text END) h FROM documents WHERE doc_id % 10 <> 4)
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' ELSE 'changed' END AS what FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h""")
def snapshot_changes(spark, sf):
    docs, k = table(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id")
    old = docs.filter(k % 10 != 3).select("doc_id", F.md5("text").alias("h"))
    new = docs.filter(k % 10 != 4).select("doc_id", F.md5(F.when(k % 10 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h2"), F.lit(1).alias("has"))
    both = old.withColumn("had", F.lit(1)).join(new, "doc_id", "full_outer").filter(~F.col("h").eqNullSafe(F.col("h2")))
    return both.select("doc_id", F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "gone").otherwise("changed").alias("what"))


@register("trigram_search")
def trigram_search(spark, sf):
    """Word similarity over whole texts, exact above the threshold."""
    from corpusloom.session import ship_package

    ship_package(spark)
    scored = table(spark, sf, "conversations").select("conv_id", "turn", udfs.word_similarity("thonre attion", F.col("text"), 0.12).alias("sim"))
    return scored.filter("sim > 0.12").orderBy(F.desc("sim"), "conv_id", "turn").limit(8)


def _query(spark, sf, vec_id=7) -> list[float]:
    """The vector that a search asks for: one row."""
    return list(table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _scored(spark, sf):
    return se.vector_scores(table(spark, sf, "embeddings"), "vec_id", "embedding", _query(spark, sf)).withColumn("similarity", F.round("similarity", 6))


COS = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
SCORED_SQL = f"WITH s AS (SELECT e.vec_id, e.label, {COS} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 7)"


@register("vector_topk_exact", SCORED_SQL + " SELECT vec_id, similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 8")
def vector_topk_exact(spark, sf):
    return se.top_similar(_scored(spark, sf), "vec_id", 8).select("vec_id", "similarity")


@register("vector_topk_cells", SCORED_SQL + " SELECT vec_id, similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 8")
def vector_topk_cells(spark, sf):
    """The exact form over cells: rounds of cells, until no cell that is left can hold a better vector."""
    path = f"{checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    ce.write_cells(table(spark, sf, "embeddings"), "vec_id", "embedding", path, 16)
    found = ce.nearest(spark, path, _query(spark, sf), 8)
    return found.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@register("vector_topk_threshold", SCORED_SQL + " SELECT vec_id, similarity FROM s WHERE similarity > 0.05 ORDER BY similarity DESC, vec_id LIMIT 20")
def vector_topk_threshold(spark, sf):
    return se.top_similar(_scored(spark, sf), "vec_id", 20, 0.05).select("vec_id", "similarity")


@register("vector_in_group_topk", SCORED_SQL + " SELECT label, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) r FROM s) WHERE r <= 12")
def vector_in_group_topk(spark, sf):
    ranked = _scored(spark, sf).withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")))
    return ranked.filter("r <= 12").select("label", "vec_id", "similarity")


@register("vector_two_stage_rerank", SCORED_SQL + """
    , p AS (SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 300), a AS (SELECT vec_id, round(1 - similarity + CASE label WHEN 0 THEN -0.08 WHEN 1 THEN 0.05 WHEN 2 THEN 0.10 ELSE 0 END, 6) AS adjusted FROM p WHERE similarity > 0)
    SELECT * FROM a ORDER BY adjusted, vec_id LIMIT 10""")
def vector_two_stage_rerank(spark, sf):
    bias = F.when(F.col("label") == 0, -0.08).when(F.col("label") == 1, 0.05).when(F.col("label") == 2, 0.10).otherwise(0.0)
    pool = se.two_stage(_scored(spark, sf), "vec_id", 10, bias)
    return pool.select("vec_id", F.round("adjusted", 6).alias("adjusted"))


@register("similar_pairs_join", f"""
    SELECT q.vec_id AS a, e.vec_id AS b, {COS} AS similarity FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 AND {COS} >= 0.35""")
def similar_pairs_join(spark, sf):
    rows = table(spark, sf, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("q"), "label")
    near = pr.cosine_pairs(asked, "a", "q", rows.withColumnRenamed("vec_id", "b"), "b", "embedding", ["label"], 0.3499)  # rounded below
    return near.filter("a != b").select("a", "b", F.round("similarity", 6).alias("similarity")).filter("similarity >= 0.35")


@register("chunk_search", CHUNKS_SQL + f"""
    , s AS (SELECT c.id, c.doc_name, {COS.replace('e.embedding', 'v.embedding')} AS similarity FROM cur c JOIN embeddings v ON v.vec_id = c.id, embeddings q WHERE q.vec_id = 7)
    SELECT id, doc_name, similarity FROM s WHERE similarity > 0.05 ORDER BY similarity DESC, id LIMIT 8""")
def chunk_search(spark, sf):
    """Vector search over approved, current chunks (vec_id stands for the chunk's id)."""
    seen = se.current_only(chunks(spark, sf)).select(F.col("id").alias("vec_id"), "doc_name")
    best = se.top_similar(_scored(spark, sf).join(seen, "vec_id"), "vec_id", 8, 0.05)
    return best.select(F.col("vec_id").alias("id"), "doc_name", "similarity")


@register("rrf_fusion", CHUNKS_SQL + f"""
    , w(k, w, tw) AS (VALUES ('that', 2, 4), ('tion', 2, 4), ('und', 1, 4), ('les', 1, 0), ('para', 1, 2)),
    ks AS (SELECT id, sum(CASE WHEN contains(lower(content), k) THEN w ELSE 0 END + CASE WHEN contains(lower(doc_name), k) THEN w ELSE 0 END + CASE WHEN contains(lower(coalesce(article_no, '')), k) THEN tw ELSE 0 END)::DOUBLE AS score FROM cur, w GROUP BY id),
    v AS (SELECT c.id, {COS.replace('e.embedding', 'v.embedding')} AS score FROM cur c JOIN embeddings v ON v.vec_id = c.id, embeddings q WHERE q.vec_id = 7),
    l AS (SELECT 'keyword' AS list, * FROM (SELECT * FROM ks WHERE score > 0 ORDER BY score DESC, id LIMIT 200) UNION ALL SELECT 'vector', * FROM (SELECT * FROM v WHERE score > 0 ORDER BY score DESC, id LIMIT 200)
          UNION ALL SELECT 'length', * FROM (SELECT id, length(content)::DOUBLE AS score FROM cur ORDER BY score DESC, id LIMIT 200)),
    r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, id) r FROM l),
    f AS (SELECT r.id, doc_name, doc_category, round(sum(1.0::DOUBLE / (60 + r)) + any_value(CASE WHEN regexp_matches(article_no, '^[0-9]+조') THEN 0.5 / 61 WHEN regexp_matches(article_no, '^(부칙|서식|별지)') THEN -0.5 / 61 ELSE 0 END::DOUBLE
          - CASE WHEN regexp_matches(doc_name, '(?i)\\.(pdf|md|docx|hwp)$') THEN 0.5 / 61 ELSE 0 END::DOUBLE), 9)::DOUBLE AS fused FROM r JOIN cur USING (id) GROUP BY ALL),
    g AS (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY fused DESC, id) g, min(doc_category) OVER (PARTITION BY doc_name) AS cat FROM f),
    t AS (SELECT * FROM g WHERE g <= CASE WHEN contains(doc_name, 'news') THEN 8 ELSE 3 END ORDER BY fused DESC, id LIMIT 15)
    SELECT id, doc_name, fused, row_number() OVER (ORDER BY fused DESC, id)::INT AS place FROM t""")
def rrf_fusion(spark, sf):
    """Hybrid retrieval over approved, current chunks: keyword scores, vector similarity (vec_id stands for the chunk's
    id) and length, fused by rank, with bonuses by kind, at most three chunks of a document (eight of the news)."""
    seen = se.current_only(chunks(spark, sf))
    columns = {c: c for c in ("content", "doc_name", "article_no")}
    score = se.keyword_score(columns, KEYWORDS, ["that", "tion"], ["und"], ["les"]).cast("double")
    narrow = seen.select("id", "doc_name", "article_no", score.alias("keyword"), F.length("content").cast("double").alias("length"))
    similar = _scored(spark, sf).select(F.col("vec_id").alias("id"), F.col("similarity").alias("vector"))
    rows = checkpointed(narrow.join(similar, "id", "left"))
    lists = None
    for name in ("keyword", "vector", "length"):
        best = rows.filter(F.col(name) > 0).orderBy(F.desc(name), "id").limit(200).select("id", "doc_name", "article_no", F.col(name).alias("score"), F.lit(name).alias("list"))
        lists = best if lists is None else lists.unionByName(best)
    cap = F.when(F.contains("doc_name", F.lit("news")), 8).otherwise(3)
    return se.fuse(lists, "id", "doc_name", cap, 15, bonus=se.kind_bonus(F.col("article_no"), F.col("doc_name")))


@register("linear_fusion", HITS_SQL + f"""
    , t AS (SELECT doc_id, count(*) / 5 AS x FROM hits GROUP BY 1), v AS (SELECT e.vec_id AS doc_id, {COS} AS x FROM embeddings e, embeddings q WHERE q.vec_id = 7)
    SELECT doc_id, round(10 * coalesce(v.x, 0) + 5 * coalesce(t.x, 0), 9) AS score FROM v FULL JOIN t USING (doc_id) ORDER BY score DESC, doc_id LIMIT 5""")
def linear_fusion(spark, sf):
    semantic = _scored(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    trigram = se.hit_matrix(table(spark, sf, "documents"), "doc_id", "text", KEYWORDS).groupBy("doc_id").agg((F.count(F.lit(1)) / 5).alias("score"))
    return se.linear_fusion(semantic, trigram, "doc_id", 5)


NEWS_WORDS = ["thor", "tion", "und", "ment"]


@register("news_rank_idf", r"""
    WITH RECURSIVE kw(w, k) AS (VALUES (0, 'thor'), (1, 'tion'), (2, 'und'), (3, 'ment')),
    n AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text, lang || (doc_id % 50) AS event FROM documents),
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) r FROM n WHERE title <> '' AND text <> '') WHERE r = 1),
    hit(doc_id, w, t, c) AS (SELECT doc_id, w, regexp_matches(title, '(?i)(^|[^A-Za-z0-9])' || k || '([^A-Za-z0-9]|$)'), regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || k || '([^A-Za-z0-9]|$)') FROM pool, kw),
    cnt AS (SELECT w, count(*) FILTER (t OR c) AS n, count(*) FILTER (t) AS tn, (SELECT count(*) FROM pool) AS p FROM hit GROUP BY w),
    idf AS (SELECT *, least(2.5, greatest(0.5, log10((p + 1) / (n + 1)) * 2)) AS idf, w = (SELECT w FROM cnt ORDER BY n, w LIMIT 1) AS rarest FROM cnt),
    s AS (SELECT doc_id, round(sum(idf * (3 * t::INT + c::INT)), 6) AS score, sum(t::INT) AS th, sum((t OR c)::INT) AS h, bool_or(t AND rarest) AS rare_title, bool_or((t OR c) AND tn < 10) AS rare FROM hit JOIN idf USING (w) GROUP BY doc_id),
    good AS (SELECT s.doc_id, score, event, list_distinct(list_transform(range(1, greatest(1, length(q))), lambda i: q[i:i + 1])) AS g FROM s JOIN pool USING (doc_id), LATERAL (SELECT regexp_replace(title, '[^\p{L}\p{N}]', '', 'g') AS q)
             WHERE th >= 1 AND h >= 2 AND (rare_title OR th >= 2 OR rare OR h >= 3)),
    pick(place, doc_id, score, taken) AS (
        SELECT 0, NULL::BIGINT, NULL::DOUBLE, []::STRUCT(doc_id BIGINT, score DOUBLE, event VARCHAR, g VARCHAR[])[]
        UNION ALL
        SELECT place + 1, b.doc_id, b.score, taken || [b] FROM (SELECT p.place, p.taken, (
            SELECT {'doc_id': x.doc_id, 'score': x.score, 'event': x.event, 'g': x.g} FROM good x
            WHERE len(list_filter(p.taken, lambda y: y.doc_id = x.doc_id OR y.event = x.event OR len(list_intersect(y.g, x.g)) / greatest(1, len(list_distinct(y.g || x.g))) >= 0.35)) = 0 ORDER BY x.score DESC, x.doc_id LIMIT 1) AS b FROM pick p WHERE place < 3) WHERE b IS NOT NULL)
    SELECT doc_id, score, place FROM pick WHERE place > 0""")
def news_rank_idf(spark, sf):
    """The first line of a document is its title."""
    news = table(spark, sf, "documents").withColumns({"title": F.get(F.split("text", "\n"), F.lit(0)), "event": F.concat("lang", F.col("doc_id") % 50), "at": F.lit(None).cast("timestamp")})
    return se.news_rank(news, "doc_id", "title", "text", "event", "at", NEWS_WORDS)


@register("newline_chunks", r"""
    WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
    cut(doc_id, a, b) AS (
        SELECT doc_id, 0, CASE WHEN n <= 700 THEN n WHEN contains(text[491:700], chr(10)) THEN 701 - strpos(reverse(text[491:700]), chr(10)) ELSE 700 END FROM d
        UNION ALL
        SELECT c.doc_id, b, CASE WHEN b + 700 >= n THEN n WHEN contains(text[b + 491:b + 700], chr(10)) THEN b + 701 - strpos(reverse(text[b + 491:b + 700]), chr(10)) ELSE b + 700 END FROM cut c JOIN d ON c.doc_id = d.doc_id WHERE b < n),
    p AS (SELECT c.doc_id, a, text[a + 1:b] AS content FROM cut c JOIN d ON c.doc_id = d.doc_id)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS chunk, md5(content) AS digest FROM p WHERE regexp_matches(content, '\S')""")
def newline_chunks(spark, sf):
    pieces = table(spark, sf, "documents").select("doc_id", F.posexplode(ch.line_chunks(F.col("text"))).alias("chunk", "content"))
    return pieces.select("doc_id", "chunk", F.md5("content").alias("digest"))


@register("chunk_merge", r"""
    WITH RECURSIVE p AS (SELECT doc_id, text, length(text) AS n, greatest((length(text) - 51 + 198) // 199, 1) AS m FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, text, m, 1 AS k, text[1:250] AS out FROM p UNION ALL
          SELECT doc_id, text, m, k + 1, CASE WHEN o IS NULL THEN out || chr(10) || b ELSE out || b[o + 1:] END FROM (
              SELECT *, list_max(list_filter(range(20, 1 + least(length(b), length(out), 400)), lambda x: right(out, x) = left(b, x))) AS o FROM (SELECT *, text[199 * k + 1:199 * k + 250] AS b FROM g WHERE k < m)))
    SELECT doc_id, md5(out) AS digest FROM g WHERE k = m""")
def chunk_merge(spark, sf):
    """Whole texts in pieces of 250 characters that overlap by 51, or by more where the text repeats itself."""
    n = F.greatest(F.floor((F.length("text") - 51 + 198) / 199), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.substr(F.col("text"), (k * 199 + 1).cast("int"), F.lit(250)))
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.md5(ch.joined_chunks(pieces)).alias("digest"))
