"""Citations of answers and delegations of notices, over acts and articles that the tables stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import citations as ct
from corpusloom.plans.registry import register
from corpusloom.session import table

#: An act for each nation, its articles numbered through its parts; answers are orders, a reference for each line.
ARTICLES_SQL = """
    WITH act AS (SELECT n_nationkey AS k, n_name || '법' AS act FROM nation),
    art AS (SELECT act, (p_partkey // 25 + 1)::VARCHAR || '조' AS no, p_brand AS title, p_size % 3 AS paras FROM part JOIN act ON k = p_partkey % 25),
"""


def articles(spark, sf):
    acts = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit("법")).alias("act"))
    n = F.col("p_size") % 3
    body = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat(F.lit("① "), "p_name")).otherwise(F.concat(F.lit("① "), "p_name", F.lit("\n② "), "p_type"))
    parts = table(spark, sf, "part").withColumn("k", (F.col("p_partkey") % 25).cast("int"))
    number = F.concat((F.floor(F.col("p_partkey") / 25) + 1).cast("string"), F.lit("조"))
    return parts.join(acts.withColumn("k", F.col("k").cast("int")), "k").select("act", number.alias("article"), F.col("p_brand").alias("title"), body.alias("text"))


@register("citation_status", ARTICLES_SQL + r"""
    line AS (
        SELECT l_orderkey AS doc, l_linenumber AS line, CASE WHEN l_suppkey % 9 = 8 THEN 'ATLANTIS법' ELSE act END AS act, l_partkey // 25 + 1 + CASE WHEN l_suppkey % 4 = 3 THEN 1000000 ELSE 0 END AS no,
               CASE WHEN l_suppkey % 5 = 4 THEN 'Other' ELSE p_brand END AS title, l_suppkey % 3 + 1 AS para
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN act ON k = l_partkey % 25),
    said AS (
        SELECT doc, line, CASE WHEN line % 4 = 1 AND doc % 5 > 0 THEN '「' || act || '」 제' || no || '조(' || title || ') 제' || para || '항에 따르면' WHEN line % 4 = 2 THEN '같은 법 제' || no || '조에서'
                               WHEN line % 4 = 3 THEN '「' || act || '」 제' || no || '조제' || para || '항은' ELSE '또 제' || no || '조는' END AS s FROM line),
    ref AS (
        SELECT doc, line, s, nullif(regexp_extract(s, '「([^」]+)」', 1), '') AS own, contains(s, '같은 법') AS same, regexp_extract(s, '제(\d+조)', 1) AS no, nullif(regexp_extract(s, '조\(([^)]*)\)', 1), '') AS title,
               nullif(regexp_extract(s, '제(\d+)항', 1), '')::INT AS para FROM said),
    anchored AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line, s ROWS UNBOUNDED PRECEDING) AS act FROM ref),
    held AS (SELECT no, count(DISTINCT act) AS n, min(act) AS one FROM art GROUP BY no),
    met AS (
        SELECT a.*, coalesce(a.act, CASE WHEN h.n = 1 THEN h.one END) AS meant, coalesce(h.n, 0) AS holders FROM anchored a LEFT JOIN held h ON h.no = a.no)
    SELECT m.doc, row_number() OVER (PARTITION BY m.doc ORDER BY line, m.s)::INT - 1 AS place, meant AS act, m.no AS article,
           CASE WHEN m.act IS NULL AND holders = 1 THEN 'guessed' WHEN own IS NOT NULL THEN 'named' WHEN m.act IS NULL THEN 'none' WHEN same THEN 'same' ELSE 'carried' END AS how,
           CASE WHEN m.act IS NULL AND holders > 1 THEN 'ambiguous' WHEN x.act IS NULL THEN 'missing' WHEN m.title IS NOT NULL AND m.title <> x.title THEN 'mismatch' WHEN para > greatest(paras, 1) THEN 'missing' ELSE 'exact' END AS status,
           CASE WHEN m.act IS NULL AND holders > 1 THEN 'several acts' WHEN m.act IS NOT NULL AND m.act = 'ATLANTIS법' THEN 'act' WHEN x.act IS NULL THEN 'article' WHEN m.title IS NOT NULL AND m.title <> x.title THEN 'title' WHEN para > greatest(paras, 1) THEN 'part' END AS reason
    FROM met m LEFT JOIN art x ON x.act = m.meant AND x.no = m.no""")
def citation_status(spark, sf):
    """Answers of one line for each line item: named, the same act, or no act at all; wrong titles, paragraphs, acts."""
    arts = articles(spark, sf)
    acts = table(spark, sf, "nation").select(F.concat("n_name", F.lit("법")).alias("own"), F.col("n_nationkey").cast("int").alias("k"))
    items = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).withColumn("k", (F.col("l_partkey") % 25).cast("int")).join(acts, "k")
    act = F.when(F.col("l_suppkey") % 9 == 8, "ATLANTIS법").otherwise(F.col("own"))
    no = (F.floor(F.col("l_partkey") / 25) + 1 + F.when(F.col("l_suppkey") % 4 == 3, 1_000_000).otherwise(0)).cast("string")
    title = F.when(F.col("l_suppkey") % 5 == 4, "Other").otherwise(F.col("p_brand"))
    para = (F.col("l_suppkey") % 3 + 1).cast("string")
    named, n = F.concat(F.lit("「"), act, F.lit("」 제"), no, F.lit("조")), F.col("l_linenumber") % 4
    said = (
        F.when((n == 1) & (F.col("l_orderkey") % 5 > 0), F.concat(named, F.lit("("), title, F.lit(") 제"), para, F.lit("항에 따르면")))
        .when(n == 2, F.concat(F.lit("같은 법 제"), no, F.lit("조에서")))
        .when(n == 3, F.concat(named, F.lit("제"), para, F.lit("항은")))
        .otherwise(F.concat(F.lit("또 제"), no, F.lit("조는")))
    )
    answers = items.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", said.alias("s")))), lambda x: x["s"]), "\n").alias("text"))
    refs = ct.cited(answers, "doc", "text", arts, "act")
    return ct.citation_status(refs, arts).select("doc", "place", "act", "article", "how", "status", "reason")


@register("notice_delegations", """
    WITH act AS (SELECT n_nationkey AS k, n_name || '법' AS act FROM nation), s AS (SELECT s_suppkey AS doc, act, s_suppkey % 7 AS v FROM supplier JOIN act ON k = s_nationkey)
    SELECT doc, 0 AS place, act AS parent, doc::VARCHAR || '조' AS article, true AS resolved, NULL AS dropped FROM s WHERE v < 6
    UNION ALL SELECT doc, 1, act || ' 시행령', '7조의2', false, NULL FROM s WHERE v < 6
    UNION ALL SELECT doc, 2, act, '9조의3', true, NULL FROM s WHERE v IN (1, 2)
    UNION ALL SELECT doc, CASE WHEN v IN (1, 2) THEN 3 ELSE 2 END, NULL, '1조', NULL, 'addendum' FROM s WHERE v IN (2, 3)""")
def notice_delegations(spark, sf):
    """Notices by supplier: an act in quotes, its decree as that of the same act, an alias, an addendum; every seventh
    one opens without the words of a purpose."""
    acts = table(spark, sf, "nation").select(F.concat("n_name", F.lit("법")).alias("act"), F.col("n_nationkey").alias("s_nationkey"))
    v = F.col("s_suppkey") % 7
    body = F.concat(
        F.when(v == 6, "1. 대상은 ").otherwise("제1조(목적) 이 고시는 "), F.lit("「"), "act", F.lit('」(이하 "법"이라 한다) 제'), "s_suppkey", F.lit("조, 같은 법 시행령 제7조의2"),
        F.when(v.isin(1, 2), " 및 법 제9조의3제1항").otherwise(""), F.when(v.isin(2, 3), ", 부칙 제1조").otherwise(""), F.lit("에 따라 위임된 사항을 정한다. 「이 밖의 법」 제3조는 따로 정한다."))
    docs = table(spark, sf, "supplier").join(acts, "s_nationkey").select(F.col("s_suppkey").alias("doc"), body.alias("text"))
    return ct.delegation_edges(docs, "doc", "text", acts, "act")
