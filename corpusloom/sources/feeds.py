"""Landed files as DataFrames: keyword news (JSON), RSS and Atom feeds, pages with links, law articles, whole-text notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import chunks as ch
from corpusloom.functions import text as tx

#: Fixed value: the date notation of feeds, after the day's name.
FEED_DATE = "dd MMM yyyy HH:mm:ss Z"


def news_json(spark: SparkSession, path: str) -> DataFrame:
    """keyword, title, url, snippet, published_at of landed search results: {keyword, items: [{title, link, description, pubDate}]}."""
    item = "struct<title:string,link:string,originallink:string,description:string,pubDate:string>"
    rows = spark.read.schema(f"keyword string, items array<{item}>").option("multiLine", True).json(path).select("keyword", F.explode("items").alias("i"))
    when = F.try_to_timestamp(F.substring("i.pubDate", 6, 40), F.lit(FEED_DATE))  # the day's name is redundant
    return rows.select("keyword", tx.plain(F.col("i.title")).alias("title"), F.coalesce("i.originallink", "i.link").alias("url"), tx.plain(F.col("i.description")).alias("snippet"), when.alias("published_at"))


def with_fallback(primary: DataFrame, secondary: DataFrame, failed_share: float, least: int = 5) -> DataFrame:
    """The fallback is read too if over half of the keywords failed or the primary has too few rows (at most least are looked at)."""
    short = len(primary.limit(least).collect()) < least
    return primary.unionByName(secondary) if failed_share > 0.5 or short else primary


def feed_xml(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """title, url, published_at of RSS 2.0 items (row_tag item) or Atom entries (row_tag entry)."""
    if row_tag == "entry":
        schema = "title string, link struct<_href:string>, updated string"
        rows = spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)
        return rows.select(tx.plain(F.col("title")).alias("title"), F.col("link._href").alias("url"), F.try_to_timestamp("updated").alias("published_at"))
    rows = spark.read.format("xml").schema("title string, link string, pubDate string").option("rowTag", row_tag).load(path)
    return rows.select(tx.plain(F.col("title")).alias("title"), "link", F.try_to_timestamp(F.substring("pubDate", 6, 40), F.lit(FEED_DATE)).alias("published_at")).withColumnRenamed("link", "url")


def board_rows(pages: DataFrame, page_id: str, html: str, row: str, fields: dict[str, str]) -> DataFrame:
    """Items of board pages: each match of the row pattern, with each field's first group cleaned; dates stay text."""
    rows = pages.select(page_id, F.posexplode(F.regexp_extract_all(html, F.lit(row), F.lit(0))).alias("pos", "row"))
    return rows.select(page_id, "pos", *[F.nullif(tx.plain(F.regexp_extract("row", p, 1)), F.lit("")).alias(n) for n, p in fields.items()])


def page_articles(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """page_id, title, body, links, published: what an article page says."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1), F.lit("")), F.col(html))
    return pages.select(page_id, tx.title(F.col(html)).alias("title"), tx.plain(body).alias("body"), F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("links"), tx.any_date(F.regexp_extract(html, r'(?is)(?:published_time"[^>]*content="|datetime=")([^"]*)"', 1)).alias("published"))


def law_articles(spark: SparkSession, path: str) -> DataFrame:
    """law, unit (article, addendum, annex), no, content of landed law texts, in one table."""
    unit = "array<struct<no:string,content:string>>"
    rows = spark.read.schema(f"law string, articles {unit}, addenda {unit}, annexes {unit}").option("multiLine", True).json(path)
    parts = [rows.select("law", F.lit(name[:-1] if name != "addenda" else "addendum").alias("unit"), F.posexplode(name).alias("pos", "u")) for name in ("articles", "addenda")]
    parts.append(rows.select("law", F.lit("annex").alias("unit"), F.posexplode("annexes").alias("pos", "u")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("law", "unit", "pos", F.col("u.no").alias("no"), F.col("u.content").alias("content"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """path, meta (map of the front matter), body of whole-text markdown files."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    front, body = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 1), F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 2)
    pairs = F.filter(F.transform(F.split(front, "\n"), lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.regexp_replace(s, r"^[^:]*:\s*", "")).alias("v"))), lambda p: p["k"] != "")
    meta = F.when(front != "", F.map_from_entries(pairs))
    return whole.select("path", meta.alias("meta"), F.when(front != "", body).otherwise(F.col("value")).alias("body"))


def header_chunks(docs: DataFrame, keys: list[str], title: str, body: str, size: int = 1000, overlap: int = 100, least: int = 30) -> DataFrame:
    """keys, chunk: the pieces of chunks.header_chunks(), a row each."""
    return docs.select(*keys, F.explode(ch.header_chunks(F.col(body), F.col(title), size, overlap, least)).alias("chunk"))


def complete(body, kind_end: str | None = None):
    """Whether a text seems whole: its tail is no letter or digit, or it ends with the kind's own mark."""
    tail = F.trim(body).rlike(r"[^\p{L}\p{N}]\z")
    return tail if kind_end is None else tail | F.trim(body).rlike(kind_end + r"\z")
