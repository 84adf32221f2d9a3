"""Text expressions: all built in, so that they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop-words of title tokens in the bundled languages of the sample tables.
STOP_WORDS = ("the", "and", "of", "to", "a", "in", "is", "that", "de", "la", "le", "der", "die", "und", "el", "los")


def squeezed(text: Column) -> Column:
    """Without any white space or middle dots: the form in which texts are compared."""
    return F.regexp_replace(text, r"[\s·ㆍ]+", "")


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct lower-case words of at least least letters or digits, without stop-words, in order of appearance."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}]{{{least},}}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)))


def bigrams(text: Column) -> Column:
    """All character pairs of the squeezed text, in order."""
    pairs = lambda t: F.when(F.length(t) >= 2, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(squeezed(text)), pairs), F.lit(0))  # the text is squeezed once, not for each pair


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty ones are 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def article_key(text: Column) -> Column:
    """The article number at the head of a reference, `12` or `12-3`, or null."""
    number, branch = F.regexp_extract(text, r"^\s*(?:제)?(\d+)조(?:의(\d+))?", 1), F.regexp_extract(text, r"^\s*(?:제)?(\d+)조(?:의(\d+))?", 2)
    return F.when(number == "", None).when(branch == "", number).otherwise(F.concat_ws("-", number, branch))


def article_order(key: Column) -> list[Column]:
    """Sort keys that put 48-3 after 48 and before 49."""
    parts = F.split(key, "-")
    return [F.get(parts, F.lit(0)).cast("int"), F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0))]


def document_name(name: Column) -> Column:
    """struct(title, kind, number, date) of `title(kind)(number)(yyyymmdd)`; missing parts are null."""
    part = lambda i: F.nullif(F.regexp_extract(name, r"^([^(]+?)\s*(?:\(([^()]*)\))?(?:\(([^()]*)\))?(?:\((\d{8})\))?$", i), F.lit(""))
    return F.struct(F.trim(part(1)).alias("title"), part(2).alias("kind"), part(3).alias("number"), part(4).alias("date"))


def plain(html: Column) -> Column:
    """HTML without scripts, styles, comments and tags, with the common entities resolved and white space squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def title(html: Column) -> Column:
    """og:title, else twitter:title, else the title element."""
    meta = lambda key: F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]+(?:property|name)="{key}"[^>]+content="([^"]*)"', 1), F.lit(""))
    return F.coalesce(meta("og:title"), meta("twitter:title"), F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))


def clipped(text: Column, most: int) -> Column:
    """At most most characters, cut after the last sentence end among them if there is one."""
    head = F.substr(text, F.lit(1), F.lit(most))
    upto = F.regexp_extract(head, r"(?s)^(.*[.!?。])", 1)
    return F.when(F.length(text) <= most, text).when(upto != "", upto).otherwise(head)


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the squeezed text."""
    return F.substr(F.sha2(squeezed(text), 256), F.lit(1), F.lit(16))


def keyword_hit(text: Column, keyword: Column) -> Column:
    """Keywords with Latin letters ignore case; others are exact substrings."""
    return F.when(keyword.rlike("[A-Za-z]"), F.contains(F.lower(text), F.lower(keyword))).otherwise(F.contains(text, keyword))


def guarded_hit(text: Column, word: str, before: str = "", after: str = "") -> Column:
    """word occurs at least once without one of the vetoed characters right before or after it."""
    import re

    look = (f"(?<![{re.escape(before)}])" if before else "") + re.escape(word) + (f"(?![{re.escape(after)}])" if after else "")
    return text.rlike(look)


def any_date(text: Column) -> Column:
    """The first of the common notations that parses, as a date."""
    digits = F.regexp_extract(text, r"(\d{4})[-./년]?\s*(\d{1,2})[-./월]?\s*(\d{1,2})", 0)
    y, m, d = (F.regexp_extract(digits, r"(\d{4})\D*(\d{1,2})\D*(\d{1,2})", i) for i in (1, 2, 3))
    return F.when(digits != "", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common substring: one step for each character of a, as the best can grow by one at a time."""
    grown = lambda best, end: best + F.contains(b, F.substr(a, end - best, best + 1)).cast("int")
    found = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda best, end: grown(best, end))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), found).when(a.isNotNull() & b.isNotNull(), 0)
