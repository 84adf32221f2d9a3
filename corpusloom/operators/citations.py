"""References in texts against a table of articles: where acts delegate, and whether what an answer cites stands."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import references as rf
from corpusloom.session import checkpointed, ship_package

#: Names that a registry may have: the scanner holds them in each worker.
MOST_NAMES = 500_000


def _names(registry: DataFrame, name: str, most: int = MOST_NAMES) -> list[str]:
    """The distinct names of a registry of acts, which a country has some tens of thousands of."""
    rows = registry.select(F.trim(F.col(name)).alias("n")).filter("n <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names: scan with the registries of parts of the acts")
    return [r["n"] for r in rows]


def delegation_edges(docs: DataFrame, doc: str, text: str, registry: DataFrame, name: str, aliases: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """doc, place, parent, article, resolved, dropped: the articles of acts that each document's first article is based
    on, in order; resolved says whether the registry has the parent. Rows that tell what was dropped, and why, have no
    parent. Documents of which nothing is read have no rows; strict: see basis_of()."""
    names = _names(registry, name)
    kind = docs.schema[doc].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rf.Names(names, aliases)
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, dropped = rf.delegations(rf.basis_of(body or "", strict), known)
                rows += [(key, k, *x, None) for k, x in enumerate(found)]
                rows += [(key, len(found) + k, None, words, None, why) for k, (words, why) in enumerate(dropped)]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [doc, "place", "parent", "article", "resolved", "dropped"])

    ship_package(docs.sparkSession)
    return docs.select(doc, text).mapInArrow(scan, f"`{doc}` {kind}, place int, parent string, article string, resolved boolean, dropped string")


def cited(answers: DataFrame, answer: str, text: str, registry: DataFrame, name: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """answer, place, act, how, article, title, paras, items, candidates: a row for each reference of each answer."""
    names = _names(registry, name)
    kind = answers.schema[answer].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rf.Names(names, aliases)
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(key, k, c.act, c.how, c.article, c.title, c.paras, c.items, c.candidates) for k, c in enumerate(rf.citations(body or "", known))]
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            kinds = [batch.schema.field(0).type, pa.int32(), *[pa.string()] * 4, pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [answer, "place", "act", "how", "article", "title", "paras", "items", "candidates"])

    ship_package(answers.sparkSession)
    return answers.select(answer, text).mapInArrow(scan, f"`{answer}` {kind}, place int, act string, how string, article string, title string, paras array<int>, items array<string>, candidates array<string>")


def paragraphs_in(text: Column) -> Column:
    """The numbers of an article's paragraphs (circled signs at the start of a line or of the text)."""
    signs = F.regexp_extract_all(text, F.lit(r"(?m)^\s*([①-⑳])"), F.lit(1))
    return F.transform(signs, lambda s: F.instr(F.lit(rf.CIRCLED), s))


def items_in(text: Column) -> Column:
    """The numbers of its items ("5.", "5의2." at the start of a line)."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*(\d+(?:의\d+)?)\.\s"), F.lit(1))


def citation_status(refs: DataFrame, articles: DataFrame, act: str = "act", article: str = "article", title: str = "title", text: str = "text") -> DataFrame:
    """refs (of cited()) with status and reason. articles has one row for each act and article: its title and text.

    exact: the act has the article, with the title that stands in brackets behind the reference (if any), and with all
    cited paragraphs and items. An article without numbered paragraphs has its first. mismatch: the article has another
    title. missing: the act has no such article ("article"), the article lacks a paragraph or item ("part"), or the
    registry does not have the act ("act"). ambiguous: the words before the reference end several names, of which not
    exactly one has the article, or no act is spoken of at all and several acts have it; if exactly one has it, that act
    is taken (how: guessed), and if none has it, it is missing.

    Titles are compared without white space and middle dots. Articles are joined by act and number; only references
    without an act are joined by number, against a row a number (acts counted, the first two kept).
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s·ㆍ‧•]+", "")
    rows = articles.select(F.col(act).alias("_act"), F.col(article).alias("_no"), bare(F.col(title)).alias("_title"), paragraphs_in(F.col(text)).alias("_paras"), items_in(F.col(text)).alias("_items"))
    rows = rows.dropDuplicates(["_act", "_no"]) if articles.isStreaming else rows
    acts = articles.select(F.col(act).alias("_known")).distinct()
    refs = refs if refs.isStreaming else checkpointed(refs)  # read three times below, scanned once
    open_ = F.col("act").isNull() & (F.size("candidates") == 0)
    several = F.size("candidates") > 0

    # Which act is meant: the one named; of several candidates those that have the article; without one, all that have it.
    holders = rows.groupBy(F.col("_no").alias("_n")).agg(F.count_distinct("_act").alias("_holders"), F.min("_act").alias("_holder"))
    chosen = refs.filter(several).select("*", F.explode("candidates").alias("_c")).join(rows.select("_act", "_no"), (F.col("_c") == F.col("_act")) & (F.col("article") == F.col("_no")), "left")
    keys = [c for c in refs.columns if c not in ("candidates", "paras", "items")]
    chosen = chosen.groupBy(*keys).agg(F.first("paras").alias("paras"), F.first("items").alias("items"), F.first("candidates").alias("candidates"), F.count("_act").alias("_holders"), F.min("_act").alias("_holder"))
    guessed = refs.filter(open_).join(holders, F.col("article") == F.col("_n"), "left").select(*refs.columns, F.coalesce("_holders", F.lit(0).cast("long")).alias("_holders"), "_holder")
    named = refs.filter(~open_ & ~several).select(*refs.columns, F.lit(None).cast("long").alias("_holders"), F.lit(None).cast("string").alias("_holder"))
    meant = named.unionByName(chosen.select(*refs.columns, "_holders", "_holder")).unionByName(guessed)
    meant = meant.withColumn("how", F.when(F.col("_holders") == 1, "guessed").otherwise(F.col("how"))).withColumn("act", F.when(F.col("_holders") == 1, F.col("_holder")).when(F.col("_holders").isNull(), F.col("act")))

    met = meant.join(rows, (F.col("act") == F.col("_act")) & (F.col("article") == F.col("_no")), "left").join(acts, F.col("act") == F.col("_known"), "left")
    paras = F.size(F.array_except("paras", F.when(F.size("_paras") > 0, F.col("_paras")).otherwise(F.array(F.lit(1))))) > 0
    items = F.size(F.array_except("items", F.coalesce("_items", F.array().cast("array<string>")))) > 0
    case = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    verdict = (
        F.when(F.col("_holders") > 1, case("ambiguous", "several acts"))
        .when(F.col("_holders") == 0, case("missing", "article"))
        .when(F.col("_known").isNull(), case("missing", "act"))
        .when(F.col("_no").isNull(), case("missing", "article"))
        .when(F.col("title").isNotNull() & (bare(F.col("title")) != F.col("_title")), case("mismatch", "title"))
        .when(paras | items, case("missing", "part"))
        .otherwise(case("exact", None))
    )
    return met.withColumn("_v", verdict).select(*refs.columns, "_v.status", "_v.reason")
