"""Keyed tables: inserts, replacements, retention, versions, diffs. Every choice among rows ends on a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (the last sort key should be unique)."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored, and those incoming rows whose keys it lacks; of incoming rows with equal keys, one."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(keys), keys, "left_anti"))


def replace_groups(stored: DataFrame, incoming: DataFrame, group: list[str]) -> DataFrame:
    """stored with whole groups replaced by their incoming rows."""
    return stored.join(incoming.select(group).distinct(), group, "left_anti").unionByName(incoming)


def retain(df: DataFrame, at: Column, clock: Column, days: int, locked: Column | None = None) -> DataFrame:
    """Rows not older than days, and locked ones."""
    fresh = at >= clock - F.make_dt_interval(F.lit(days))
    return df.filter(fresh if locked is None else fresh | F.coalesce(locked, F.lit(False)))


def prune_stale(df: DataFrame, parent: list[str], synced: str) -> DataFrame:
    """Of each parent, the rows that its latest run refreshed."""
    return df.withColumn("_last", F.max(synced).over(W.partitionBy(*parent))).filter(F.col(synced) == F.col("_last")).drop("_last")


def renumber(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """A dense index from 0 within each group."""
    return df.withColumn(out, (F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1).cast("long"))


def chunk_ledger(chunks: DataFrame, doc: str, index: str) -> DataFrame:
    """For each document: chunks, first and last index, and whether the indexes are gapless from 0."""
    out = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("chunks"), F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count_distinct(index).alias("_d"))
    whole = (F.col("first_index") == 0) & (F.col("last_index") == F.col("chunks") - 1) & (F.col("_d") == F.col("chunks"))
    return out.withColumn("complete", whole).drop("_d")


def revisions(df: DataFrame, keys: list[str], order: list[Column], text: Column) -> DataFrame:
    """A revision number from 1 that grows when the cleaned text changes."""
    w = W.partitionBy(*keys).orderBy(*order)
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    changed = ~clean.eqNullSafe(F.lag(clean).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("_changed", changed.cast("int")).withColumn("revision", F.sum("_changed").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_changed")


def in_force(df: DataFrame, keys: list[str], effective: str, today: Column, tie: str) -> DataFrame:
    """Of each key the latest version not after today, or else the earliest of the future. Effective dates are instants,
    dates or yyyymmdd text, of the kind of today."""
    past = F.col(effective) <= today
    return first_per(df, keys, past.desc(), F.when(past, F.col(effective)).desc(), F.col(effective).asc(), F.col(tie).desc())


def pending(df: DataFrame, keys: list[str], effective: str, serial: str, today: Column) -> DataFrame:
    """One row for each future effective date of a key: the one with the largest serial."""
    return first_per(df.filter(F.col(effective) > today), [*keys, effective], F.col(serial).desc())


def promotion(df: DataFrame, keys: list[str], effective: str, serial: str, today: Column) -> DataFrame:
    """Adds state: of the due versions the last is current and the others superseded; the rest are pending."""
    due = F.col(effective) <= today
    place = F.row_number().over(W.partitionBy(*keys, due).orderBy(F.col(effective).desc(), F.col(serial).desc()))
    return df.withColumn("state", F.when(~due, "pending").when(place == 1, "current").otherwise("superseded"))


def drop_noops(df: DataFrame, keys: list[str], order: list[Column], text: Column) -> DataFrame:
    """Versions whose text, white space aside, differs from the one before; versions that say that they were deleted (see
    DELETED) are left out, but are what the next one is compared with."""
    w = W.partitionBy(*keys).orderBy(*order)
    bare = F.regexp_replace(text, r"\s+", "")
    return df.withColumn("_bare", bare).withColumn("_was", F.lag("_bare").over(w)).filter(~F.col("_bare").eqNullSafe(F.col("_was")) & ~F.coalesce(text.rlike(DELETED), F.lit(False))).drop("_bare", "_was")


#: Fixed value: how a text says that its article was deleted.
DELETED = r"^제\s*[0-9]+조(?:의[0-9]+)?(?:\([^)]*\))?\s*삭제"


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], text: str, deleted: str = DELETED) -> DataFrame:
    """keys, change, old_text, new_text of rows that are added, deleted or modified.

    White space does not count. A new text that carries the mark of deletion (a pattern) is a deletion, also where there
    was no old text; one that carried it before is not deleted again. The text that is missing is empty.
    """
    a = old.select(*keys, F.col(text).alias("_old"))
    b = new.select(*keys, F.col(text).alias("_new"))
    both = a.join(b, keys, "full_outer")
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    marked = lambda c: F.coalesce(F.regexp_like(F.trim(c), F.lit(deleted)), F.lit(False))
    had, has = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    change = (
        F.when(had & ~has, "deleted")
        .when(has & ~had, F.when(marked(F.col("_new")), "deleted").otherwise("added"))
        .when(marked(F.col("_new")) & ~marked(F.col("_old")), "deleted")
        .when(bare(F.col("_old")) != bare(F.col("_new")), "modified")
    )
    empty = F.lit("")
    return both.withColumn("change", change).filter("change is not null").select(*keys, "change", F.coalesce("_old", empty).alias("old_text"), F.coalesce("_new", empty).alias("new_text"))


def changes(stored: DataFrame, seen: DataFrame, keys: list[str], status: str, tags: str, fill: str) -> DataFrame:
    """Upsert with detection: keys, status, tags (union), fill (kept unless empty) and what happened to each row."""
    s = stored.select(*keys, F.col(status).alias("_s"), F.col(tags).alias("_t"), F.col(fill).alias("_f"), F.lit(True).alias("_had"))
    n = seen.select(*keys, F.col(status).alias("_s2"), F.col(tags).alias("_t2"), F.col(fill).alias("_f2"), F.lit(True).alias("_has"))
    both = s.join(n, keys, "full_outer")
    what = F.when(F.col("_had").isNull(), "new").when(F.col("_has").isNull(), "gone").when(~F.col("_s").eqNullSafe(F.col("_s2")), "status_changed").otherwise("unchanged")
    none = F.array().cast("array<string>")
    merged = F.array_sort(F.array_union(F.coalesce("_t", none), F.coalesce("_t2", none)))
    return both.select(*keys, what.alias("what"), F.coalesce("_s2", "_s").alias(status), merged.alias(tags), F.coalesce(F.when(F.col("_f") != "", F.col("_f")), "_f2").alias(fill))


def known(candidates: DataFrame, stored: DataFrame, url: str, title: str) -> DataFrame:
    """Candidates already stored, by url or by title: adds known_by."""
    urls = stored.select(F.col(url).alias("_u")).distinct()
    titles = stored.select(F.col(title).alias("_n")).distinct()
    out = candidates.join(urls, F.col(url) == F.col("_u"), "left").join(titles, F.col(title) == F.col("_n"), "left")
    by = F.when(F.col("_u").isNotNull(), "url").when(F.col("_n").isNotNull(), "title")
    return out.withColumn("known_by", by).drop("_u", "_n").filter("known_by is not null")


def resolve_names(names: DataFrame, name: str, registry: DataFrame, renamed: DataFrame) -> DataFrame:
    """Adds resolved and how: exact name, else a renamed one, else the only loose match. registry: name; renamed: old, new.

    Exact keys ignore spaces and middle dots; loose keys also drop a trailing filler.
    """
    key = lambda c: F.lower(F.regexp_replace(c, r"[\s·ㆍ]+", ""))
    loose = lambda c: F.regexp_replace(key(c), r"(act|law|의)$", "")
    exact = registry.select(key(F.col("name")).alias("_k"), F.col("name").alias("_exact")).dropDuplicates(["_k"])
    moved = renamed.select(key(F.col("old")).alias("_o"), F.col("new").alias("_moved")).dropDuplicates(["_o"])
    near = registry.groupBy(loose(F.col("name")).alias("_l")).agg(F.min("name").alias("_near"), F.count_distinct("name").alias("_n")).filter("_n = 1").drop("_n")
    out = names.withColumn("_q", key(F.col(name))).withColumn("_ql", loose(F.col(name)))
    out = out.join(exact, F.col("_q") == F.col("_k"), "left").join(moved, F.col("_q") == F.col("_o"), "left").join(near, F.col("_ql") == F.col("_l"), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_moved").isNotNull(), "renamed").when(F.col("_near").isNotNull(), "loose")
    return out.withColumn("resolved", F.coalesce("_exact", "_moved", "_near")).withColumn("how", how).drop("_q", "_ql", "_k", "_exact", "_o", "_moved", "_l", "_near")


#: Fixed value: the head of an article in a table of old and new texts.
PARALLEL_HEAD = r"^제\s*[0-9]+조(?:의[0-9]+)?"


def parallel_changes(lines: DataFrame, doc: str, order: str, old: str, new: str) -> DataFrame:
    """doc, key, change, old_text, new_text: a table of old and new lines, side by side, as changes of articles.

    An article starts where either side has its head; lines before the first are dropped. Without a head on the old side
    it was added, without one on the new side, or with the mark of deletion there, deleted; else modified. Lines with equal
    order are taken by their old and then their new text, so the result does not hang on the order of rows.
    """
    head = lambda c: F.col(c).rlike(PARALLEL_HEAD)
    rows = lines.select(F.col(doc).alias("d"), F.col(order).alias("at"), *[F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"</?P>", "")).alias(n) for c, n in ((old, "o"), (new, "n"))])
    w = W.partitionBy("d").orderBy("at", "o", "n")
    rows = rows.withColumn("g", F.sum((head("o") | head("n")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("g > 0")
    groups = rows.groupBy("d", "g").agg(F.array_sort(F.collect_list(F.struct("at", "o", "n"))).alias("ls"))
    text = lambda side: F.array_join(F.filter(F.col(f"ls.{side}"), lambda x: x != ""), "\n")
    groups = groups.select(F.col("d").alias(doc), F.col("ls")[0]["o"].alias("o"), F.col("ls")[0]["n"].alias("n"), text("o").alias("old_text"), text("n").alias("new_text"))
    had, has, empty = head("o"), head("n"), F.lit("")
    gone = F.trim(F.regexp_replace("new_text", r"\s+", " ")).rlike(DELETED)
    change = F.when(~had & has, "added").when(had & ~has, "deleted").when(gone, "deleted").otherwise("modified")
    key = F.regexp_replace(F.regexp_extract(F.when(has, F.col("n")).otherwise(F.col("o")), r"^제?\s*([0-9]+조(?:의[0-9]+)?)", 1), r"\s", "")
    out = groups.select(doc, key.alias("key"), change.alias("change"), F.when(change == "added", empty).otherwise(F.col("old_text")).alias("old_text"), F.when(had & ~has, empty).otherwise(F.col("new_text")).alias("new_text"))
    return out.filter("key != ''")


def drift(summaries: DataFrame, watched: DataFrame, renamed: DataFrame, today: str) -> DataFrame:
    """path, title, own_no, own_enf, now_no, now_enf, now_doc, renamed_to: summaries that are behind the version that is watched.

    summaries: path, title, agency, number, enforced; watched: doc_name of the form name(agency)(number)(yyyymmdd); renamed:
    old, new. Names are compared without white space, dots, notes on future versions and numbers behind them; a name that
    nobody watches is looked up among the renamed. Summaries of versions to come are left out, as are names that only
    another agency has. Numbers are compared without leading zeros.
    """
    digits = lambda c: F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", ""), 1, 8)
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\[시행예정[^\]]*\]\s*$", ""), r"\s*\([^()]*호\)\s*$", ""), r"[\sㆍ·‧•]", "")
    number = lambda c: F.array_join(F.transform(F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9\-]", ""), "-"), lambda p: p != ""), lambda p: F.coalesce(F.nullif(F.regexp_replace(p, "^0+", ""), F.lit("")), F.lit("0"))), "-")
    tidy = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    form = r"^(.+?)\(([^()]+)\)\((제[^()]*호)\)\((\d{8})\)\s*$"
    part = lambda i: F.regexp_extract("doc_name", form, i)
    docs = watched.filter(F.col("doc_name").rlike(form)).select("doc_name", bare(part(1)).alias("w"), tidy(part(2)).alias("a"), part(3).alias("no"), part(4).alias("enf"))
    rows = summaries.withColumns({"_n": bare(F.col("title")), "_a": tidy(F.col("agency")), "_e": digits(F.col("enforced"))}).filter((F.col("number") != "") & (F.col("_e") != "") & (F.col("_e") <= today))
    known = docs.select(F.col("w").alias("_k")).distinct()
    moved = renamed.select(bare(F.col("old")).alias("_o"), F.col("new").alias("_to")).dropDuplicates(["_o"])
    rows = rows.join(known, F.col("_n") == F.col("_k"), "left").join(moved, F.col("_n") == F.col("_o"), "left")
    rows = rows.withColumn("_to", F.when(F.col("_k").isNull(), F.col("_to"))).withColumn("_name", F.coalesce("_k", bare(F.col("_to"))))
    met = rows.join(docs, (F.col("_name") == F.col("w")) & ((F.col("_a") == "") | (F.col("_a") == F.col("a"))))
    best = met.groupBy("path", "title", "number", "_e", "_to").agg(F.max(F.struct("enf", "no", "doc_name")).alias("b"))
    behind = (F.col("b.enf") != F.col("_e")) | (number(F.col("b.no")) != number(F.col("number")))
    return best.filter(behind).select("path", F.regexp_replace("title", r"\s*\[시행예정[^\]]*\]\s*$", "").alias("title"), F.col("number").alias("own_no"), F.col("_e").alias("own_enf"), F.col("b.no").alias("now_no"), F.col("b.enf").alias("now_enf"), F.col("b.doc_name").alias("now_doc"), F.col("_to").alias("renamed_to"))


def watch(stored: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """key, source, hash, what: the next state of watched items, and what happened to each: new, changed, same, kept or gone.

    stored, fresh: key, source, hash; sources: source, ok (whether this run could read it). Items of a source that failed
    keep their state. Items that are gone are in the result, so that they can be told; the next state leaves them out.
    """
    old = stored.select("key", F.col("source").alias("_s"), F.col("hash").alias("_h"))
    both = old.join(fresh.select("key", "source", "hash"), "key", "full_outer")
    both = both.join(sources.select(F.col("source").alias("_src"), "ok"), F.col("_s") == F.col("_src"), "left")
    ok = F.coalesce("ok", F.lit(False))
    what = F.when(F.col("_s").isNull(), "new").when(F.col("source").isNotNull(), F.when(F.col("hash").eqNullSafe(F.col("_h")), "same").otherwise("changed")).when(ok, "gone").otherwise("kept")
    return both.select("key", F.coalesce("source", "_s").alias("source"), F.when(F.col("source").isNotNull(), F.col("hash")).otherwise(F.col("_h")).alias("hash"), what.alias("what"))


def swapped(spark, df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Replaces the table at path by df and returns the new one, or fails and leaves the old one in place.

    df is written beside path, read back and compared by row count, by a digest of all columns and by distinct keys; only
    then the old table makes way by renames. A run that dies in between leaves either table whole under one of the two names.
    """
    import uuid

    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    proof = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)")), F.count_distinct(*keys)).first())
    if proof(spark.read.schema(df.schema).parquet(fresh)) != proof(df):
        raise RuntimeError(f"the copy at {fresh} is not what was to be written")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(hadoop(path))
    if had:
        files.rename(hadoop(path), hadoop(old))
    if not files.rename(hadoop(fresh), hadoop(path)):
        if had:
            files.rename(hadoop(old), hadoop(path))
        raise RuntimeError(f"{path} could not be replaced")
    if had:
        files.delete(hadoop(old), True)
    return spark.read.schema(df.schema).parquet(path)
