"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import let, unused, written

#: Fractional copies that one block of the reduction tree rounds in a row.
BLOCK = 128
#: Copies of one row that one array numbers.
RUN = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Of sizes (source, size, n): each source's target, out of share times all sizes.

    Sources, by code point with null last, weigh weights, repeating. A target stops at most times its source's size and
    the excess goes to the others by weight, until none is above: the fixed point is found at once, by filling sources
    in the order of cap over weight. The table has a row for each source.
    """
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order - 1) % len(weights) + 1))
    weighed = weighed.withColumn("cap", F.lit(float(most)) * F.col("size"))
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = filling.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = weighed.withColumns({
        "all": F.lit(float(share)) * F.sum("size").over(whole),
        "left": F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"),
        "gone": F.sum("cap").over(upto) - F.col("cap"),
    })
    level = level.withColumn("full", F.col("cap") * F.col("left") <= F.col("weight") * (F.col("all") - F.col("gone")))
    rate = (F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)) / F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(whole)
    target = F.when(F.col("full"), F.col("cap")).otherwise(rate * F.col("weight"))
    return level.select("source", F.col("size").alias("source_size"), "n", target.cast("double").alias("target"))


def _round_block(items: Column, seed: int) -> Column:
    """Folds the items (h, doc_id, size, copy, p) of one block, in order of h.

    Two fractional items trade words: one gives to the other until one of them has a probability of 0 or 1. The
    direction is drawn so that each probability keeps its mean; the words expected of the pair stay the same. The
    result has the decided items (x is 0 or 1) and at most one item that is still fractional.
    """
    item = "struct<h:bigint,doc_id:bigint,size:bigint,copy:int,p:double>"
    decided = "array<struct<doc_id:bigint,size:bigint,copy:int,x:int>>"

    def decide(i: Column, x: Column) -> Column:
        return F.array(F.struct(i["doc_id"].alias("doc_id"), i["size"].alias("size"), i["copy"].alias("copy"), x.cast("int").alias("x")))

    def with_p(i: Column, p: Column) -> Column:
        return F.struct(i["h"].alias("h"), i["doc_id"].alias("doc_id"), i["size"].alias("size"), i["copy"].alias("copy"), p.alias("p"))

    def state(cur: Column, out: Column) -> Column:
        return F.struct(cur.cast(item).alias("cur"), out.cast(decided).alias("out"))

    def pair(s: Column, b: Column) -> Column:
        a = s["cur"]
        give = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])  # words that a can give to b
        take = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), a["h"], b["h"]), 11) * F.lit(2.0**-53)

        def trade(t: Column) -> Column:
            words = F.when(t["u"] * (t["give"] + t["take"]) < t["take"], -t["give"]).otherwise(t["take"])  # what a gains
            return let(F.struct(_snap(a["p"] + words / a["size"]).alias("pa"), _snap(b["p"] - words / b["size"]).alias("pb")), settle)

        def settle(q: Column) -> Column:
            a_done, b_done = q["pa"].isin(0.0, 1.0), q["pb"].isin(0.0, 1.0)
            gone = F.concat(
                F.filter(decide(a, q["pa"]), lambda _: a_done),
                F.filter(decide(b, q["pb"]), lambda _: b_done),
            )
            cur = F.when(~a_done, with_p(a, q["pa"])).when(~b_done, with_p(b, q["pb"]))
            return state(cur, F.concat(s["out"], gone))

        return let(F.struct(give.alias("give"), take.alias("take"), draw.alias("u")), trade)

    return F.aggregate(items, state(F.lit(None), F.array()), lambda s, b: F.when(s["cur"].isNull(), state(b, s["out"])).otherwise(pair(s, b)))


def _snap(p: Column) -> Column:
    return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)


def mix_sizes(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """Of sizes (source, doc_id, size): each row's copies, with the words of each source near its target.

    A row of a source with target t and size s is due t/s copies. The whole part is certain; the fractions are rounded
    by the pivotal method. Rows are hashed into blocks of about BLOCK within their source; each block rounds all but at
    most one of them; the residuals go up a tree of such blocks, one level for each power of BLOCK in the largest
    source, and the last residual of a source is drawn. A source's words thus differ from its target by less than its
    largest document.

    Returns source, doc_id, size, copies (int), source_size, target; one row for each row of sizes. Rows alike in all
    three columns are counted first and numbered, RUN at a time, so a hot key is no hot group. A null source is a source, null ids are
    kept, rows of size 0 get the whole part only. The hash is seeded: reruns agree. Empty tables stay empty.
    """
    counted = written(sizes.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")), "mix-rows")
    per = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.sum("m").alias("n"))
    per = written(source_targets(per, weights, share, most), "mix-sources")
    most_rows = per.agg(F.max("n")).first()[0] or 0
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("due", due).withColumn("base", F.floor(_snap_up(F.col("due")))).withColumn("p", F.greatest(F.lit(0.0), F.col("due") - F.col("base")))
    per = per.select(F.col("source").alias("s2"), "source_size", "n", "target", F.col("base").cast("int").alias("base"), _snap(F.col("p")).alias("p"))
    runs = counted.select("source", "doc_id", "size", "m", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / RUN))).alias("run"))
    rows = runs.select("source", "doc_id", "size", F.explode(F.sequence(F.col("run") * RUN + 1, F.least("m", (F.col("run") + 1) * RUN))).alias("copy"))
    rows = rows.withColumn("copy", F.col("copy").cast("int"))
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    free = (F.col("size") > 0) & (F.col("p") > 0)
    h = F.xxhash64(F.lit(seed), "source", "doc_id", "size", "copy")
    items = rows.filter(free).select("source", "n", h.alias("h"), "doc_id", "size", "copy", "p")
    width, done = float(BLOCK), [rows.filter(~free).select("source", "doc_id", "size", F.lit(0).alias("x"))]
    while True:
        blocks = F.ceil(F.col("n") / F.lit(width))
        level = items.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), blocks))
        level = level.groupBy("source", "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("h", "doc_id", "size", "copy", "p"))).alias("items"))
        level = written(level.select("source", "n", _round_block(F.col("items"), seed).alias("r")), "mix-level")
        done.append(level.select("source", F.explode("r.out").alias("o")).select("source", "o.doc_id", "o.size", "o.x"))
        items = level.filter(F.col("r.cur").isNotNull()).select("source", "n", "r.cur.*")
        if width >= most_rows:
            break
        width *= BLOCK
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "h"), 11) * F.lit(2.0**-53)
    done.append(items.select("source", "doc_id", "size", (draw < F.col("p")).cast("int").alias("x")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = out.join(per, F.col("source").eqNullSafe(F.col("s2")))
    return out.select("source", "doc_id", "size", (F.col("base") + F.col("x")).cast("int").alias("copies"), "source_size", "target")


def _snap_up(due: Column) -> Column:
    return F.when(F.ceil(due) - due < 1e-9, F.ceil(due)).otherwise(due)


def word_count(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """mix_sizes over documents whose size is their number of words. Null texts have no words; very long texts are counted
    whole, by one task; extra columns are ignored; texts do not move."""
    sizes = docs.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_count(F.col(f"`{text_col}`")).alias("size"))
    return mix_sizes(sizes, weights, share, most, seed)


def apply_mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it is due, 0 to 2 times by default; the columns stay.

    The decisions find their rows by (source, id, size). Rows alike in these are due one of two neighbouring numbers of
    copies; where these differ, which rows get the higher one follows from their texts' hash, and only such rows meet in
    a window. Texts move once, very long ones too. Extra columns stay, null ids and sources and empty texts are rows like
    others (a row without words gets its whole part only). An empty table stays empty.
    """
    key, due_key, low, high, total, many, place, again = unused(docs, *(f"__mix_{n}" for n in ("key", "due", "low", "high", "sum", "rows", "place", "again")))
    decided = mix_documents(docs, text_col, id_col, source_col, **options)
    digest = F.md5(F.to_json(F.struct(F.col("source"), F.col("doc_id"), F.col("size"))).cast("binary"))
    due = decided.withColumn(due_key, digest).groupBy(due_key).agg(F.min("copies").alias(low), F.max("copies").alias(high), F.sum("copies").alias(total), F.count(F.lit(1)).alias(many))
    due = written(due, "mix-due")
    own = F.md5(F.to_json(F.struct(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_count(F.col(f"`{text_col}`")).alias("size"))).cast("binary"))
    rows, columns = docs.withColumn(key, own), [F.col(f"`{c}`") for c in docs.columns]
    repeated = lambda rows, copies: rows.withColumn(again, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*columns)
    alike = repeated(rows.join(due.filter((F.col(low) == F.col(high)) & (F.col(high) > 0)), F.col(key) == F.col(due_key)), F.col(high))
    if due.filter(F.col(low) != F.col(high)).isEmpty():
        return alike
    split = rows.join(due.filter(F.col(low) != F.col(high)), F.col(key) == F.col(due_key))
    split = split.withColumn(place, F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(F.col(f"`{text_col}`")))))
    return alike.unionByName(repeated(split, F.when(F.col(place) <= F.col(total) - F.col(low) * F.col(many), F.col(high)).otherwise(F.col(low))))
