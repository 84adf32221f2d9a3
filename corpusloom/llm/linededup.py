"""Line dedup by a log-template tree, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, let, lookup, unused, written

#: Tokens with a digit or an at sign are variable fields from the start.
FIELD = r"(?<![^ ])[^ ]*[0-9@][^ ]*"
WILD = "<*>"
#: Texts may be near copies if this share of their characters stands in stretches of lines that recur, of so many tokens.
NEAR = 0.75
STRETCH = 8
#: A line of fewer tokens than asked for counts nevertheless if it has this many characters (text without blanks).
LONG_TOKEN = 20


def _line(raw: Column) -> Column:
    """A line with its runs of white space as one space each, trimmed."""
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def _tokens_in(line: Column) -> Column:
    return F.size(F.split(line, " "))


def _marked(h: Column, flag: Column) -> Column:
    """A hash that carries a flag in its lowest bit."""
    return h.bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(flag.cast("long"))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def template_lines(docs: DataFrame, text_col: str = "text", depth: int = 3, min_docs: int = 10, min_tokens: int = 2, constant: float = 0.75, near: float = NEAR, long_tokens: int = 10, long_docs: int = 3) -> DataFrame:
    """The lines whose template recurs: text_key (binary, of the whole text), drop (array of 0-based line numbers) and
    copies (rows that have the text).

    The tree has a fixed depth: a line descends by its number of tokens, then by its first depth tokens, variable fields
    masked. A line of which over a quarter of the tokens are such fields is taken literally. In a leaf that enough texts
    reach, a token is kept at its position if it stands there in enough (text, line) pairs of the leaf, else it is a
    variable field. The line's template is what results, if at least the share constant of its tokens is kept; else it is
    the line itself. A template recurs if enough texts have it, where near copies count as one text. Enough is min_docs,
    and long_docs for lines of at least long_tokens tokens, which do not agree by chance.

    Everything is counted over distinct texts, so whole copies of one document do not make its lines recur. Nor do near
    copies: texts of which recurring stretches make up the share near or more are labelled by the least such text that
    agrees with them, and texts with equal labels count once. A stretch is STRETCH tokens of a line (the last one up to
    twice that), fields masked; it recurs if enough texts have it word by word, which at this length is no chance,
    however large the corpus. To agree is to have in common three of the four longest of them (two, if there are two or
    three; the only one, if there is one).

    Texts do not meet by line or template: counts are partial aggregates, and keys that hold over a thousandth of the
    pairs are looked up in a broadcast table of at most a thousand rows. Lists of line numbers go back by text.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = docs.select(text_key(text).alias("text_key"), text.alias("text"))
    raws = F.split(F.col("text"), "\n")
    enough = lambda tagged: F.when(tagged.bitwiseAND(F.lit(1).cast("long")) == 1, long_docs).otherwise(min_docs)

    def leaf(line: Column, n: Column) -> Column:
        lead = F.regexp_replace(F.substring_index(line, " ", depth), FIELD, WILD)
        return _marked(F.xxhash64(n, lead), n >= long_tokens)

    # 1. One narrow row for each distinct text: the leaf of every line that counts.
    lines = F.transform(raws, lambda r, i: F.struct(i.cast("int").alias("i"), _line(r).alias("line")))
    lines = F.transform(lines, lambda s: F.struct(s["i"].alias("i"), s["line"].alias("line"), _tokens_in(s["line"]).alias("n")))
    lines = F.filter(lines, lambda s: (s["line"] != "") & ((s["n"] >= min_tokens) | (F.length(s["line"]) >= LONG_TOKEN)))
    leaves = given.select("text_key", F.transform(lines, lambda s: F.struct(s["i"].alias("i"), leaf(s["line"], s["n"]).alias("leaf"))).alias("at"))
    leaves = written(leaves.groupBy("text_key").agg(F.first("at").alias("at"), F.count(F.lit(1)).alias("copies")), "line-leaves")
    # 2. Leaves that enough texts reach, and the lines in them.
    busy = leaves.select(F.explode(F.array_distinct(F.col("at.leaf"))).alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    busy = written(busy.filter(F.col("n") >= enough(F.col("leaf"))).withColumnRenamed("leaf", "busy"), "line-busy")
    wanted = lookup(leaves.select("text_key", F.explode("at").alias("p")).select("text_key", "p.i", "p.leaf"), busy, {"leaf": "busy"}, "n", "left_semi")
    wanted = wanted.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("i", "leaf"))).alias("want"))
    wanted = written(wanted.withColumnRenamed("text_key", "want_key"), "line-wanted")

    # 3. Those lines themselves, once for each distinct text.
    def found_lines(raw: Column) -> Column:
        at = F.transform("want", lambda w: F.struct(w["i"].alias("i"), w["leaf"].alias("leaf"), _line(F.get(raw, w["i"])).alias("line"), (F.length(F.get(raw, w["i"])) + 1).alias("chars")))
        fields = lambda line: F.size(F.filter(F.split(line, " "), lambda t: t.rlike("[0-9@]")))
        taken = lambda line: F.when(fields(line) * 4 > _tokens_in(line), line).otherwise(F.regexp_replace(line, FIELD, WILD))
        return F.transform(at, lambda p: F.struct(p["i"].alias("i"), p["leaf"].alias("leaf"), taken(p["line"]).alias("line"), p["chars"].alias("chars")))

    once = given.groupBy("text_key").agg(F.first("text").alias("text")).join(wanted, F.col("text_key") == F.col("want_key"))
    per_text = written(once.select("text_key", (F.length("text") + 1).alias("size"), let(raws, found_lines).alias("lines")), "line-found")
    found = per_text.select("text_key", F.explode("lines").alias("p")).select("text_key", "p.i", "p.leaf", "p.line", F.xxhash64("p.line").alias("h"))
    # 4. Templates over the distinct lines of each leaf.
    counts = found.select("text_key", "leaf", "h").distinct().groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("n"))
    shown = found.groupBy("leaf", "h").agg(F.first("line").alias("line"))
    distinct = written(counts.join(shown, ["leaf", "h"]), "line-distinct")
    # The leading tokens are the same for all lines of a leaf, so they need no count.
    spread = distinct.select("leaf", "h", "n", F.posexplode(F.slice(F.split("line", " "), depth + 1, 1 << 30)).alias("k", "token")).filter(F.col("token") != WILD)
    often = spread.groupBy("leaf", "k", "token").agg(F.sum("n").alias("m")).filter(F.col("m") >= enough(F.col("leaf")))
    often = written(often.select(F.col("leaf").alias("leaf2"), F.col("k").alias("k2"), F.col("token").alias("token2"), "m"), "line-often")
    kept = lookup(spread, often, {"leaf": "leaf2", "k": "k2", "token": "token2"}, "m", "left_semi").groupBy("leaf", "h").agg(F.collect_set("k").alias("kept"))
    kept = kept.select(F.col("leaf").alias("leaf3"), F.col("h").alias("h3"), "kept")
    tokens = F.split("line", " ")
    shape = distinct.join(kept, (F.col("leaf") == F.col("leaf3")) & (F.col("h") == F.col("h3")), "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    shape = shape.withColumn("made", F.transform(tokens, lambda t, k: F.when((k < depth) | F.array_contains("kept", k - depth), t).otherwise(WILD)))
    whole = F.size(F.filter("made", lambda t: t != WILD)) >= constant * F.size("made")
    template = F.when(whole, F.array_join("made", " ")).otherwise(F.col("line"))
    shape = written(shape.select("leaf", "h", "n", _marked(F.xxhash64("leaf", template), F.col("leaf").bitwiseAND(F.lit(1).cast("long")) == 1).alias("template")), "line-shape")
    often_made = shape.groupBy("template").agg(F.sum("n").alias("m")).filter(F.col("m") >= enough(F.col("template"))).withColumnRenamed("template", "template3")
    gone = lookup(shape, written(often_made, "line-often-made"), {"template": "template3"}, "m", "left_semi")
    gone = written(gone.select(F.col("leaf").alias("leaf4"), F.col("h").alias("h4"), "n", "template"), "line-gone")
    held = lookup(found.select("text_key", "i", "leaf", "h"), gone, {"leaf": "leaf4", "h": "h4"}, "n", "inner")
    held = written(held.select("text_key", "i", "template"), "line-held")
    # 5. Near copies as one text: what their label stands for.
    pairs = held.select("text_key", "template").distinct().join(_labels(per_text, near, enough), F.col("text_key") == F.col("label_key"), "left")
    groups = pairs.select("template", F.coalesce("label", "text_key").alias("label")).distinct().groupBy("template").agg(F.count(F.lit(1)).alias("m"))
    groups = written(groups.filter(F.col("m") >= enough(F.col("template"))).withColumnRenamed("template", "template4"), "line-recurring")
    drop = lookup(held, groups, {"template": "template4"}, "m", "left_semi").groupBy("text_key").agg(F.array_sort(F.collect_list("i")).alias("drop"))
    drop = written(drop.join(leaves.select("text_key", "copies"), "text_key"), "line-drop")
    discard(leaves, busy, wanted, per_text, distinct, often, shape, gone, held, groups)
    return drop


def _stretches(line: Column) -> Column:
    """A line in stretches of STRETCH tokens, what is left over in the last one."""
    tokens = F.split(line, " ")
    last = F.greatest(F.floor(F.size(tokens) / STRETCH).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(tokens, k * STRETCH + 1, F.when(k == last, 2 * STRETCH).otherwise(STRETCH)), " "))


def _labels(per_text: DataFrame, near: float, enough: Callable[[Column], Column]) -> DataFrame:
    """label_key, label of the near copies (see template_lines)."""
    one = F.lit(1).cast("long")
    parts = F.flatten(F.transform("lines", lambda p: F.transform(_stretches(p["line"]), lambda s: F.struct(s.alias("s"), _marked(F.xxhash64(s), p["leaf"].bitwiseAND(one) == 1).alias("h")))))
    parts = written(per_text.select("text_key", "size", F.explode(parts).alias("p")).select("text_key", "size", "p.s", "p.h"), "line-stretches")
    often = parts.select("text_key", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    often = written(often.filter(F.col("n") >= enough(F.col("h"))).withColumnRenamed("h", "h5"), "line-often-stretches")
    known = lookup(parts, often, {"h": "h5"}, "n", "left_semi")
    order = F.array_sort(F.collect_set(F.struct((-F.length("s")).alias("c"), "s", "h")))
    texts = known.groupBy("text_key").agg(F.first("size").alias("size"), F.sum(F.length("s") + 1).alias("covered"), F.slice(order, 1, 4).alias("long"))
    some = lambda *at: F.sort_array(F.array(*(F.col("long")[k]["h"] for k in at)))
    n = F.size("long")
    agree = F.when(n == 1, F.array(some(0))).when(n == 2, F.array(some(0, 1))).when(n == 3, F.array(some(0, 1), some(0, 2), some(1, 2))).otherwise(F.array(some(0, 1, 2), some(0, 1, 3), some(0, 2, 3), some(1, 2, 3)))
    copies = texts.filter(F.col("covered") >= near * F.col("size")).select("text_key", F.explode(F.array_distinct(agree)).alias("agree"))
    copies = written(copies.select("text_key", F.xxhash64("agree").alias("agree")), "line-copies")
    least = written(copies.groupBy("agree").agg(F.min("text_key").alias("low"), F.count(F.lit(1)).alias("n")).withColumnRenamed("agree", "agree6"), "line-least")
    out = lookup(copies, least, {"agree": "agree6"}, "n", "inner").groupBy("text_key").agg(F.min("low").alias("label"))
    discard(parts, often)
    return out.withColumnRenamed("text_key", "label_key")


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the lines whose template recurs across documents; adds n_lines and n_dropped (int). Options are those
    of template_lines().

    Blank lines and lines of fewer than min_tokens tokens stay, as does the order of what is left; a single token counts
    from LONG_TOKEN characters on. A text that loses all its lines becomes empty, its row stays. Null texts stay null (0
    lines); empty texts have one, blank, line. Repeated rows are treated alike and count once, as do rows with equal
    texts and near copies. Very long texts are one row of one task. Other columns stay, whatever their names, but for
    n_lines and n_dropped, which are replaced. Empty tables stay empty.

    Rows of texts that very many rows share stay where they are (their lists are broadcast); the others move once.
    """
    key, of, gone, copies = unused(docs, "__line_key", "__line_of", "__line_drop", "__line_copies")
    drop = template_lines(docs, text_col, **options).withColumnsRenamed({"text_key": of, "drop": gone, "copies": copies})
    text = F.col(f"`{text_col}`").cast("string")
    joined = lookup(docs.withColumn(key, text_key(text)), drop, {key: of}, copies, "left")
    lines = F.split(text, "\n")
    left = let(lines, lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)))
    out = {
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)),
        "n_dropped": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)),
        text_col: F.when(F.col(gone).isNull(), text).otherwise(F.array_join(left, "\n")),
    }
    return joined.withColumns(out).drop(key, of, gone, copies)

