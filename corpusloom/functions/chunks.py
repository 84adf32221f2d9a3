"""Chunks of texts: by article heads, headers, sizes and lines, and the way back. All built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The head of an article at the start of a line, and its number with its title.
ARTICLE_HEAD = r"(?m)(?=^제\d+조(?:의\d+)?\()"
ARTICLE_NO = r"^제(\d+조(?:의\d+)?\([^)]*\))"
#: Fixed value: the head of a section of an annex.
ANNEX_HEAD = r"<\s*(제\s*\d+\s*종)\s*>"


def sized(block: Column, size: int, overlap: int) -> Column:
    """A block as it is if it has at most size characters, else pieces of size that start every size - overlap of them."""
    starts = F.sequence(F.lit(0), F.length(block) - 1, F.lit(size - overlap))
    return F.when(F.length(block) <= size, F.array(block)).otherwise(F.transform(starts, lambda i: F.substr(block, i + 1, F.lit(size))))


def article_chunks(text: Column, size: int = 800, overlap: int = 100, least: int = 50) -> Column:
    """array of struct(content, article_no): cut at article heads, long articles by size; a text that these heads cut into
    fewer than five parts is cut by size alone. Pieces of at most least characters are dropped."""
    at_heads = F.split(text, ARTICLE_HEAD)
    blocks = F.when(F.size(at_heads) >= 5, at_heads).otherwise(F.array(text))
    blocks = F.filter(F.transform(blocks, lambda b: _stripped(b)), lambda b: b != "")
    named = F.transform(blocks, lambda b: F.struct(sized(b, size, overlap).alias("parts"), F.nullif(F.regexp_extract(b, ARTICLE_NO, 1), F.lit("")).alias("no")))
    pieces = F.flatten(F.transform(named, lambda x: F.transform(x["parts"], lambda p: F.struct(p.alias("content"), x["no"].alias("article_no")))))
    return F.when(text.isNotNull(), F.filter(pieces, lambda p: F.length(_stripped(p["content"])) > least))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def law_chunks(article_no: Column, text: Column, size: int = 800, overlap: int = 100, least: int = 50) -> Column:
    """array of pieces of one unit of a law. A short unit is one piece. Pieces of a long one are stripped, and dropped at
    up to least characters; in an annex or form with at least two section heads, a piece that starts behind a head has
    that head as its first line."""
    block = _stripped(text)
    starts = F.sequence(F.lit(0), F.length(block) - 1, F.lit(size - overlap))
    names = F.transform(F.regexp_extract_all(block, F.lit(ANNEX_HEAD), F.lit(1)), lambda h: F.regexp_replace(h, r"\s", ""))
    parts = F.split(block, f"(?={ANNEX_HEAD})")
    led = F.when(F.regexp_like(F.element_at(parts, 1), F.lit("^" + ANNEX_HEAD)), parts).otherwise(F.slice(parts, 2, 1 << 30))
    skipped = F.length(block) - F.aggregate(led, F.lit(0), lambda s, p: s + F.length(p))
    ends = F.aggregate(led, F.struct(skipped.alias("at"), F.array().cast("array<int>").alias("places")), lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["places"], F.array(s["at"])).alias("places")))["places"]
    heads = F.when(F.regexp_like(article_no, F.lit("^(별표|별지)")) & (F.size(names) >= 2), F.arrays_zip(ends.alias("at"), names.alias("name"))).otherwise(F.array().cast("array<struct<at:int,name:string>>"))

    def piece(i: Column) -> Column:
        raw = F.substr(block, i + 1, F.lit(size))
        own = _stripped(raw)
        first = i + F.length(raw) - F.length(F.regexp_replace(raw, r"^\s+", ""))
        upto = F.filter(heads, lambda h: h["at"] <= first)
        last = F.element_at(upto, -1)
        under = F.when((F.size(upto) > 0) & (last["at"] < first), last["name"])
        return F.when(F.length(own) > least, F.when(under.isNull(), own).otherwise(F.concat(F.lit("〔"), under, F.lit("〕\n"), own)))

    return F.when(block == "", F.array().cast("array<string>")).when(F.length(block) <= size, F.array(block)).otherwise(F.array_compact(F.transform(starts, piece)))


def header_chunks(body: Column, title: Column, size: int = 1000, overlap: int = 100, least: int = 30) -> Column:
    """array of pieces: cut at markdown headers of up to three signs, long sections by size; pieces of fewer than least
    characters are dropped, the others start with the title in brackets."""
    sections = F.filter(F.transform(F.split(body, r"(?m)(?=^#{1,3}\s)"), lambda s: _stripped(s)), lambda s: s != "")
    pieces = F.filter(F.flatten(F.transform(sections, lambda s: sized(s, size, overlap))), lambda c: F.length(_stripped(c)) >= least)
    return F.transform(pieces, lambda c: F.concat(F.lit("["), title, F.lit("] "), c))


def line_cuts(text: Column, size: int = 700) -> Column:
    """Where line_chunks() cuts: the ends of its pieces but for the last one's.

    A fold over the places of the newlines. It carries the start of the piece and the last newline in the piece's final
    30%; a newline beyond the piece's reach closes it there, or at size characters where there is none, as often as it takes.
    """
    near = size * 7 // 10
    lengths = F.transform(F.split(text, "\n"), F.length)
    ints = "array<int>"
    state = lambda start, best, at, cuts: F.struct(start.cast("int").alias("start"), best.cast("int").alias("best"), at.cast("int").alias("at"), cuts.cast(ints).alias("cuts"))

    def closed(s: Column, place: Column) -> Column:
        """The state once every piece is closed whose reach ends at or before place (an end of text: before it)."""
        soft = (s["best"] > 0) & (s["start"] + size <= place)
        start = F.when(soft, s["best"]).otherwise(s["start"])
        cuts = F.when(soft, F.concat(s["cuts"], F.array(s["best"]))).otherwise(s["cuts"])
        hard = F.floor((place - start) / size).cast("int")
        more = F.when(hard > 0, F.transform(F.sequence(F.lit(1), F.greatest(hard, F.lit(1))), lambda k: (start + k * size).cast("int"))).otherwise(F.array().cast(ints))
        return state(start + F.greatest(hard, F.lit(0)) * size, F.when(soft | (hard > 0), 0).otherwise(s["best"]), s["at"], F.concat(cuts, more))

    def step(s: Column, length: Column) -> Column:
        place = s["at"] + length  # of the newline behind this line
        return let(closed(s, place), lambda c: state(c["start"], F.when(place >= c["start"] + near, place + 1).otherwise(c["best"]), place + 1, c["cuts"]))

    lines = F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0)))  # each of them ends in a newline
    folded = F.aggregate(lines, state(F.lit(0), F.lit(0), F.lit(0), F.array()), step)
    return let(folded, lambda s: closed(s, F.length(text) - 1)["cuts"])


def line_chunks(text: Column, size: int = 700) -> Column:
    """Pieces of at most size characters that do not overlap, cut behind a newline in a piece's last 30% if there is one.
    Pieces of white space alone are dropped; the others joined give the text back."""
    pieces = let(line_cuts(text, size), lambda cuts: F.transform(F.arrays_zip(F.concat(F.array(F.lit(0)), cuts).alias("a"), F.concat(cuts, F.array(F.length(text))).alias("b")), lambda p: F.substr(text, p["a"] + 1, p["b"] - p["a"])))
    return F.filter(pieces, lambda p: _stripped(p) != "")


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def joined_chunks(parts: Column, most: int = 400, least: int = 20) -> Column:
    """Pieces in order as one text. What a piece repeats of the end so far, the longest stretch of least to most
    characters, is left out; without one, a newline stands between."""
    none = F.array().cast("array<int>")

    def glued(out: Column, part: Column) -> Column:
        room = F.least(F.length(out), F.length(part), F.lit(most))
        lengths = F.when(room >= least, F.sequence(F.lit(least), F.greatest(room, F.lit(least)))).otherwise(none)
        return let(F.coalesce(F.array_max(F.filter(lengths, lambda n: F.endswith(out, F.left(part, n)))), F.lit(0)), lambda n: F.when(out == "", part).when(n > 0, F.concat(out, F.substr(part, n + 1, F.length(part)))).otherwise(F.concat(out, F.lit("\n"), part)))

    return F.aggregate(F.transform(parts, lambda p: F.coalesce(p, F.lit(""))), F.lit(""), glued)
