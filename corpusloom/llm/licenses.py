"""License scans by a positional index of rare words, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import unused

#: A run of digits, letters and what is not ASCII; capitals count as they are lower-cased afterwards.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rarest words of a key phrase that are looked up.
RARE = 2

# The phrases that stand for a licence by themselves.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices of public licences, each with the phrases that have to stand in it.
NOTICES = [
    ("agpl-3", "gnu affero general public license version 3", ["gnu affero general public license", "version 3"]),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license version 2", "you may not use this file except in compliance with the license"]),
    ("apache-2", "spdx license identifier apache 2 0", ["spdx license identifier apache 2 0"]),
    ("artistic-2", "released under the artistic license 2 0", ["the artistic license 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "are permitted provided that the following conditions are met"]),
    ("bsd", "licensed under the bsd 3 clause license", ["bsd 3 clause license"]),
    ("bsd", "licensed under the bsd 2 clause license", ["bsd 2 clause license"]),
    ("bsl-1", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("gpl-2", "gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3", "gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "spdx license identifier gpl 3 0", ["spdx license identifier gpl 3 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "distribute this software for any purpose with or without fee is hereby granted"]),
    ("lgpl", "gnu lesser general public license version", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "to any person obtaining a copy of this software"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
]


@dataclass(frozen=True)
class Template:
    """A notice: its words, and its key phrases with the places where they stand in it.

    A place of it in a file is where the first phrase stands and each other one begins as far from it as in the notice,
    give or take slack words.
    """

    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]
    slack: int = 0
    base: bool = False
    rare: tuple[tuple[int, ...], ...] = field(default=(), compare=False)

    @classmethod
    def of(cls, label: str, text: str, phrases: list[str], slack: int = 4, base: bool = False) -> Template:
        words = tuple(text.split())
        cut = [tuple(p.split()) for p in phrases]
        at = [next(i for i in range(len(words)) if words[i : i + len(p)] == p) for p in cut]
        return cls(label, words, tuple(zip(at, cut, strict=True)), slack, base)

    def ranked(self, idf: dict[str, float]) -> Template:
        """With the places of the rarest words of each phrase (ties: the first)."""
        rare = tuple(tuple(sorted(range(len(p)), key=lambda i: (-idf[p[i]], i))[:RARE]) for _, p in self.phrases)
        return Template(self.label, self.words, self.phrases, self.slack, self.base, rare)


def templates() -> list[Template]:
    return [Template.of(label, text, [text], 0, True) for text, label in BASE.items()] + [Template.of(*n) for n in NOTICES]


def _is_word(word: Column, known: list[str]) -> Column:
    """Whether a word, A-Z lower-cased, is one of known (which are ASCII): lower() is fast, but takes other capitals."""
    return F.lower(word).isin(known) & F.translate(word, UPPER, LOWER).isin(known)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def license_idf(docs: DataFrame, known: list[str], text_col: str = "text") -> dict[str, float]:
    """ln((1 + documents) / (1 + documents that hold it)) for each of the licence words, over all documents."""
    held = F.array_distinct(F.transform(F.filter(_words(F.col(f"`{text_col}`")), lambda w: _is_word(w, known)), F.lower))
    # A null for the document itself: one pass gives both counts.
    found = docs.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), held)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.word: r.n for r in found.collect()}  # at most a row for each licence word
    return {w: math.log((1 + counts.get(None, 0)) / (1 + counts.get(w, 0))) for w in known}


def _stands(words: Column, at: Column, phrase: tuple[str, ...]) -> Column:
    """Whether the phrase's words stand from place at (0-based) on."""
    here = F.array_join(F.slice(words, at + 1, len(phrase)), " ")
    return (at >= 0) & (F.translate(here, UPPER, LOWER) == " ".join(phrase))


def _phrase_starts(hits: Column, words: Column, phrase: tuple[str, ...], rare: tuple[int, ...]) -> Column:
    """Where a phrase stands: its rarest words are looked up, their postings met by relative place, the phrase verified."""
    starts = lambda i: F.transform(F.filter(hits, lambda h: h["w"] == phrase[i]), lambda h: h["i"] - i)
    met = reduce(F.array_intersect, (starts(i) for i in rare))
    return F.filter(met, lambda at: _stands(words, at, phrase))


def _reach(starts: Column, off: int, slack: int) -> Column:
    return F.flatten(F.transform(starts, lambda s: F.sequence(s - off - slack, s - off + slack)))


def _places(hits: Column, words: Column, t: Template) -> Column:
    """The places of a template: where its first phrase starts, the others in reach."""
    (origin, first), others = t.phrases[0], list(zip(t.phrases[1:], t.rare[1:], strict=True))
    out = _phrase_starts(hits, words, first, t.rare[0])
    for (at, phrase), rare in others:
        out = F.array_intersect(out, _reach(_phrase_starts(hits, words, phrase, rare), at - origin, t.slack))
    return out


def _share(words: Column, places: Column, t: Template) -> Column:
    """Of a template's distinct words, the largest share that stands in its reach around a place."""
    return F.array_max(F.transform(places, lambda at: _share_at(words, at, t)))


def _share_at(words: Column, at: Column, t: Template) -> Column:
    origin, distinct = t.phrases[0][0], sorted(set(t.words))
    low = F.greatest(at - origin - t.slack, F.lit(0))
    window = F.slice(words, low + 1, at - origin + len(t.words) + t.slack - low)
    own = F.array_intersect(F.transform(window, lambda w: F.translate(w, UPPER, LOWER)), F.array(*map(F.lit, distinct)))
    return F.size(own) / F.lit(float(len(distinct)))


def scan_licenses(docs: DataFrame, text_col: str = "text", known: list[Template] | None = None) -> DataFrame:
    """docs with what is found of licences in each text: n_words, n_base, first_word, last_word (long), base_labels, labels
    (string) and score (double).

    Words are runs of digits, letters and characters that are not ASCII; A-Z are lower-cased. The positional index holds,
    for each key phrase of each template, its RARE rarest words by their frequency in all documents. A text's words are
    looked up in it; where the postings of a phrase's words agree on where it starts, the phrase is compared word by
    word. A template stands where its first key phrase does, with the others as far from it as in the notice, give or
    take its slack. Base templates are phrases that stand as they are.

    n_base counts the places of base phrases, first_word and last_word are the least and largest of them (null without).
    labels are those of all templates that stand in the text, sorted and joined by commas, base_labels those of base
    phrases. score is the largest share of a template's distinct words that stand in its reach, 0 if none stands.

    Null and empty texts have no words and no labels. Very long texts are one row of one task; the work is linear in
    their words. Repeated rows are treated alike. Other columns stay, whatever their names, but for those named above,
    which are replaced. An empty table stays empty. No rows move: the texts are read twice, once for the frequencies.
    """
    known = templates() if known is None else known
    vocabulary = sorted({w for t in known for _, p in t.phrases for w in p})
    idf = license_idf(docs, vocabulary, text_col)
    known = [t.ranked(idf) for t in known]
    rare = sorted({p[i] for t in known for (_, p), at in zip(t.phrases, t.rare, strict=True) for i in at})
    words, hits, places, found = unused(docs, "__license_words", "__license_hits", "__license_places", "__license_found")
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    w, h, p = F.col(words), F.col(hits), F.col(places)
    rows = docs.withColumn(words, _words(F.col(f"`{text_col}`")))
    looked_up = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda x: _is_word(x["w"], rare))
    rows = rows.withColumn(hits, F.transform(looked_up, lambda x: F.struct(x["i"].alias("i"), F.lower(x["w"]).alias("w"))))
    none = F.array().cast("array<int>")
    at = [F.when(F.size(h) > 0, _places(h, w, t)).otherwise(none) for t in known]
    rows = rows.withColumn(places, F.array(*at))
    base = F.flatten(F.slice(p, 1, sum(t.base for t in known)))
    tell = [F.when(F.size(p[k]) > 0, F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _share(w, p[k], t).alias("share"))) for k, t in enumerate(known)]
    rows = rows.withColumn(found, F.array_compact(F.array(*tell)))
    f = F.col(found)
    joined = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda x: x["label"]))), ",")
    out = {
        "n_words": F.size(w).cast("long"),
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(base).cast("long"),
        "last_word": F.array_max(base).cast("long"),
        "base_labels": joined(F.filter(f, lambda x: x["base"])),
        "labels": joined(f),
        "score": F.coalesce(F.array_max(F.transform(f, lambda x: x["share"])), F.lit(0.0)),
    }
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return rows.select(*rest, *(value.alias(name) for name, value in out.items()))


def template_sql(text: str = "text", id_col: str = "doc_id") -> str:
    """The scan in DuckDB's SQL, by comparing every window of every text."""
    lower = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    values = []
    for k, t in enumerate(templates()):
        for j, (at, phrase) in enumerate(t.phrases):
            values.append(f"({k}, {j}, '{phrase[0]}', '{' '.join(phrase)}', {len(phrase)}, {at - t.phrases[0][0]}, {t.slack})")
    info = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {list(sorted(set(t.words)))}, {t.phrases[0][0]}, {len(t.words)}, {t.slack})" for k, t in enumerate(templates()))
    return rf"""
    WITH phrase(k, j, head, p, size, off, slack) AS (VALUES {", ".join(values)}),
    info(k, label, base, own, origin, size, slack) AS (VALUES {info}),
    doc AS (SELECT {id_col} AS doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
    stand AS (SELECT doc_id, k, j, i - 1 AS s, off, slack FROM spot JOIN phrase ON w[i] = head WHERE array_to_string(w[i:i + size - 1], ' ') = p),
    place AS (SELECT a.doc_id, a.k, a.s FROM stand a WHERE j = 0 AND (SELECT count(*) FROM phrase f WHERE f.k = a.k) =
              1 + (SELECT count(DISTINCT b.j) FROM stand b WHERE b.doc_id = a.doc_id AND b.k = a.k AND b.j > 0 AND abs(b.s - b.off - a.s) <= b.slack)),
    tell AS (SELECT doc_id, s, label, base,
                    len(list_filter(own, lambda x: list_contains(w[greatest(s - origin - slack, 0) + 1:s - origin + size + slack], x))) / len(own)::DOUBLE AS share
             FROM place JOIN info USING (k) JOIN doc USING (doc_id)),
    per AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
                   coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
            FROM tell GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM doc LEFT JOIN per USING (doc_id)
    """
