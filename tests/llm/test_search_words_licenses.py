"""Ranked search, spelling variants and license scans against plain forms, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusloom.llm import lexical, licenses, queries, spelling

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_search(docs, items, k=50):
    """(item, rank, id, score); ids are unique and not null here."""
    tf = {i: Counter(TERM.findall((t or "").translate(FOLD))) for i, t in docs}
    tf = {i: c for i, c in tf.items() if c}
    docs_n, terms_n = len(tf), sum(sum(c.values()) for c in tf.values())
    df = Counter(t for c in tf.values() for t in c)
    out = set()
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall((text or "").translate(FOLD)))
    for item, terms in asked.items():
        scores = []
        for i, c in tf.items():
            m = 50 + 50 * sum(c.values()) * docs_n // terms_n
            scores.append((sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c), i))
        best = sorted((-s, i) for s, i in scores if s > 0)[:k]
        out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def tuples(df, *columns):
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("segment,block", [(32_000_000, 256), (4_000, 3)])
def test_search_against_all_scores(spark, monkeypatch, segment, block):
    """Also with many segments, shards and blocks of items, copies and ties."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Éa", "der", "THE"]
    weights = [1 / (i + 1) for i in range(60)] + [1, 1, 1]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    bodies = [text(rng.randrange(1, 60)) for _ in range(150)]
    rows = [(7 * i, bodies[rng.randrange(150)]) for i in range(400)] + [(1, None), (2, ""), (3, "...")]
    asked = [(i, text(6)) for i in range(12)] + [(50, None), (51, "absent"), (3, text(3))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "item_id long, text string")
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    for k in (5, 50):
        got = tuples(lexical.ranked_search(docs, items, k=k), "item_id", "rank", "doc_id", "score")
        assert got == plain_search(rows, asked, k)


def test_search_odd_rows(spark):
    docs = spark.createDataFrame([(None, "alpha beta", 1), (4, "alpha beta", 1), (4, "alpha beta", 1), (5, "x " * 3000 + "gamma", 2), (6, "delta", 0)], "doc_id long, text string, term int")
    items = spark.createDataFrame([(None, "alpha", 1), (9, "gamma x", 1), (9, "gamma x", 1)], "item_id int, text string, rank int")
    got = lexical.ranked_search(docs, items)
    assert [(c.name, c.dataType.simpleString()) for c in got.schema] == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    rows = sorted(((r["item_id"], r["rank"], r["doc_id"]) for r in got.collect()), key=str)
    assert rows == sorted([(None, 1, 4), (None, 2, 4), (None, 3, None), (9, 1, 5)], key=str)
    assert lexical.ranked_search(docs.limit(0), items).count() == lexical.ranked_search(docs, items.limit(0)).count() == 0


@given(st.lists(st.integers(0, 2**62), max_size=40))
def test_packed_numbers(values):
    data, ends = lexical.pack_numbers(np.array(values, dtype=np.int64))
    assert (lexical.unpack_numbers(data).tolist() if values else []) == values and len(ends) == len(values)


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    v = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    cut = defaultdict(set)
    for w in v:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            cut[x].add(w)
    near = {w: {x for s in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for x in cut[s] if spelling.one_edit(w.encode("latin-1"), x.encode("latin-1"))} for w in v}
    best = {w: min(near[w], key=lambda x: (-v[x], x), default=None) for w in v}
    form = {w: b if b and v[b] >= 2 * v[w] else None for w, b in best.items()}
    out = set()
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, v[w], len(near[w]), v.get(form[w])))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_of_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert tuples(queries.QUERIES["op12_spelling_variants"](spark, SF), *COLUMNS) == plain_variants(rows)


def test_variants_in_many_shards(spark, monkeypatch):
    """Shards of a few words, rounds of a few shards, blocks of a few words; all letters, long runs, chains of forms."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abÿé") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    some = list(base)
    for w in base:
        for _ in range(4):
            i = rng.randrange(len(w))
            some.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿé") + w[i:], w[:i] + rng.choice("abÿé") + w[i + 1 :]]))
    rows = [(i, " ".join(w + rng.choice([" ", "-", "1"]) for w in rng.choices(some, [1 / (j + 1) for j in range(len(some))], k=40))) for i in range(120)]
    rows += [(None, "Straße straße STRAßE strasse Ω"), (3, None), (4, ""), (5, "z" * 300 + " " + "zz" * 200), (5, ("abcde" * 40 + " ") * 5), (5, "cafés"), (5, "cafés"), (6, "cafés " * 5 + "kettles " * 20 + "kettler " * 8 + "kettlrr " * 3)]
    monkeypatch.setattr(spelling, "SHARD_WORDS", 7)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 2_000)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 5)
    monkeypatch.setattr(spelling, "SLICE_CHARS", 50)
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, word string").repartition(3)
    got = tuples(spelling.spelling_variants(docs), *COLUMNS)
    assert got == plain_variants(rows) and any(r[1] and r[2] != r[1] for r in got)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_one_edit(a, b):
    edits = {a[:i] + c + a[i + d :] for i in range(len(a) + 1) for c in ("", "a", "b") for d in (0, 1) if i + d <= len(a)} - {a}
    assert spelling.one_edit(a.encode(), b.encode()) == (b in edits)


def test_license_scan(spark):
    text = "Foo. Licensed under the APACHE License,  Version 2.0 (the 'License'); you may not use this file except in compliance with the License. Released under the MIT License. CC BY-NC 4.0"
    rows = [
        (1, text),
        (2, "permission is hereby granted, free of charge, indeed to any person obtaining a copy of this software"),
        (3, "permission is hereby granted free of charge, but " + "very " * 30 + " to any person obtaining a copy of this software"),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, None), (6, ""), (7, "the mit of license under"), (8, "under the mit licenſe; under the mit licénse; under the Key"),
        (9, "word " * 20_000 + "cc by nc " * 3), (9, "word " * 20_000 + "cc by nc " * 3), (None, "Under The Mit License under the mit license"),
    ]
    docs = spark.createDataFrame([(*r, "kept", 1.5) for r in rows], "doc_id long, text string, __license_words string, score double")
    out = licenses.scan_licenses(docs)
    assert out.columns == ["doc_id", "text", "__license_words", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = [(r["doc_id"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 3, 4, 28, "apache-2,cc-by-nc,mit", "apache-2,cc-by-nc,mit"), (2, 0, None, None, "", "mit"), (3, 0, None, None, "", ""), (4, 0, None, None, "", "gpl-3"),
            (5, 0, None, None, "", ""), (6, 0, None, None, "", ""), (7, 0, None, None, "", ""), (8, 0, None, None, "", ""),
            *[(9, 3, 20_000, 20_006, "cc-by-nc", "cc-by-nc")] * 2, (None, 2, 0, 4, "mit", "mit"),
        ],
        key=str,
    )
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in out.collect())
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_license_scan_looks_up_rare_words(spark):
    docs = spark.createDataFrame([("the the under mit",), ("the under",), ("the",), ("license",)], "text string")
    idf = licenses.license_idf(docs, ["the", "under", "mit", "license"])
    assert idf["the"] < idf["under"] < idf["mit"] == idf["license"]
    (t,) = [t for t in licenses.templates() if t.label == "mit" and t.base]
    assert t.ranked(idf).rare == ((2, 3),)
