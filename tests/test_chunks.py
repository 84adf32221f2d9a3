"""Chunkers against plain forms on random texts, and worked cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chunks as ch


def lossless(text, size):
    """One piece after the other, each ended by the best newline in its reach."""
    if len(text) <= size:
        return [text] if text.strip() else []
    spots = [i + 1 for i in range(size * 7 // 10, size) if text[i] == "\n"]
    cut = spots[-1] if spots else size
    return [p for p in [text[:cut]] if p.strip()] + lossless(text[cut:], size)


def texts():
    rng = random.Random(7)
    out = ["", "\n", " \n \n", "a" * 700, "a" * 701, "a" * 1400, "\n" * 1500, "x" * 490 + "\n" + "y" * 300, "x" * 489 + "\n" + "y" * 300, "x" * 699 + "\n" + "y", "x" * 700 + "\n" + "y"]
    for _ in range(120):
        out.append("\n".join("é" * rng.choice([0, 1, 30, 200, 500, 900, 2500]) for _ in range(rng.randint(1, 12))))
        out.append("".join(rng.choice("ab \n") for _ in range(rng.randint(1, 3000))))
    return out


def test_line_chunks(spark):
    for size in (700, 40):
        got = spark.createDataFrame(list(enumerate(texts())), "i int, t string").select("i", ch.line_chunks(F.col("t"), size).alias("c"), ch.line_cuts(F.col("t"), size).alias("cuts")).orderBy("i").collect()
        for r, text in zip(got, texts(), strict=True):
            assert r["c"] == lossless(text, size), (size, text[:80])
            ends = [0, *r["cuts"], len(text)]
            assert "".join(text[a:b] for a, b in zip(ends, ends[1:], strict=False)) == text


def test_article_chunks(spark):
    articles = [f"제{i}조(제목{i}) " + "가나다라 " * n for i, n in [(1, 20), (2, 400), (3, 3), (4, 30)]] + ["제4조의2(붙임) " + "마바사 " * 30]
    whole = "전문 " + "자차카 " * 20 + "\n" + "\n".join(articles)
    few = "제1조(목적) " + "가" * 1470
    tail = "나" * 1480
    got = spark.createDataFrame([(whole,), (few,), (tail,), ("짧은 글",), ("",), (None,)], "t string").select(ch.article_chunks(F.col("t")).alias("c")).collect()
    rows = [(c["content"], c["article_no"]) for c in got[0]["c"]]
    blocks = [b.strip() for b in ["전문 " + "자차카 " * 20, *articles]]
    want = []
    for b in blocks:
        no = re.match(r"제(\d+조(?:의\d+)?\([^)]*\))", b)
        want += [(b[i : i + 800], no and no[1]) for i in (range(0, len(b), 700) if len(b) > 800 else [0])]
    assert rows == [w for w in want if len(w[0].strip()) > 50] and ("4조의2(붙임)" in {n for _, n in rows})
    assert [len(c["content"]) for c in got[1]["c"]] == [800, 778, 78] and got[1]["c"][1]["article_no"] == "1조(목적)"  # by size, to the end
    assert [len(c["content"]) for c in got[2]["c"]] == [800, 780, 80]
    assert [r["c"] for r in got[3:]] == [[], [], None]


def test_law_chunks(spark):
    table = "별표 내용 " * 20 + "<제1종>" + "가" * 900 + "\n<제 2 종>" + "나" * 1200
    rows = [("3조(정의)", " " + "본문 " * 10), ("3조(정의)", "다" * 1500), ("별표 1", table), ("별표 2", "<제1종>" + "라" * 1600), ("1조", "  ")]
    got = [r["c"] for r in spark.createDataFrame(rows, "no string, t string").select(ch.law_chunks(F.col("no"), F.col("t")).alias("c")).collect()]
    assert got[0] == [("본문 " * 10).strip()] and [len(c) for c in got[1]] == [800, 800, 100] and got[4] == []
    block = table.strip()
    first, second = block.index("<제1종>"), block.index("<제 2 종>")
    for k, piece in enumerate(got[2]):
        at = k * 700
        head = "제2종" if at > second else "제1종" if at > first else None
        assert piece == (f"〔{head}〕\n" if head else "") + block[at : at + 800].strip()
    assert all(not c.startswith("〔") for c in got[3])  # a lone head is no section


def test_header_chunks(spark):
    body = "intro " * 10 + "\n# One\n" + "a" * 40 + "\n#### deep\n" + "b" * 1900 + "\n## Two\nshort\n"
    got = spark.createDataFrame([("T", body)], "title string, body string").select(ch.header_chunks(F.col("body"), F.col("title")).alias("c")).first()["c"]
    one = ("# One\n" + "a" * 40 + "\n#### deep\n" + "b" * 1900).strip()
    assert got == ["[T] " + ("intro " * 10).strip(), *("[T] " + one[i : i + 1000] for i in (0, 900, 1800))]


@pytest.mark.parametrize(("parts", "want"), [
    (["abcdefghij" * 10, "abcdefghij" * 3 + "END", "other"], "abcdefghij" * 10 + "END\nother"),
    (["x" * 19, "x" * 19], "x" * 19 + "\n" + "x" * 19),
    (["x" * 20, "x" * 20 + "y"], "x" * 20 + "y"),
    (["", "a", None, "b"], "a\n\nb"),
    (["head " + "q" * 450, "q" * 450 + " tail"], "head " + "q" * 450 + "q" * 50 + " tail"),
    ([], ""),
])
def test_joined_chunks(spark, parts, want):
    assert spark.createDataFrame([(parts,)], "p array<string>").select(ch.joined_chunks(F.col("p"))).first()[0] == want
