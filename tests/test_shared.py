"""Rows that share words, in many small blocks, against plain Python; stars of which the pairs are made a few sets at a time."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import bigrams
from corpusloom.operators import briefing as br
from corpusloom.operators import clusters as cl
from corpusloom.operators import shared as sh


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(sh, "LEFT", 40)
    monkeypatch.setattr(sh, "RIGHT", 50)


def sets(rng, n, words=30, most=9):
    return [sorted(rng.sample([f"w{i}" for i in range(words)], rng.randrange(most))) for _ in range(n)]


def test_blocks_find_the_newest_report_and_count_the_window(spark, small):
    rng = random.Random(5)
    left, right = sets(rng, 90), sets(rng, 120)
    marks = [[rng.choice([0, 0, 1, 2, 3]) for _ in side] for side in (left, right)]
    x = spark.createDataFrame([(i, w, m) for i, (w, m) in enumerate(zip(left, marks[0], strict=True))], "l long, tokens array<string>, marks long").localCheckpoint()
    y = spark.createDataFrame([(i, w, m) for i, (w, m) in enumerate(zip(right, marks[1], strict=True))], "r long, tokens array<string>, marks long").localCheckpoint()
    near = lambda a, b: len(set(a) & set(b)) >= 3
    want = {i: next((j for j, b in enumerate(right) if near(a, b) and not marks[0][i] & ~marks[1][j]), None) for i, a in enumerate(left)}
    got = {r["l"]: r["r"] for r in sh.first_shared(x, y, 3).collect()}
    assert got == {i: j for i, j in want.items() if j is not None} and 10 < len(got) < 90
    more = [left[(7 * i) % 90] for i in range(90)]
    both = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(left, more, strict=True))], "l long, tokens array<string>, more array<string>").localCheckpoint()
    pool = y.select("r", "tokens", (F.col("r") % 4 + 1).alias("n"), (F.col("r") % 2).alias("kept"))
    counts = {i: [sum(w(j) for j, c in enumerate(right) if near(a, c) or near(b, c)) for w in (lambda j: j % 4 + 1, lambda j: j % 2)] for i, (a, b) in enumerate(zip(left, more, strict=True))}
    assert {r["l"]: [r["n"], r["kept"]] for r in sh.shared_counts(both, pool, 3).collect()} == counts


def test_pairs_are_made_of_few_sets_at_a_time(spark, small, monkeypatch):
    """300 titles, most of which share common words: seeds come from several heads, none of more than 64 sets, and copies
    join the star of the first."""
    monkeypatch.setattr(cl, "HEAD", 32)
    monkeypatch.setattr(cl, "MOST", 64)
    heads = []
    monkeypatch.setattr(cl, "shared_pairs", lambda rows, least: heads.append(rows.count()) or sh.shared_pairs(rows, least))
    rng = random.Random(9)
    tokens = sets(rng, 200, 90, 8) + sets(rng, 60, 12, 8)
    tokens += [tokens[rng.randrange(260)] for _ in range(40)]
    rng.shuffle(tokens)
    items = [(i, (i * 7) % 50, w) for i, w in enumerate(tokens)]
    want, seeds = {}, []
    for i, _, w in sorted(items, key=lambda r: (r[1], r[0])):
        want[i] = next((s for s, own in seeds if len(own & set(w)) >= 3), i)
        if want[i] == i:
            seeds.append((i, set(w)))
    got = cl.star_clusters(spark.createDataFrame(items, "id long, at long, t array<string>"), [], "at", "id", "t", 3).collect()
    assert {r["id"]: r["seed_id"] for r in got} == want and len(got) == 300
    assert len(heads) > 1 and max(heads) <= 64


def test_covered_briefings_make_no_pairs(spark, small, monkeypatch):
    """Representatives against earlier titles: one row of a block for each representative, however many titles it shares
    words with."""
    made = []
    monkeypatch.setattr(br, "first_shared", lambda *a: made.append(sh.first_shared(*a)) or made[-1])
    words = ["a", "b", "c"]
    rows = [(i, [f"x{i}", f"y{i}", f"z{i}", *(words if i == 1 else [])], i != 2) for i in range(4)]
    items = spark.createDataFrame(rows, "id long, t array<string>, body boolean").withColumn("at", F.timestamp_seconds(F.col("id")))
    earlier = spark.range(200).select(F.array(*map(F.lit, words), F.concat(F.lit("q"), "id")).alias("t"))
    got = br.briefing_clusters(items, "id", "at", "t", "body", earlier, "t").collect()
    assert sorted((r["rep"], r["related"], r["covered"]) for r in got) == [(0, 0, False), (1, 0, True), (2, 0, False), (3, 0, False)]
    assert made[0].count() == 1


def test_bigrams_squeeze_the_text_once(spark):
    """Not again for each pair: the text may be cut out of a whole page."""
    df = spark.createDataFrame([(" a b c",), ("x",), ("",), (None,)], "t string").select(bigrams(F.regexp_extract("t", "(?s)(.*)", 1)).alias("g"))
    assert [r["g"] for r in df.collect()] == [["ab", "bc"], [], [], []]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1


def test_blocks_are_taken_apart_once(spark):
    """What a row's key is made of is not worked out again in filters."""
    queue = spark.createDataFrame([(1, "news 2건\n\n1. <b>a</b>\n\n2. b"), (2, "news 1건\n1. a"), (3, "plain")], "place int, html string")
    df = br.merged_blocks(queue, "place", "html")
    assert {r["place"]: r["text"] for r in df.collect()} == {1: "news 2건\n\n1. <b>a</b>\n\n2. b", 3: "plain"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_extract" in x]
