"""Sharding and mixing hold their laws on skewed, null-ridden and repeated rows."""

import zlib
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, shard string, size string"


def rows(n=3000):
    out = []
    for i in range(n):
        source = None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 7}"
        text = None if i % 29 == 0 else "" if i % 31 == 0 else "same text here" if i % 5 == 0 else f"word{i} " * (i % 40 + 1)
        out.append((None if i % 41 == 0 else i, text, source, "clash", "clash"))
    return out + [(7, "twin", "hot", "a", "b")] * 50


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


def test_shards(docs, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 100)
    got = sharding.shard_documents(docs, 16).collect()
    again = sharding.shard_documents(docs.repartition(3), 16).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 3050 and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mixture, per = Counter(r["source"] for r in got), Counter((r["shard"], r["source"]) for r in got)
    assert all(abs(per[k, s] - n / 16) < 3 for s, n in mixture.items() for k in range(16))
    texts = Counter((r[0], r[1]) for r in rows())
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert sizes == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for (i, t), n in texts.items() for _ in range(n))


def test_few_rows_and_none(spark):
    few = sharding.shard_documents(spark.createDataFrame(rows(3)[:3], SCHEMA), 16).collect()
    assert sorted(r["slot"] for r in few) == [0, 0, 0] and len({r["shard"] for r in few}) == 3
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA), 16).count() == 0


def water_fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """The contract's own words, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, share * sum(sizes.values()), set(sizes)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    got = mixing.mix_documents(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_documents(docs.repartition(3)).collect()))
    sizes, taken, top = Counter(), Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        top[r["source"]] = max(top[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    want = water_fill(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= top[s] + 1e-6 for s in sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, *_ in rows())


def test_draws_are_fair(spark):
    sizes = spark.createDataFrame([("a", i, 1 + i % 9) for i in range(400)] + [("b", 1000 + i, 5) for i in range(400)], "source string, doc_id long, size long")
    seen = Counter()
    for seed in range(12):
        for r in mixing.mix_sizes(sizes, weights=(3, 1), share=0.9, seed=seed).collect():
            seen[r["source"], r["size"]] += r["copies"]
    per_row = {k: n / 12 / sum(1 for i in range(400) if k == ("b", 5) or k == ("a", 1 + i % 9)) for k, n in seen.items()}
    small, large = per_row["a", 1], per_row["a", 9]
    assert abs(small - large) < 0.25  # the chance of a copy does not depend on the size


def test_apply_mix(docs, spark):
    taken = mixing.apply_mix(docs)
    assert taken.columns == docs.columns
    due = Counter()
    for r in mixing.mix_documents(docs).collect():
        due[r["source"], r["doc_id"], r["size"]] += r["copies"]
    assert Counter((r["source"], r["doc_id"], len((r["text"] or "").split())) for r in taken.collect()) == +due
    assert mixing.apply_mix(spark.createDataFrame([], SCHEMA)).count() == 0
