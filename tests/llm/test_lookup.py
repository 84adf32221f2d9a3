"""Joins that keep hot keys where they are equal plain joins, also inside the operators."""

import random

import pytest

from corpusloom.llm import common, media, warc


@pytest.mark.parametrize("hot", [1, 3, 1000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_is_a_join(spark, monkeypatch, hot, how):
    rng = random.Random(2)
    keys = [0] * 300 + [1] * 100 + [rng.randrange(2, 60) for _ in range(300)]
    rows = spark.createDataFrame([(i, k, str(k % 7)) for i, k in enumerate(keys)], "i int, k int, s string")
    table = spark.createDataFrame([(k, str(k % 7), keys.count(k), f"v{k}") for k in set(keys) if k % 5 != 3], "a int, b string, n int, v string")
    monkeypatch.setattr(common, "HOT", hot)
    got = common.lookup(rows, table, {"k": "a", "s": "b"}, "n", how)
    want = rows.join(table, (rows["k"] == table["a"]) & (rows["s"] == table["b"]), how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert common.lookup(rows, table.limit(0), {"k": "a"}, "n", how).count() == (700 if how == "left" else 0)


def test_operators_with_hot_keys(spark, monkeypatch):
    import test_near_copies
    import test_near_dups

    monkeypatch.setattr(common, "HOT", 2)
    test_near_copies.test_near_copies_keep_their_body(spark)
    test_near_dups.test_vectors(spark, 16, 32, None)
    docs = spark.createDataFrame([(i, "the same text" if i % 3 else f"text {i}", f"<p>{'x' * 1200 if i % 3 else i}") for i in range(60)], "doc_id long, text string, html string")
    got = media.media_round_trip(docs).collect()
    assert len(got) == 60 and len({r["payload_sha256"] for r in got}) == 21
    pages = warc.round_trip(docs.withColumnRenamed("doc_id", "page_id").selectExpr("page_id", "'u' AS url", "html")).collect()
    assert len(pages) == 60 and sum(r["record_type"] == "revisit" for r in pages) == 39 and {r["refers_to"] for r in pages} == {None, 59}
