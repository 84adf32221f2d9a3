"""The classifier's statistics and inputs against plain loops, and what its words' tokens hang on."""

import random
from collections import Counter

import numpy as np

from corpusloom.llm import quality as q


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeXY12#%é") for _ in range(rng.randint(1, 9)))
    return [None, "", " ", "one", *(" ".join(word() for _ in range(rng.randint(2, 60))) for _ in range(80)), "same same same", "same same same"]


def test_context_sums(spark):
    places, signs = q.index_vectors()
    want = np.zeros((q.BUCKETS, q.DIMS))
    for text in texts():
        ids = [b for w in (text or "").split() for b in q.word_buckets(w)]
        for i, own in enumerate(ids):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    for at, sign in zip(places[ids[j]], signs[ids[j]], strict=True):
                        want[own, at] += sign
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts())], "doc_id long, text string, bucket int").repartition(5)
    assert (q.context_sums(docs, "text") == want).all()


def test_pooling():
    rng = np.random.default_rng(1)
    vectors = q.word_vectors(rng.normal(size=(q.BUCKETS, q.DIMS)))
    got = q.pooled(q.Tokens(), vectors, texts())
    for text, row in zip(texts(), got, strict=True):
        ids = [b for w in (text or "").split() for b in q.word_buckets(w)]
        if not ids:
            assert not row.any()
            continue
        mean = sum(vectors[b].astype(np.float64) for b in ids) / len(ids)
        words = [b for b in ids if b >= q.SHAPES + q.SYMBOLS]
        again = np.mean([a == b for a, b in zip(words, words[1:], strict=False)]) if len(words) > 1 else 0
        symbols = sum(q.SHAPES <= b < q.SHAPES + q.SYMBOLS for b in ids) / len(ids)
        figures = [np.log1p(len(ids)), len(set(ids)) / len(ids), np.linalg.norm(mean), symbols, max(Counter(words).values(), default=0) / len(ids), again]
        np.testing.assert_allclose(row, [*mean, *figures], atol=1e-5)


def test_whole_words_count():
    assert q.word_buckets("########a") != q.word_buckets("########a%") and q.word_buckets("b" * 40) != q.word_buckets("b" * 60)


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(7, 1)] * 300, "doc_id long, quality int")
    model, again = (q.fit_quality(docs, labels, max_labelled=50) for _ in range(2))
    assert all((a == b).all() for a, b in zip(model.layers, again.layers, strict=True))
