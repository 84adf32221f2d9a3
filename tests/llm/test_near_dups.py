"""Near-duplicates of texts and vectors against all pairs."""

import random

import numpy as np
import pytest

from corpusloom.llm import embeddings, minhash
from corpusloom.llm.components import connected


def components(n, links):
    low = list(range(n))
    for _ in range(n):
        moved = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                moved = True
        if not moved:
            return low
    return low


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out = []
    for length in (3, 6, 9, 14, 30, 60, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(length)]
            out.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, 5):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = word()
                out.append(" ".join(copy))
    for _ in range(12):  # variants that are near their base only
        base = [word() for _ in range(100)]
        for _ in range(7):
            copy = list(base)
            for _ in range(2):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        out.append(" ".join(base))
    passage = " ".join(word() for _ in range(80))  # shared by documents that are about half alike
    out += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(40)]
    out += [passage + " " + " ".join(word() for _ in range(20)) for _ in range(25)]
    out += ["", None, "   ", "one", "one", "ONE", "a b c d", "x y z w v", "Ä b c d e f", "ä b c d e f"]
    return out


def test_documents(spark):
    given = texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    sets = []
    for t in given:
        w = minhash.words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    low = components(len(sets), links)
    assert [got[i]["component_id"] for i in range(len(sets))] == low
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (low[i] == i) for i, s in enumerate(sets))
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, x in enumerate(low) if x == i}


def test_small_tiles(spark, monkeypatch):
    """Buckets that their star leaves unsettled, in blocks of a few nodes."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    test_documents(spark)


def test_documents_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "p q r s t u"), (None, None), (9, "w " * 30_000)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, ((r["doc_id"], r["component_id"], r["kept"]) for r in got))) == sorted(
        map(repr, [(None, 5, False), (5, 5, True), (5, 5, True), (None, None, True), (None, None, True), (9, 9, True)])
    )
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4


def test_sketch_recall():
    rng = np.random.default_rng(1)
    missed = 0
    for n in (1, 2, 3, 5, 8, 20, 75, 300, 2000):
        for _ in range(60):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            extra = rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
            a, b = np.unique(both), np.unique(np.concatenate([both, extra]))
            missed += not (minhash.band_keys(minhash.signature(a)) == minhash.band_keys(minhash.signature(b))).any()
    assert missed == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + k) for k in range(1, 90)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    low = components(901, links)
    seen = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == seen
    assert all((got[a] == got[b]) == (low[a] == low[b]) for a in seen for b in list(seen)[:60])


@pytest.mark.parametrize(("dims", "block", "cut"), [(64, 1024, None), (16, 32, None), (3, 16, None), (1, 8, None), (64, 16, 5), (16, 1024, 2), (3, 8, 1)])
def test_vectors(spark, dims, block, cut):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(30, dims))
    rows = [(v + rng.normal(size=dims) * rng.choice([0, 0.1, 0.3, 0.5]) * np.linalg.norm(v) / dims**0.5) * rng.choice([1, 7]) for v in base for _ in range(5)]
    given = [[float(x) for x in np.float32(v)] for v in rows]
    labels = [[0, 1, None][int(rng.integers(0, 30)) % 7 % 3] for _ in given]
    given += [given[0]] * 20 + [[0.0] * dims, None, [], [float("nan")] * dims, [float("inf")] * dims, [None] * dims, [1.0] * (dims + 1)]
    labels += [labels[0]] * 20 + [0] * 7
    frame = spark.createDataFrame([(i, v, k, 1) for i, (v, k) in enumerate(zip(given, labels, strict=True))], "vec_id long, embedding array<float>, label int, n_links int")
    good = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for v in given]
    links = []
    for i in range(len(given)):
        for j in range(i):
            if good[i] and good[j] and labels[i] is not None and labels[i] == labels[j] and len(given[i]) == len(given[j]):
                a, b = np.array(given[i]), np.array(given[j])
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93 - 1e-13:
                    links.append((i, j))
    low, count = components(len(given), links), np.bincount(np.array(links).ravel(), minlength=len(given)) if links else np.zeros(len(given))
    got = {r["vec_id"]: r for r in embeddings.near_vectors(frame, block=block, cut=cut).collect()}
    assert [got[i]["component_id"] for i in range(len(given))] == low
    assert [got[i]["n_links"] for i in range(len(given))] == count.tolist()
    assert all(got[i]["kept"] == (low[i] == i) for i in got)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_border_links_do_not_depend_on_rows_or_blocks(spark):
    """Pairs whose cosine is 0.93 but for the last bits: the same links in any order, block and cell."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(40):
        a = rng.normal(size=16)
        a /= np.linalg.norm(a)
        b = rng.normal(size=16)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [a * 3, (0.93 * a + (1 - 0.93**2) ** 0.5 * b) * 5]
    schema, seen = "vec_id long, embedding array<double>, label int", set()
    for block, cut, order in [(1024, None, list(range(80))), (7, 0, list(range(80))[::-1]), (16, 3, rng.permutation(80).tolist())]:
        frame = spark.createDataFrame([(i, rows[i].tolist(), 1) for i in order], schema)
        seen.add(tuple(sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(frame, block=block, cut=cut).collect())))
    assert len(seen) == 1 and 0 < sum(n for _, n, _ in seen.pop()) < 80


def test_lists_miss_few_pairs_and_hold_few_strangers():
    rng = np.random.default_rng(3)
    n, dims, k = 20_000, 64, 6
    many = embeddings.lists(dims, 0.93, k)
    a = rng.normal(size=(300, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    assert (embeddings.cell_keys(a, 0.93, k, 0, many) == embeddings.cell_keys(b, 0.93, k, 0, many)).any(axis=1).all()
    spread = rng.normal(size=(n, dims))
    cells = embeddings.cell_keys(spread / np.linalg.norm(spread, axis=1, keepdims=True), 0.93, k, 0, 3)
    held = [np.unique(cells[:, t], return_counts=True)[1] for t in range(3)]
    assert max((h * h).sum() / n for h in held) < n / 50
    assert embeddings.cuts(5_000, dims, 0.93) == 0
    for n in (10**6, 10**8):  # rows and pairs a vector grow far more slowly than the label
        k = embeddings.cuts(n, dims, 0.93)
        assert k > 5 and embeddings.lists(dims, 0.93, k) < n**0.35
