"""Vector search in cells: exact by rounds, and the recall of a few probes."""

import numpy as np

from corpusloom.operators import cells as ce


def exact(vectors, query, k):
    q = np.array(query) / np.linalg.norm(query)
    scored = sorted((-float(np.array(v) @ q / np.linalg.norm(v)), i) for i, v in vectors if v and None not in v and 0 < np.linalg.norm(v) < np.inf)
    return [i for _, i in scored[:k]]


def test_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    vectors = [(i, (centres[i % 40] + 0.25 * rng.normal(size=16)).tolist()) for i in range(4_000)]
    vectors += [(5_000, None), (5_001, [0.0] * 16), (5_002, [float("nan")] * 16), (5_003, [None, *[1.0] * 15]), (5_004, vectors[7][1]), (5_005, [x * 3 for x in vectors[7][1]])]
    path = str(tmp_path / "cells")
    ce.write_cells(spark.createDataFrame(vectors, "id long, e array<double>").repartition(4), "id", "e", path, 32, sample=2_000)
    queries = [vectors[7][1], *(rng.normal(size=16).tolist() for _ in range(3)), *((centres[j] + 0.25 * rng.normal(size=16)).tolist() for j in range(8))]
    hit = 0
    for q in queries:
        want = exact(vectors, q, 10)
        got = ce.nearest(spark, path, q, 10).collect()
        if q is not vectors[7][1]:  # equal vectors may differ in the last digit
            assert [r["id"] for r in got] == want
        else:
            assert {r["id"] for r in got} == set(want)
        hit += len({r["id"] for r in ce.nearest(spark, path, q, 10, probes=4).collect()} & set(want))
    assert hit / (10 * len(queries)) >= 0.95
    assert ce.nearest(spark, path, [0.0] * 16, 10).count() == 0


def test_no_vectors(spark, tmp_path):
    ce.write_cells(spark.createDataFrame([(1, None)], "id long, e array<float>"), "id", "e", str(tmp_path / "none"), 4)
    assert ce.nearest(spark, str(tmp_path / "none"), [1.0], 3).count() == 0
