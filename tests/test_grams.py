"""n-grams of texts: taken apart a slice at a time, and containment against plain Python."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from corpusloom.functions import udfs
from corpusloom.operators import search as se


def test_grams_hold_a_slice_of_a_batch(monkeypatch):
    """A batch of 4 million characters: what is held beside it is of some 100,000, and rows and sets are whole."""
    monkeypatch.setattr(udfs, "CHARS", 100_000)
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 20_000))) for _ in range(200)] + [None, "", "short", "ä가😀" * 60_000, "abcdefgh"]
    batch = pa.RecordBatch.from_pydict({"id": [f"k{i}" for i in range(len(texts))], "text": texts})
    want = {f"k{i}": (np.unique(h[::7]).tolist(), np.unique(h).size) for i, t in enumerate(texts) for h in [udfs.gram_hashes(t or "", 6)]}
    tracemalloc.start()
    got, sizes = {}, []
    for out in udfs.gram_batches(iter([batch.slice(0, 0), batch]), 6, {"probes": 7, "grams": 1}):
        sizes.append(out.num_rows)
        assert out.schema.names == ["id", "probes", "grams"]
        got |= dict(zip(out.column(0).to_pylist(), zip(out.column(1).to_pylist(), out.column(2).value_lengths().to_pylist(), strict=True), strict=True))
        if len(sizes) == 30:
            peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and sum(sizes) == len(texts) and set(sizes[:39]) == {5}
    assert peak < 24_000_000


def test_containment_against_plain_python(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    sources = [(f"s{i}", " ".join(word() for _ in range(rng.randrange(3, 30)))) for i in range(12)] + [("null", None), ("short", "abc")]
    targets = [(i, " ".join([word(), sources[i % 12][1].upper(), *(word() for _ in range(rng.randrange(0, 60)))])) for i in range(60)] + [(100, None), (101, ""), (102, "ab · c")]
    squeezed = lambda t: "".join((t or "").lower().replace("·", "").split())
    grams = lambda t, step: {t[i : i + 6] for i in range(0, len(t) - 5, step)}
    want = set()
    for s, a in sources:
        for t, b in targets:
            x, y = squeezed(a), squeezed(b)
            if len(x) >= 6 and len(y) >= 6:
                ratio = round(len(grams(x, 7) & grams(y, 1)) / len(grams(x, 7)), 6)
                back = round(len(grams(y, 7) & grams(x, 1)) / len(grams(y, 7)), 6)
                if ratio >= 0.15 and back >= 0.15:
                    want.add((t, s, ratio, back))
    found = se.containment(spark.createDataFrame(sources, "item string, text string"), "item", spark.createDataFrame(targets, "doc int, text string"), "doc", "text")
    assert found.dtypes == [("target", "int"), ("source", "string"), ("ratio", "double"), ("back_ratio", "double")]
    assert {tuple(r) for r in found.collect()} == want and len(want) > 20
