"""The stored index: packed blocks, searches for all terms and phrases, and that a search reads its terms' folders only."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.trigrams import trigrams_of, word_similarity_of
from corpusloom.operators import index as ix


@pytest.mark.parametrize("block,parts", [(2_048, 1), (3, 2)])
def test_searches_against_texts(spark, tmp_path, monkeypatch, block, parts):
    monkeypatch.setattr(ix, "BLOCK", block)
    rng = random.Random(7)
    words = ["the", "cat", "sat", "on", "Ä", "mat", "가나", "x"]
    texts = {i * 3 - 20: [w.lower() for w in rng.choices(words, [9, 3, 3, 3, 1, 1, 1, 1], k=rng.randrange(0, 40))] for i in range(150)}
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(None, "the cat"), (9_000, None), (9_001, "")]
    path = str(tmp_path / "index")
    ix.write_index(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", ix.words_of(F.col("text")), path, 16, parts)
    read = ix.postings(spark, path, words, 16).collect()
    places = defaultdict(dict)
    for i, t in texts.items():
        for w in set(t):
            places[i, w] = [k for k, x in enumerate(t) if x == w]
    assert {(r["id"], r["term"]): r["positions"] for r in read} == {k: v for k, v in places.items() if k[1] != "ä"}  # terms are asked for as they are stored
    assert all(r["tf"] == len(r["positions"]) for r in read) and len(read) == len({(r["id"], r["term"]) for r in read})
    for asked in (["the"], ["the", "cat", "the"], ["ä", "가나", "x"], ["absent"], ["the", "absent"], []):
        want = {(i, sum(Counter(t)[w] for w in set(asked))) for i, t in texts.items() if asked and set(asked) <= set(t)}
        assert {tuple(r) for r in ix.all_terms(spark, path, asked, 16).collect()} == want
    for asked in (["the", "cat"], ["the", "the"], ["sat"], ["the", "cat", "the"], ["the", "absent"]):
        want = {i: [k for k in range(len(t)) if t[k : k + len(asked)] == asked] for i, t in texts.items()}
        assert {r["id"]: sorted(r["places"]) for r in ix.phrase(spark, path, asked, 16).collect()} == {i: p for i, p in want.items() if p}


def test_a_search_reads_its_folders_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} all") for i in range(200)], "id long, text string")
    path = tmp_path / "index"
    ix.write_index(docs, "id", ix.words_of(F.col("text")), str(path), 32)
    want = ix.all_terms(spark, str(path), ["w5", "all"], 32).collect()
    own = {f"bucket={r[0]}" for r in spark.createDataFrame([("w5",), ("all",)], "t string").select(F.pmod(F.xxhash64("t"), F.lit(32)).cast("int")).collect()}
    others = [d for d in path.glob("bucket=*") if d.name not in own]
    assert len(others) >= 25
    for d in others:  # what is not read may as well be broken
        for f in d.glob("*.parquet"):
            f.write_bytes(b"broken")
        for f in d.glob(".*.crc"):
            f.unlink()
    assert ix.all_terms(spark, str(path), ["w5", "all"], 32).collect() == want and len(want) == 2


def test_packed_integers():
    for values in ([], [0], [255, 0], [256], [70_000, 1], [2**40]):
        assert ix._unpacked(ix._packed(np.array(values, dtype=np.int64))).tolist() == values


def test_trigram_counts_settle_what_is_compared(spark, tmp_path):
    """Equal to the full scan, and under a twentieth of the texts are compared."""
    rng = random.Random(5)
    syllables = ["ka", "lo", "mi", "ne", "ru", "sta", "vo", "qui"]
    texts = [(i, " ".join("".join(rng.choices(syllables, k=rng.randrange(2, 4))) for _ in range(rng.randrange(1, 4)))) for i in range(600)] + [(700, None), (701, ""), (702, "Stavomi Quinelo")]
    docs = spark.createDataFrame(texts, "id long, text string")
    ix.write_trigrams(docs, "id", "text", str(tmp_path / "t"))
    asked, above = "stavomi quinelo", 0.6
    got = {r["id"]: r["sim"] for r in ix.alike_texts(docs, "id", "text", str(tmp_path / "t"), asked, above).collect()}
    assert got == {i: s for i, t in texts if t and (s := word_similarity_of(asked, t, above)) > above} and got[702] == 1.0
    few = ix.trigram_candidates(spark, str(tmp_path / "t"), asked, int(above * len(set(trigrams_of(asked)))) + 1).count()
    assert 0 < few < len(texts) / 20
    assert ix.alike_texts(docs, "id", "text", str(tmp_path / "t"), "", above).count() == 0


def test_a_row_for_each_distinct_term_is_shuffled(spark, tmp_path, monkeypatch):
    """Places of a term are put together before the shuffle; rows of one document are one posting, across blocks and
    slices of the words read at a time."""
    monkeypatch.setattr(ix, "BLOCK", 2)
    texts = [(i // 2, ["a", None, "a", "b"] * (i % 3)) for i in range(20)] + [(-5, ["a"] * 300)]
    docs = spark.createDataFrame(texts, "id long, terms array<string>")
    ix.write_index(docs, "id", F.col("terms"), str(tmp_path / "i"), 4)
    want = defaultdict(list)
    for i, terms in texts:
        for k, t in enumerate(terms):
            if t:
                want[i, t].append(k)
    got = ix.postings(spark, str(tmp_path / "i"), ["a", "b"], 4).collect()
    assert len(got) == len(want) and {(r["id"], r["term"]): r["positions"] for r in got} == {k: sorted(v) for k, v in want.items()}
    assert all(r["tf"] == len(r["positions"]) for r in got)
    monkeypatch.setattr(ix, "WORDS", 3)
    batch = pa.RecordBatch.from_pylist([{"id": i, "terms": t} for i, t in texts], pa.schema([("id", pa.int64()), ("terms", pa.list_(pa.string()))]))
    placed = [r for b in ix._placed(iter([batch, batch.slice(3, 5)])) for r in b.to_pylist()]
    again = [(i, t, [k for k, x in enumerate(terms) if x == t]) for i, terms in texts + texts[3:8] for t in dict.fromkeys(filter(None, terms))]
    assert sorted((r["id"], r["term"], np.cumsum(np.frombuffer(r["at"], dtype="<i4")).tolist()) for r in placed) == sorted(again)


@pytest.mark.parametrize("size,piece", [(10_000, 1_000_000), (7, 20), (1, 1)])
def test_postings_of_many_documents_are_one_row_before_the_shuffle(size, piece, monkeypatch):
    """A row for each term and cell of ids; blocks are those of plain Python, wherever batches and pieces of them end."""
    monkeypatch.setattr(ix, "SPAN", 16)
    rng = random.Random(size)
    ids = [i * 2 - 40 for i in range(60)] + [5, 5, 2**40]
    rng.shuffle(ids)
    texts = [(i, rng.choices(["a", "b", "é", *(f"w{k}" for k in range(30))], [40, 20, 5, *[1] * 30], k=rng.randrange(0, 600 if n % 20 == 0 else 30))) for n, i in enumerate(ids)]
    schema = pa.schema([("id", pa.int64()), ("terms", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([{"id": i, "terms": t} for i, t in texts[k : k + 21]], schema) for k in range(0, len(texts), 21)]
    gathered = [b for batch in batches for b in ix._gathered(ix._placed(iter([batch])))]
    rows = [r for b in gathered for r in b.to_pylist()]
    assert [b.num_rows for b in gathered] == [len({(t, i // 16) for i, terms in texts[k : k + 21] for t in terms}) for k in range(0, len(texts), 21)]
    assert len(rows) < 0.8 * sum(len(set(t)) for _, t in texts)
    rng.shuffle(rows)
    rows.sort(key=lambda r: (r["term"].encode(), r["cell"]))
    monkeypatch.setattr(ix, "WORDS", piece)
    cut = [pa.RecordBatch.from_pylist(rows[k : k + size], gathered[0].schema) for k in range(0, len(rows), size)]
    got = [r for b in ix._blocks(iter([gathered[0].slice(0, 0), *cut]), 3) for r in b.to_pylist()]
    want, whole = defaultdict(list), defaultdict(list)
    for i, terms in texts:
        whole[i].append(terms)
    for i, lists in sorted(whole.items()):
        for t in {t for terms in lists for t in terms}:
            want[t].append((i, sorted(k for terms in lists for k, x in enumerate(terms) if x == t)))
    blocks = [(t, found[k : k + 3]) for t, found in sorted(want.items(), key=lambda w: w[0].encode()) for k in range(0, len(found), 3)]
    read = []
    for r in got:
        counts, gaps = ix._unpacked(r["counts"]).tolist(), iter(ix._unpacked(r["positions"]).tolist())
        found = (r["first_id"] + np.cumsum(ix._unpacked(r["ids"]))).tolist()
        read.append((r["term"], [(i, np.cumsum([next(gaps) for _ in range(n)]).tolist()) for i, n in zip(found, counts, strict=True)]))
        assert r["n"] == len(found) and next(gaps, None) is None
    assert read == blocks


def test_packed_lists():
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, top, size) for top, size in [(9, 3), (1 << 40, 2), (1 << 16, 5), (5, 0), (1 << 20, 4), (256, 1)]]
    sizes = np.array([len(x) for x in lists])
    packed = ix._packed_lists(np.concatenate(lists), sizes)
    assert [ix._unpacked(p).tolist() for p in packed.to_pylist()] == [x.tolist() for x in lists]
    values, found = ix._unpacked_lists(packed.slice(1, 4))
    assert found.tolist() == sizes[1:5].tolist() and values.tolist() == np.concatenate(lists[1:5]).tolist()
