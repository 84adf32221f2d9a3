"""The named queries as they are registered: SQL twins, the tokenizer libraries, and plain forms of the pipeline's stages."""

import hashlib
import math

import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import tokenizers

from corpusloom.llm import queries
from corpusloom.session import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_tokens_of_all_documents(spark):
    """Counts and ids of every text against the libraries."""
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    counts = {r["doc_id"]: r for r in queries.QUERIES["op3_token_counts"](spark, SF).collect()}
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in texts.items():
        n = len(own.encode(text, add_special_tokens=False).ids)
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len(text.encode()), n, n > 512)
    from tiktoken.load import load_tiktoken_bpe

    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    coded = {r["doc_id"]: r for r in queries.QUERIES["op10_bpe_round_trip"](spark, SF).collect()}
    for i, text in texts.items():
        ids = coder.encode_ordinary(text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (coded[i]["n_tokens"], coded[i]["ids_sha256"], coded[i]["decoded_sha256"]) == (len(ids), digest, hashlib.sha256(text.encode()).hexdigest())


def odd_documents(spark):
    rows = [(1, "first line here\nsecond", "en", "a", 5), (1, "first line here\nsecond", "en", "a", 5), (None, None, None, None, None), (2, "", "en", "b", 0), (3, "word " * 3000, "de", "a", 15000), (None, "one two three four five six", "en", None, 27)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ", __score double, __copy int, __kept_id long, __mix_key string, __text_key string, n_dropped int"
    return spark.createDataFrame(rows, schema), spark.createDataFrame([(*r, 0.5, 1, 2, "k", "t", 3) for r in rows], schema + extra)


def test_stages_take_odd_rows_and_clashing_names(spark):
    import corpus_pipeline as cp

    for docs in odd_documents(spark):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            left = out.select("doc_id", "text").collect()
            texts = {r["text"] for r in docs.collect()}
            assert all(r["text"] in texts for r in left), name  # nothing recurs here, so no line goes
            if name == "line dedup":
                assert len(left) == 6
            if name == "minhash near-dedup":
                assert len(left) == 5  # the repeated row once
        coded = cp.STAGES[-1][1](spark, docs, SF).collect()
        assert len(coded) == 6 and all(r["n_tokens"] == len(r["ids"]) for r in coded)


def test_near_dedup_stage_against_all_pairs(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = (r["text"] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = {r["doc_id"]: r["doc_id"] for r in rows}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(rows[i]["doc_id"]), find(rows[j]["doc_id"])))
                low[y] = x
    kept = {r["doc_id"] for r in cp.STAGES[2][1](spark, docs, SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in rows if find(r["doc_id"]) == r["doc_id"]}


def test_quality_stage_keeps_what_the_model_accepts(spark):
    import corpus_pipeline as cp

    scored = {r["doc_id"]: r["score"] for r in queries.QUERIES["op2_quality_scores"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in cp.STAGES[0][1](spark, docs, SF).select("doc_id").collect()}
    assert kept == {i for i, s in scored.items() if s >= cp.LEAST_QUALITY}
