"""Encoding, decoding and counting against the libraries themselves."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import tokens
from corpusloom.llm.bpe import Coder, Vocabulary, pieces

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "  \n\n ", "a" * 3000, " a  b\u0085c  d", "it's we'll I'D 's", "x <|endoftext|> y<|endoftext|>", "\x00 \x00a", "漢字 かな 🎉🎉", "1234567 ٣٤", "ab" * 500, "tab\tnew\nline \r\n", " lead", "trail  "]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        vocabulary = Vocabulary.from_ranks(f.read())
    return Coder(vocabulary, P.PATTERN, {t: i for i, t in vocabulary.tokens.items()})


@pytest.fixture(scope="module")
def counter():
    with open(JSON, "rb") as f:
        vocabulary = Vocabulary.from_json(f.read())
    return Coder(vocabulary, P.PATTERN, {t.encode(): vocabulary.ids[t.encode()] for t in vocabulary.whole_tokens(regex.compile(P.PATTERN))})


def ids(data):
    return np.frombuffer(data, dtype="<i4").tolist()


def test_encode_matches_library(library, coder):
    rng = random.Random(3)
    letters = "aab \n\t\u0085 'strevml0123,.!-éü漢🎉"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    assert [ids(x) for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encode_any_text(library, coder, text):
    (got,) = coder.encode([text])
    assert ids(got) == library.encode_ordinary(text)
    assert coder.decode(np.array(ids(got))) == text.encode()
    assert "".join(pieces(text)) == text


def test_pieces_cross_no_match():
    pattern = regex.compile(P.PATTERN)
    for text in ODD:
        assert [m for p in pieces(text) for m in pattern.findall(p)] == pattern.findall(text)


def test_replay_equals_plain_merging(coder):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdethn") for _ in range(rng.randint(1, 20))).encode() for _ in range(2000)] + [b"aaaaaaa", b"aaaa", b"", b"\xff\xfe"]
    assert [ids(x) for x in coder.vocabulary.replay(words)] == [coder.vocabulary.one_word(w) for w in words]


def test_counts_match_library(counter):
    library = Tokenizer.from_file(JSON)
    got = [len(x) >> 2 for x in counter.encode_with_specials(ODD)]
    assert got == [len(e.ids) for e in library.encode_batch(ODD, add_special_tokens=False)]


def test_whole_tokens_are_proven(counter):
    library = Tokenizer.from_file(JSON)
    some = random.Random(1).sample(sorted(counter.whole), 2000)
    assert all(len(e.ids) == 1 for e in library.encode_batch([w.decode() for w in some], add_special_tokens=False))


def test_frames(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello  world", "z"), (3, "hello  world", "z"), (None, "a" * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = tokens.decode_bpe(tokens.encode_bpe(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    got = coded.withColumn("digest", tokens.ids_digest(coded["ids"])).collect()
    assert len(got) == 5
    for r in got:
        want = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["digest"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    once = tokens.round_trip_bpe(docs, RANKS, P.PATTERN)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, coded.collect())) and once.columns == coded.columns
    counted = tokens.count_tokens(docs.withColumnRenamed("ids", "n_tokens"), JSON, P.PATTERN)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in counted.collect())[1:3] == [(1, 0), (2, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(tokens.encode_bpe(empty, RANKS, P.PATTERN), JSON, P.PATTERN).count() == 0


def test_other_patterns_are_matched_over_the_whole_text():
    vocabulary = Vocabulary.from_ranks(b"".join(base64.b64encode(bytes([i])) + f" {i}\n".encode() for i in range(256)))
    for pattern, text, want in ((r"\S+ \S+|\s|\S+", "the cat sat", ["the cat", " ", "sat"]), (r"(?<=a )b|.", "a b", ["a", " ", "b"])):
        coder = Coder(vocabulary, pattern)
        assert coder._matches(text) == want and not coder.cuttable
        assert coder.encode([text]) == [np.frombuffer(text.encode(), dtype=np.uint8).astype("<i4").tobytes()]
    assert Coder(vocabulary, P.PATTERN).cuttable
