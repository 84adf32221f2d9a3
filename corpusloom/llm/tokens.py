"""Token counts, and byte-level BPE encoding and decoding, as DataFrame operators.

The vocabulary file is read once on the driver and broadcast (its size is fixed by the tokenizer, about 1.5 MB, and
does not grow with the data). Texts never leave their partition: there is no shuffle.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import Coder, Vocabulary
from corpusloom.llm.common import for_python, unused

_CODERS: dict[tuple, Coder] = {}


def _vocabulary(data: bytes, kind: str) -> Vocabulary:
    return Vocabulary.from_ranks(data) if kind == "ranks" else Vocabulary.from_json(data)


def _coder(data: bytes, kind: str, pattern: str, proven: frozenset[str] = frozenset()) -> Coder:
    """One coder for each vocabulary and Python worker; what it remembers serves the worker's later tasks too."""
    key = (hashlib.sha256(data).digest(), kind, pattern, len(proven))
    if key not in _CODERS:
        vocabulary = _vocabulary(data, kind)
        _CODERS[key] = Coder(vocabulary, pattern, {t: i for i, t in vocabulary.tokens.items()} if kind == "ranks" else {t.encode(): vocabulary.ids[t.encode()] for t in proven})
    return _CODERS[key]


@functools.lru_cache(maxsize=8)
def _proven(path: str, pattern: str) -> frozenset[str]:
    """The whole-token strings of a vocabulary file; a fixed set, proven once on the driver."""
    with open(path, "rb") as f:
        return frozenset(_vocabulary(f.read(), _kind(path)).whole_tokens(regex.compile(pattern)))


def _shipped(spark: SparkSession, path: str):
    for_python(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _kind(path: str) -> str:
    return "json" if path.endswith(".json") else "ranks"


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Adds out_col (long): how many tokens the text has under the tokenizer, special strings in it counted as one.

    Whole-token shortcut: the vocabulary strings that encode alone as one token are proven first (one match of the
    pattern, replayed to one id); a pre-token among them counts 1 unmerged, only the rest is merged.

    Null and empty texts: 0. Very long texts are cut into pieces and held by one task. Repeated rows count alike. An
    existing out_col is replaced; other columns stay, whatever their names. Empty tables stay empty.
    """
    data, kind = _shipped(docs.sparkSession, tokenizer_path), _kind(tokenizer_path)
    proven = docs.sparkSession.sparkContext.broadcast(_proven(tokenizer_path, pattern))

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(data.value, kind, pattern, proven.value)
        for texts in batches:
            yield pa.array([len(ids) >> 2 for ids in coder.encode_with_specials(texts.to_pylist())], pa.int64())

    return docs.withColumn(out_col, counted(F.col(f"`{text_col}`")))


def encode_bpe(docs: DataFrame, tokenizer_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds out_col (array<int>): the text's token ids by corpus-level merge replay, without special tokens.

    Null and empty texts: an empty array. Very long texts are held by one task as ids. Repeated rows encode alike. An
    existing out_col is replaced; other columns stay, whatever their names. Empty tables stay empty.
    """
    data, kind = _shipped(docs.sparkSession, tokenizer_path), _kind(tokenizer_path)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(data.value, kind, pattern)
        for texts in batches:
            rows = coder.encode(texts.to_pylist())
            ends = np.cumsum([0] + [len(r) >> 2 for r in rows], dtype=np.int64).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))

    return docs.withColumn(out_col, encoded(F.col(f"`{text_col}`")))


def round_trip_bpe(docs: DataFrame, tokenizer_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encode_bpe() and decode_bpe() in one pass: adds the ids, and the bytes decoded from these ids.

    One Python worker for each task does both, so a task holds one vocabulary and sends its ids back once.
    """
    data, kind = _shipped(docs.sparkSession, tokenizer_path), _kind(tokenizer_path)

    @F.arrow_udf("ids array<int>, decoded binary")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(data.value, kind, pattern)
        for texts in batches:
            rows = coder.encode(texts.to_pylist())
            ends = np.cumsum([0] + [len(r) >> 2 for r in rows], dtype=np.int64).astype(np.int32)
            ids = np.frombuffer(b"".join(rows), dtype="<i4")
            del rows
            decoded = pa.array((coder.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)), pa.binary(), size=len(texts))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), decoded], ["ids", "decoded"])

    (name,) = unused(docs, "__coded")
    both = docs.withColumn(name, coded(F.col(f"`{text_col}`")))
    return both.withColumns({ids_col: F.col(f"{name}.ids"), decoded_col: F.col(f"{name}.decoded")}).drop(name)


def decode_bpe(docs: DataFrame, tokenizer_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col (binary): the bytes that the ids stand for. Null or empty ids: no bytes; an unknown id is an error."""
    data, kind = _shipped(docs.sparkSession, tokenizer_path), _kind(tokenizer_path)

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(data.value, kind, pattern)
        for lists in batches:
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            yield pa.array((coder.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)), pa.binary(), size=len(lists))

    return docs.withColumn(out_col, decoded(F.col(f"`{ids_col}`")))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
