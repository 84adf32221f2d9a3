"""Quality classifier: random-indexing word vectors, pooled per document, under a small network with calibrated output."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import for_python

#: Word vectors are kept for hash buckets, so their table has one size for every corpus: shapes, symbols, words.
SHAPES, SYMBOLS, WORDS = 256, 768, 7_168
BUCKETS = SHAPES + SYMBOLS + WORDS
DIMS, NONZERO, REACH = 64, 4, 2
STATS = 6
HIDDEN = 32
#: Labelled rows that a fit uses at most, those whose id hashes lowest. Corpus statistics cover all texts.
MAX_LABELLED = 20_000
REMEMBERED = 150_000

_LETTERS = re.compile(r"[^\W\d_]+")
_OTHER = re.compile(r"[\W\d_]+")
_DIGIT = re.compile(r"\d")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of each bucket's random index vector, by seed."""
    rng = np.random.default_rng(20_260_101)
    places = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice([-1, 1], (BUCKETS, NONZERO)).astype(np.int64)


def word_buckets(word: str) -> list[int]:
    """The tokens of a word: its shape (case and length), its symbols if it has any, its letters in lower case."""
    letters, symbols = _OTHER.sub("", word), _DIGIT.sub("0", _LETTERS.sub("", word))
    case = "u" if letters.isupper() and len(letters) > 1 else "l" if letters.islower() else "t" if letters.istitle() else "m"
    out = [zlib.crc32(f"{case}{len(letters) // 2}".encode()) % SHAPES]
    if symbols:
        out.append(SHAPES + zlib.crc32(symbols.encode("utf-8", "replace")) % SYMBOLS)
    if letters:
        out.append(SHAPES + SYMBOLS + zlib.crc32(letters.lower().encode("utf-8", "replace")) % WORDS)
    return out


class Tokens:
    """Texts to bucket numbers; remembers a bounded number of words, in two generations."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        cut = [t.split() if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        kept = new.intersection(self.older)
        self.known.update(zip(kept, map(self.older.__getitem__, kept), strict=True))
        for word in new - kept:
            self.known[word] = np.array(word_buckets(word), dtype="<i4").tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), dtype="<i4") for words in cut]


def context_sums(docs: DataFrame, text_col: str) -> np.ndarray:
    """For each bucket the sum of the index vectors of its neighbours (REACH to either side) in all texts.

    Each task adds up its own texts and sends a row for each bucket that it met; the rows are summed by bucket. The
    result has BUCKETS rows whatever the corpus.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        places, signs = np.vstack([places, np.zeros((1, NONZERO), np.int64)]), np.vstack([signs, np.zeros((1, NONZERO), np.int64)])
        total, tokens, gap = np.zeros((BUCKETS + 1) * DIMS), Tokens(), np.full(REACH, BUCKETS, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), 500):
                ids = np.concatenate([x for row in tokens.of(column.slice(at, 500).to_pylist()) for x in (row, gap)])
                for reach in range(1, REACH + 1):
                    left, right = ids[:-reach], ids[reach:]
                    for word, context in ((left, right), (right, left)):
                        base = word * DIMS
                        for j in range(NONZERO):
                            total += np.bincount(base + places[context, j], weights=signs[context, j], minlength=len(total))
        table = total.reshape(BUCKETS + 1, DIMS)[:BUCKETS]
        met = np.flatnonzero(table.any(axis=1))
        if len(met):
            flat = pa.array(table[met].astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32) * DIMS), flat)], ["bucket", "v"])

    parts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(partial, "bucket int, v array<int>")
    summed = parts.groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS)])
    out = np.zeros((BUCKETS, DIMS))
    rows = summed.toArrow()  # at most BUCKETS rows
    if rows.num_rows:
        out[rows["bucket"].to_numpy()] = np.column_stack([rows[f"v{i}"].to_numpy() for i in range(DIMS)])
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors; a bucket that was never met has the null vector."""
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.where(norms > 0, norms, 1)).astype(np.float32)


def pooled(tokens: Tokens, vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """For each text the mean of its word vectors, and six figures: length, share of distinct tokens, the mean's norm,
    share of symbol tokens, share of the commonest word, share of words that repeat the one before. An empty text is all
    zeros."""
    out = np.zeros((len(texts), DIMS + STATS), dtype=np.float32)
    for i, ids in enumerate(tokens.of(texts)):
        if len(ids):
            counts = np.bincount(ids, minlength=BUCKETS)
            met = np.flatnonzero(counts)
            mean = counts[met].astype(np.float32) @ vectors[met] / len(ids)
            out[i, :DIMS] = mean
            words = ids[ids >= SHAPES + SYMBOLS]
            again = np.mean(words[1:] == words[:-1]) if len(words) > 1 else 0.0
            out[i, DIMS:] = (np.log1p(len(ids)), len(met) / len(ids), np.linalg.norm(mean), counts[SHAPES : SHAPES + SYMBOLS].sum() / len(ids), counts[SHAPES + SYMBOLS :].max() / len(ids), again)
    return out


@dataclass(frozen=True)
class QualityModel:
    """vectors: the word vectors; centre and scale of the inputs; two layers; the temperature of the output."""

    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.centre) / self.scale, -6, 6) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, epochs: int = 30, step: float = 3e-3, decay: float = 1e-4) -> QualityModel:
    """Fits the network by Adam on four fifths of the rows, and the temperature on the last fifth.

    Without rows, every score is 1/2.
    """
    if not len(y):
        zero = (np.zeros((DIMS + STATS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(()))
        return QualityModel(vectors, np.zeros(DIMS + STATS), np.ones(DIMS + STATS), zero, 1.0)
    rng = np.random.default_rng(7)
    x, y = x.astype(np.float64), y.astype(np.float64)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    order = rng.permutation(len(y))
    check, fit = order[: len(y) // 5], order[len(y) // 5 :]
    z = np.clip((x - centre) / scale, -6, 6)
    params = [rng.normal(0, (DIMS + STATS) ** -0.5, (DIMS + STATS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    mean, square, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), 256):
            rows = fit[at : at + 256]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + decay * params[0], back.sum(axis=0), hidden.T @ error + decay * params[2], error.sum()]
            t += 1
            for i, g in enumerate(grads):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                params[i] = params[i] - step * (mean[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
    model = QualityModel(vectors, centre, scale, tuple(params), 1.0)
    if len(check) < 20:
        return model
    logits, wanted = model.logits(x[check]), y[check]
    trials = np.exp(np.linspace(np.log(0.5), np.log(5), 60))
    losses = [np.mean(np.logaddexp(0, -np.where(wanted > 0.5, logits, -logits) / s)) for s in trials]
    return QualityModel(vectors, centre, scale, tuple(params), float(trials[int(np.argmin(losses))]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, mod 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Word vectors from all texts; the network from at most max_labelled labelled rows that are not held out, those
    whose id hashes lowest.

    Rows without text are empty texts, null labels are left out, repeated labels and repeated documents count as often as
    they stand. Very long texts are one row of one task, whole. Inputs are made from the text alone; extra columns are
    ignored. Ties of the hash are broken by id and label, and rows are put in order before the fit, so reruns agree. With
    empty tables, or without labels, the model scores 1/2.
    """
    spark = docs.sparkSession
    for_python(spark)
    vectors = word_vectors(context_sums(docs, text_col))
    known = labels.filter(F.col(f"`{label_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`"))).select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(max_labelled)
    # The sample has at most max_labelled rows, so the broadcast has, too: texts stay where they are.
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    shipped = spark.sparkContext.broadcast(vectors)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            x = pooled(tokens, shipped.value, batch.column(0).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["x", "label"])

    got = rows.select("text", "label").mapInArrow(inputs, "x array<float>, label int").toArrow()
    x = np.array(got["x"].combine_chunks().flatten(), dtype=np.float32).reshape(-1, DIMS + STATS) if got.num_rows else np.zeros((0, DIMS + STATS), np.float32)
    y = got["label"].to_numpy() if got.num_rows else np.zeros(0)
    order = np.lexsort([y, *x.T]) if len(y) else []  # rows come in no fixed order
    return train(x[order], y[order], vectors)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds out_col (double, 0 to 1): how likely the text's label is 1. Null and empty texts are scored alike, as are
    repeated rows; very long texts are read whole. Empty tables stay empty.

    The model (about 2 MB, of fixed size) is broadcast; texts stay where they are. An existing out_col is replaced, other
    columns stay, whatever their names.
    """
    for_python(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = Tokens()
        for texts in batches:
            yield pa.array(shipped.value.scores(pooled(tokens, shipped.value.vectors, texts.to_pylist())), pa.float64())

    return docs.withColumn(out_col, scored(F.col(f"`{text_col}`").cast("string")))
