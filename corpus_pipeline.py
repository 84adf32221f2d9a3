"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents, and any others that docs has, whatever their names. In every stage repeated rows are rows like others but where
it says otherwise, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import linededup, minhash, mixing, quality, tokens
from corpusloom.llm.common import unused, written

#: Rows scored below this are rejected.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below LEAST_QUALITY go. It learns from the labels of rows not held out.

    Null and empty texts get the score of an empty text, very long ones are scored whole. Repeated rows and rows with a
    null id are scored like others; only rows whose id has a label are learned from. Ties stay: a score equal to the bound
    is kept.
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(docs, "__score")
    return quality.score_quality(docs, model, out_col=score).filter(F.col(score) >= LEAST_QUALITY).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines whose template recurs across documents go; n_chars follows the text that is left.

    Null and empty texts stay as they are, very long ones are split whole. A document that loses all its lines stays, with
    an empty text. Repeated rows, equal texts and near copies count once, and all lose the same lines, so there are no
    ties. A null id is not looked at. n_chars of untouched rows stays, null too.
    """
    own = {c: unused(docs, f"__own_{c}")[0] for c in ("n_lines", "n_dropped") if c in docs.columns}
    clean = linededup.drop_recurring_lines(docs.withColumnsRenamed(own))
    clean = clean.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.drop("n_lines", "n_dropped").withColumnsRenamed({held: c for c, held in own.items()}).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays, that with the smallest id.

    Null and empty texts are alike nothing: each id stays once. Very long texts are shingled whole. Of repeated rows (same
    id and text) one stays, that whose columns have the least hash; a null id is an id like others, and the smallest.
    """
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents stand as often as the mix of sources takes them, up to twice.

    Null and empty texts have no words: they stand as often as their whole part says. A null source is one like others, and
    the last in order. Very long texts weigh as much as they have words. Rows alike in source, id and size get one of two
    neighbouring numbers of copies; ties are settled by the hash of the text, so reruns agree.
    """
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the token ids of each text, and the digest of what they decode to.

    Returns doc_id, lang, source, n_tokens, ids and decoded_sha256 of every row, in which null texts count as empty and
    very long ones are encoded whole; n_chars, the text and columns that are not of documents are left out. There are no
    ties, and repeated rows are encoded like others.
    """
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = tokens.round_trip_bpe(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("minhash near-dedup", drop_copies),
    ("mixing sources", mix),
    ("byte-level bpe", encode),
]

#: The classifier, the rounding's draws and the token ids have no SQL form; tests hold each stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
