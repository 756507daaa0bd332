"""A corpus pipeline: five stages, each one of the operators, from documents to packed sequences.

A stage works on all that the one before kept.  All but the last return the columns of
``documents``, with ``n_chars`` as long as the text now is.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import credentials, minhash, packing, quality, suffix
from lattica.plans.durable import staged
from lattica.tables import load, reachable

TOKENIZER, END_ID = "word_bpe_49k.json", 1


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def _stage(f):
    """``f`` after the workers can import what it runs."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reachable(spark)
        return f(spark, docs, sf_dir)

    return run


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.fit(docs))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, on shingles of five words at 0.8."""
    return minhash.without_near_duplicates(docs, words=5, percent=80)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings as long as a passage of fifty words that occur more than once."""
    return _sized(suffix.dedup_text(docs, suffix.PASSAGE))


@_stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mask in place of secrets."""
    return _sized(credentials.redact(docs))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized texts, packed into sequences of 2048."""
    return packing.pack_texts(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage{k}")
    return docs
