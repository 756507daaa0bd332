"""The ten operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bpe, chat, credentials, langid, media, minhash, packing, quality, sketch, suffix
from lattica.tables import load

#: The tokenizer of the queries.
TOKENIZER = "word_bpe_49k.json"


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(load(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(load(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(load(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secret_digest(load(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), words=2, percent=80)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compared_with_next(load(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(load(spark, sf_dir, "documents"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_report(load(spark, sf_dir, "documents"))
