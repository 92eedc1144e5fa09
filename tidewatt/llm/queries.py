"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatt.llm import bpe, chat, language, licenses, packing, quality, runtime, secret_scan, simhash, token_files, vectors

#: End ids, thresholds and vocabularies of the contract.
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
SECRET_RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = runtime.fresh_path(spark, "token-files")
    manifest = token_files.write_shards(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_VOCABULARY), end_id=2)
    return token_files.read_documents(spark, folder, manifest)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return chat.format_preferences(*chat.with_other_answers(turns))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"), public_tokenizers.path(SECRET_RANKS), public_tokenizers.PATTERN)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), max_diff=4, shingle=4)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), end_id=0, capacity=2048)


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES = {f.__name__: f for f in (op1_token_files, op2_license_scan, op3_quality_rules, op4_byte_bpe, op5_preference_format, op6_language_id, op7_secret_scan, op8_simhash, op9_best_fit_packing, op10_near_vectors)}
ORACLES = {"op5_preference_format": chat.ORACLE}
