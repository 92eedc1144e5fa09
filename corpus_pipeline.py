"""The corpus pipeline: quality rules, language ID, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each stage's rows and reads them again for the next, so
a lost executor costs a stage's tasks, never the stages before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatt.llm import language, packing, quality, runtime, secret_scan, simhash
from tidewatt.llm.queries import PIECES, SECRET_RANKS, WORD_VOCABULARY

#: The near-duplicate stage: words of a shingle. ``simhash.near_copies`` is made for a similarity of 0.8.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the tokeniser's fertility reject go."""
    return quality.keep_good(docs, public_tokenizers.path(PIECES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be determined, or is none of the learned ones, go."""
    return language.keep_known(docs, language.LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group stays; of rows of one doc_id those texts that lead a
    group, each once; rows of null doc_id stay."""
    text = runtime.free_name("text_hash", docs.columns)
    marked = docs.withColumn(text, F.xxhash64("text"))
    found = simhash.near_copies(marked, SHINGLE, keep=("doc_id", text))
    kept = found.where("doc_id = component_id").select("doc_id", text).distinct()
    named = marked.where("doc_id is not null").join(kept, ["doc_id", text], "left_semi").dropDuplicates(["doc_id", text])
    return named.unionByName(marked.where("doc_id is null")).select(*[F.col(runtime.quoted(c)) for c in docs.columns])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret gives way to a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs, public_tokenizers.path(SECRET_RANKS), public_tokenizers.PATTERN)
    return clean.withColumn("n_chars", F.char_length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, placed in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY), end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Fertility, support vector machines and XXH64 have no counterpart in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = runtime.materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before:  # its reader has been written
            runtime.remove(spark, before)
        before = path
    return docs
