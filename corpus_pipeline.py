"""A corpus in five stages: quality, near-duplicates, benchmark passages, secrets, token ids.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of `docs`; what they
decide takes effect: poor documents and contaminated ones are left out, one document of each group
of near-duplicates stays, and secrets are replaced by the name of their kind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywise.llm import bpe_sql, decontaminate, secret_scan, simhash_golay, site_quality
from tallywise.llm.common import ship_package, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    ship_package(spark)
    return site_quality.without_rejected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of 4-word shingles within four bits, that with the smallest id."""
    ship_package(spark)
    return simhash_golay.without_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    ship_package(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and the number of characters brought up to date."""
    ship_package(spark)
    clean = secret_scan.without_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each document."""
    ship_package(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_sql.encoded(docs, vocabulary, public_tokenizers.PATTERN, outputs=("ids", "decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("token_ids", token_ids),
]

ORACLE_SQL = None  # the classifier, the fingerprints and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return stored(STAGES[-1][1](spark, docs, sf_dir))
