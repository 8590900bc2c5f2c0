"""Registered queries of the text operators: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from tallywise.llm import (
    bpe_sql,
    collocations,
    decontaminate,
    hilbert_search,
    language_id,
    merkle,
    page_text,
    quality_rules,
    repeats,
    secret_scan,
    simhash_golay,
    site_quality,
    token_files,
)
from tallywise.llm.common import ship_package, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = language_id.fit(documents.where(~held_out).select("doc_id", "text", "lang"))
    return language_id.predicted(documents, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.round_trip(table(spark, sf_dir, "documents"), path)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text_hash", "failed_rules")


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, sf_dir, "documents"))
    digest = F.sha2("base_spans", 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_quality.site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text_hash")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").withColumnRenamed("item", "item_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    documents = table(spark, sf_dir, "documents")
    outputs = ("ids_sha256", "decoded_sha256")
    return bpe_sql.encoded(documents, vocabulary, public_tokenizers.PATTERN, outputs=outputs)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = {"n_chars": F.col("n_chars") + 1}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    rows = merkle.leaves(table(spark, sf_dir, "documents"), fields, "doc_id", "lang", changed, chosen)
    return merkle.manifest(rows).checked().drop("g")


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))
    return found.withColumnRenamed("g", "lang")


_BUILDERS: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_quality_rules": op3_quality_rules,
    "op4_page_text": op4_page_text,
    "op5_secret_scan": op5_secret_scan,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_site_quality": op7_site_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_bpe": op10_bpe,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_nearest_vectors": op12_nearest_vectors,
    "op13_collocations": op13_collocations,
}


def _registered(build: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    return query


QUERIES: dict[str, Query] = {name: _registered(build) for name, build in _BUILDERS.items()}
