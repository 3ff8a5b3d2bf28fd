"""One query for each operator: ``opN_<name>(spark, sf_dir)`` over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import text_of
from cohortlab.llm.exact_dedup import exact_dedup
from cohortlab.llm.html_extract import main_texts
from cohortlab.llm.licenses import license_digest, license_scan
from cohortlab.llm.line_dedup import line_dedup
from cohortlab.llm.mixing import mixed
from cohortlab.llm.packing import pack
from cohortlab.llm.quality_model import quality_scores
from cohortlab.llm.quality_rules import judged
from cohortlab.llm.resample import importance_resample
from cohortlab.llm.search import ranked_search
from cohortlab.llm.sharding import shard_documents
from cohortlab.llm.simhash import near_duplicates
from cohortlab.llm.token_counts import token_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_read(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, distance=4)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), crc=True)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of("text")
    carry = {"size": F.octet_length(text).cast("bigint") + 16, "text_crc32": F.crc32(text.cast("binary"))}
    out = shard_documents(_read(spark, sf_dir, "documents"), shards=40, carry=carry)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.size("removed_lines").cast("bigint").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed_lines"),
        F.length("text").cast("bigint").alias("chars_left"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(_read(spark, sf_dir, "documents"))
    first = F.get("copies", F.lit(0))["position"]
    return out.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "left_words", "base_failed", "kept")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(license_scan(_read(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_simhash, op3_packing, op4_sharding, op5_line_dedup, op6_exact_dedup, op7_mixing, op8_quality_model,
        op9_token_counts, op10_quality_rules, op11_license_scan, op12_importance_resampling, op13_ranked_search,
    )
}
