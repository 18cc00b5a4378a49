"""The dealt queries: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import code_compression, decontaminate, jaccard, packing, quality, recompression, secrets, sharding, sql, suffix_dedup, token_counts, toxicity, vector_search, whitening
from .catalog import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op1_secret_scans")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


@query("op2_sharding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"), shards=40)


@query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_substring_dedup", sql.SUBSTRING_DEDUP)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return recompression.deduplicate(table(spark, folder, "documents")).drop("kept_text")


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicate_bytes(table(spark, folder, "documents")).drop("kept_bytes")


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.drop("ids")


@query("op8_ngram_jaccard_join", sql.NGRAM_JACCARD_JOIN)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"), width=3, percent=90)


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whiten(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", rows["deviation"].cast("bigint"))


@query("op12_vector_code_compression", sql.VECTOR_CODES)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return code_compression.compress(table(spark, folder, "embeddings"))


@query("op13_exact_top_k", sql.TOP_PRODUCTS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.top_products(table(spark, folder, "embeddings"))
