"""The queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blockdedup, fertility, hilbert, lshforest, mixing, packing, pii, suffixdedup, tiff, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(_documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_suffix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.dedup(_documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(_documents(spark, sf_dir))


def op5_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockdedup.dedup(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(_documents(spark, sf_dir))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lshforest.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.shard_documents(_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op10_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_candidate_boosting, op2_ftrl_toxicity, op3_suffix_sort_dedup, op4_tiff_media, op5_fixed_block_anchors, op6_tokeniser_fertility, op7_lsh_forest, op8_vector_packing, op9_hilbert_shards, op10_hash_threshold_mix)}
