"""One registered query for each corpus operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm import filter_audit, language_model, licenses, lines, mixing, neighbors, packing, pii, quality, resampling, shards, simhash, suffix_dedup
from tradelens.llm.common import read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality_rules(read_table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return q.select("doc_id", *[f"quality.{n}" for n in names])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.nearest_neighbors(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).drop("detections")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.line_dedup(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_cut_lines", F.sha2("text", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.interleaved_shards(read_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "epoch", "order_key", "mix_tokens")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("filter")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resampling.importance_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return resampling.draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_suffix_dedup, op2_pii, op3_quality, op4_packing, op5_simhash,
        op6_neighbors, op7_licenses, op8_line_dedup, op9_sharding, op10_mixing,
        op11_filter_audit, op12_resampling, op13_lm_scores,
    ]
    return {f.__name__: f for f in found}
