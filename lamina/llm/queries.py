"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, fixed_blocks, language_id, language_model, licences, media, near_join, packing, quality, suffix_dedup, url_filter
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs, language_id.learned_rows()))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.join_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op8_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_held_out(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fixed_blocks.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_bpe, op2_language, op3_licences, op4_quality, op5_media, op6_repeats, op7_near, op8_trie, op9_urls, op10_packing,
        op11_centroids, op12_blocks,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licences": licences.oracle_sql(), "op4_quality": quality.oracle_sql(), "op7_near": near_join.oracle_sql(), "op9_urls": url_filter.oracle_sql(),
        "op11_centroids": centroids.oracle_sql(), "op12_blocks": fixed_blocks.oracle_sql(),
    }
