"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, license_scan, mixing, ngram_join, quality, secret_scan, sharding, span_dedup, ts_media
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).selectExpr("doc_id", "cast(size(leaks) as bigint) as n_leaks", "leaks.item_id as item_ids", "leaks")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "expected_grade", "tail", "keep")


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed", "removed")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts_media.media_features(ts_media.store_media(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_secret_scan, op3_ngram_jaccard_join, op4_decontamination, op5_mixing, op6_license_scan, op7_quality, op8_span_dedup, op9_main_text, op10_transport_stream)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.assign_sql(), "op5_mixing": mixing.mix_query_sql(), "op6_license_scan": license_scan.license_sql()}
