"""The queries of the ten operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import documents_as_media, media_columns

    rows = media_columns(documents_as_media(_table(spark, sf_dir, "documents")))
    return rows.withColumnRenamed("media_id", "doc_id")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import sampled

    return sampled(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "n_copies")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import scores

    return scores(_table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    return encode(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media_columns, op2_jaccard_join, op3_mix_sources, op4_token_counts, op5_lm_scores, op6_repeated_passages, op7_near_vectors, op8_byte_bpe, op9_quality, op10_shards)}


def oracle_sql() -> dict[str, str]:
    from . import mixing

    return {"op3_mix_sources": mixing.ORACLE_SQL}
