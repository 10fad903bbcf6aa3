"""Queries of the text-analytics operators and their SQL; the modules below hold them by topic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import annotation, corpus, learning, text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text.QUERIES | corpus.QUERIES | learning.QUERIES | annotation.QUERIES


def oracle_sql() -> dict[str, str]:
    return text.SQL | corpus.SQL | learning.SQL | annotation.SQL
