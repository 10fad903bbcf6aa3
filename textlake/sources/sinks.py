"""Writers: dictionaries, tables, dependencies and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learning import Weights, weight_table, weights_of


def write_dictionary(rows: DataFrame, path: str, separator: str = "\t") -> None:
    rows.select(F.concat_ws(separator, *rows.columns)).write.mode("overwrite").text(path)


def write_tsv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_lines(rows: DataFrame, path: str, line: str = "line") -> None:
    rows.select(line).write.mode("overwrite").text(path)


def save_weights(spark: SparkSession, weights: Weights, path: str) -> None:
    """Weights as Parquet, zeros included."""
    weight_table(spark, weights).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> Weights:
    return weights_of(spark.read.parquet(path))
