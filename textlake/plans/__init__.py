"""Session settings and plan inspection."""

from __future__ import annotations

import itertools
import os

from pyspark.sql import DataFrame, SparkSession

_names = itertools.count()


def unique_name(stem: str) -> str:
    """A view name that this process hasn't used."""
    return f"textlake_{stem}_{os.getpid()}_{next(_names)}"


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive plans, Arrow transfer and UTC; a cluster sets its own master."""
    build = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", partitions).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        build = build.config(key, value)
    return build.getOrCreate()


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df: DataFrame) -> int:
    """Shuffles of a plan."""
    return physical_plan(df).count("Exchange hashpartitioning") + physical_plan(df).count("Exchange rangepartitioning")
