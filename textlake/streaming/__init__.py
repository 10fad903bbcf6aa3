"""Token counts over unbounded input: an extension, as the operators elsewhere are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD


def windowed_counts(stream: DataFrame, time: str = "ts", text: str = "text", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, word and freq of tumbling windows; input later than ``late`` is dropped."""
    words = stream.withWatermark(time, late).select(time, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy(F.window(time, window).alias("w"), "word").agg(F.count("*").alias("freq")).select(F.col("w.start").alias("start"), "word", "freq")
