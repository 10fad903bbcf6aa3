"""Evaluation metrics and split criteria as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame) -> DataFrame:
    """n and accuracy (percent) of gold and guess."""
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("gold") == F.col("guess"), 100.0).otherwise(0.0)), 6).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gold", "guess").agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, beta: float = 1.0) -> DataFrame:
    """class, f, prec, rec and n of each class, zeros without true positives; then avg (every
    class counts alike) and wavg (weighted by n). One shuffle of the confusion counts."""
    cells = confusion(rows)
    hit = F.when(F.col("gold") == F.col("guess"), F.col("n")).otherwise(0)
    gold = cells.groupBy(F.col("gold").alias("class")).agg(F.sum("n").alias("n"), F.sum(hit).alias("tp"))
    guess = cells.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("said"))
    one = gold.join(guess, "class", "left").withColumn("prec", F.when(F.col("tp") > 0, F.col("tp") / F.col("said")).otherwise(0.0)).withColumn("rec", F.when(F.col("tp") > 0, F.col("tp") / F.col("n")).otherwise(0.0))
    b = beta * beta
    one = one.withColumn("f", F.when(F.col("tp") > 0, (1 + b) * F.col("prec") * F.col("rec") / (b * F.col("prec") + F.col("rec"))).otherwise(0.0)).select(F.col("class").cast("string").alias("class"), "f", "prec", "rec", "n")
    means = one.agg(*(F.avg(c).alias(c) for c in ("f", "prec", "rec")), F.count("*").alias("n")).select(F.lit("avg").alias("class"), "f", "prec", "rec", "n")
    weighted = one.agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("f", "prec", "rec")), F.sum("n").alias("n")).select(F.lit("wavg").alias("class"), "f", "prec", "rec", "n")
    return one.union(means).union(weighted).select("class", *(F.round(c, 6).alias(c) for c in ("f", "prec", "rec")), "n")


def _plogp(n: str, total: str):
    return F.when(F.col(n) > 0, -F.col(n) / F.col(total) * F.log2(F.col(n) / F.col(total))).otherwise(0.0)


def split_criteria(rows: DataFrame, features: list[str], gold: str = "gold") -> DataFrame:
    """feature, entropy (of gold within the feature's values, weighted), info_gain, split_info and
    gini_split of boolean gold. All features are counted in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features)))
    counts = rows.select(pairs.alias("p"), F.col(gold).cast("int").alias("g")).groupBy("p.feature", "p.value").agg(F.count("*").alias("n"), F.coalesce(F.sum("g"), F.lit(0)).alias("pos")).withColumn("neg", F.col("n") - F.col("pos"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos")).withColumn("all_neg", F.col("all_n") - F.col("all_pos"))
    x = counts.join(totals, "feature")
    inside = F.col("n") / F.col("all_n") * (_plogp("pos", "n") + _plogp("neg", "n"))
    gini = F.col("n") / F.col("all_n") * (1 - F.pow(F.col("pos") / F.col("n"), 2) - F.pow(F.col("neg") / F.col("n"), 2))
    out = x.groupBy("feature").agg(F.sum(inside).alias("entropy"), F.first(_plogp("all_pos", "all_n") + _plogp("all_neg", "all_n")).alias("whole"), F.sum(_plogp("n", "all_n")).alias("split_info"), F.sum(gini).alias("gini_split"))
    return out.select("feature", F.round("entropy", 6).alias("entropy"), F.round(F.col("whole") - F.col("entropy"), 6).alias("info_gain"), F.round("split_info", 6).alias("split_info"), F.round("gini_split", 6).alias("gini_split"))


def frobenius(vectors: DataFrame, column: str) -> DataFrame:
    """The square root of the sum of all squares."""
    one = F.aggregate(F.transform(column, lambda v: v.cast("double")), F.lit(0.0), lambda acc, v: acc + v * v)
    return vectors.agg(F.round(F.sqrt(F.sum(one)), 6).alias("norm"))
