"""Conditional frequency tables and text statistics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


from .tokens import tokens


def cfd(docs: DataFrame, condition: str, words: tuple[str, ...] = (), lower: bool = True) -> DataFrame:
    """cond, word and freq; only ``words`` if there are some (filtered before the count)."""
    word = F.lower("word") if lower else F.col("word")
    rows = tokens(docs, keep=(condition,)).select(F.col(condition).alias("cond"), word.alias("word"))
    if words:
        rows = rows.where(F.col("word").isin(*words))
    return rows.groupBy("cond", "word").agg(F.count("*").alias("freq"))


def tabulated(table: DataFrame, columns: list[str], cumulative: bool = False, prefix: str = "c_") -> DataFrame:
    """A row for each condition and a column for each sample, gaps 0; running sums if cumulative."""
    sums = [F.coalesce(F.sum(F.when(F.col("word") == c, F.col("freq"))), F.lit(0)).alias(prefix + c) for c in columns]
    wide = table.groupBy("cond").agg(*sums)
    if not cumulative:
        return wide
    running = [sum((F.col(prefix + c) for c in columns[1 : i + 1]), F.col(prefix + columns[0])).alias(prefix + columns[i]) for i in range(len(columns))]
    return wide.select("cond", *running)


def rendered(table: dict[str, dict], columns: list | None = None, cumulative: bool = False, keys: list | None = None) -> str:
    """The table as text, right-aligned, in the order of its conditions and samples; for display."""
    samples = columns or list(dict.fromkeys(s for row in table.values() for s in row))
    if cumulative:
        table = {k: dict(zip(samples, [sum(row.get(s, 0) for s in samples[: i + 1]) for i in range(len(samples))], strict=True)) for k, row in table.items()}
    width = {s: max(len(str(s)), len(str(max(row.get(s, 0) for row in table.values())))) for s in samples}
    first = max(len(str(k)) for k in (keys or table))
    out = [" " + " " * first + "".join(f"  {s!s:>{width[s]}}" for s in samples)]
    out += [f"  {k!s:>{first}}" + "".join(f"  {row.get(s, 0)!s:>{width[s]}}" for s in samples) for k, row in table.items() if keys is None or k in keys]
    return "\n".join(out) + "\n"


def lexical_diversity(docs: DataFrame, group: str) -> DataFrame:
    """tokens, types and tokens / types of each group; types are counted from (group, word)
    counts, so that no group is gathered in one place."""
    counts = tokens(docs, keep=(group,)).groupBy(group, F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    out = counts.groupBy(group).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"))
    return out.withColumn("diversity", F.round(F.col("n_tokens") / F.col("n_types"), 6))


def dispersion(docs: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """word, doc_id and pos of chosen words."""
    return tokens(docs).withColumn("word", F.lower("word")).where(F.col("word").isin(*words)).select("word", "doc_id", "pos")


def length_distribution(docs: DataFrame) -> DataFrame:
    return tokens(docs, keep=()).groupBy(F.length("word").alias("len")).agg(F.count("*").alias("freq"))


def long_words(docs: DataFrame, longer: int = 7, oftener: int = 7) -> DataFrame:
    return tokens(docs, keep=()).groupBy("word").agg(F.count("*").alias("freq")).where((F.length("word") > longer) & (F.col("freq") > oftener))


_HITS = ArrayType(StructType([StructField("beg", IntegerType()), *(StructField(n, StringType()) for n in ("left", "match", "right"))]))


def concordance(docs: DataFrame, word: str, width: int = 25) -> DataFrame:
    """doc_id, beg, left, match and right: each whole-word match, any case, with its surroundings.
    Only texts that contain the word reach the kernel."""
    pattern = re.compile(rf"(?<!\w){re.escape(word)}(?!\w)", re.IGNORECASE)

    def hits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"beg": m.start(), "left": t[max(0, m.start() - width) : m.start()], "match": m.group(), "right": t[m.end() : m.end() + width]} for m in pattern.finditer(t)])

    some = docs.where(F.contains(F.lower("text"), F.lit(word.lower())))
    return some.select("doc_id", F.explode(F.pandas_udf(hits, _HITS)("text")).alias("h")).select("doc_id", "h.*")


def dominant(docs: DataFrame, condition: str, least: int = 20, share: float = 0.97) -> DataFrame:
    """word, cond and freq of the words more frequent than ``least`` of which one condition has
    more than ``share``; ties by condition."""
    counts = tokens(docs, keep=(condition,)).groupBy(F.lower("word").alias("word"), F.col(condition).alias("cond")).agg(F.count("*").alias("n"))
    best = counts.groupBy("word").agg(F.sum("n").alias("freq"), F.max(F.struct("n", "cond")).alias("b"))
    return best.where((F.col("freq") > least) & (F.col("b.n") > share * F.col("freq"))).select("word", F.col("b.cond").alias("cond"), "freq")


def ambiguity(docs: DataFrame, condition: str) -> DataFrame:
    """For each number of conditions that a word has: words and occurrences."""
    counts = tokens(docs, keep=(condition,)).groupBy(F.lower("word").alias("word"), F.col(condition).alias("cond")).agg(F.count("*").alias("n"))
    words = counts.groupBy("word").agg(F.count("*").alias("n_conds"), F.sum("n").alias("freq"))
    return words.groupBy("n_conds").agg(F.count("*").alias("n_words"), F.sum("freq").alias("volume"))


def running_counts(table: DataFrame, by: str, order: str, value: str) -> DataFrame:
    return table.withColumn("running", F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def sign_counts(docs: DataFrame) -> DataFrame:
    """Character classes over all texts."""
    n = lambda p: F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0)).cast("bigint")
    return docs.agg(n(r"[.?!…]").alias("n_period"), n(r"[,;:()\-]").alias("n_punct"), n("[\"'‘’«»“”]").alias("n_quote"), n(r"[ \t\n\r ]").alias("n_white"), n(r"\n").alias("n_newline"), n(r"\p{Lu}").alias("n_upper"), n(r"\p{N}").alias("n_digit"))


