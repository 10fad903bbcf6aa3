"""The operations of a text service in batch form: a row of JSON for each row of raw text.

Texts longer than ``LIMIT`` characters are refused: their row has an error instead of a result, as a
null text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD
from . import lexics

LIMIT = 1_000_000


def _answer(text: Column, result: Column) -> Column:
    refused = F.when(text.isNull(), "no text").when(F.length(text) > LIMIT, "too long")
    return F.to_json(F.struct(F.when(refused.isNull(), result).alias("result"), refused.alias("error")))


def tokenize(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and json {result: [words of each paragraph], error}."""
    text = F.col("text")
    parags = F.filter(F.split(text, r"[\n\r]\s*[\n\r]"), lambda p: F.trim(p) != "")
    return docs.select(key, _answer(text, F.transform(parags, lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0)))).alias("json"))


def lemmatize(docs: DataFrame, forms: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and json {result: [{word, lemma}], error}, distinct words by name; lemmas by a dictionary."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    rows = docs.where(F.length("text") <= LIMIT).select(key, F.explode(words).alias("word"))
    known = lexics.lemmatized(rows.select("word").distinct(), forms).select("word", "lemma")
    found = rows.join(known, "word").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("word", "lemma"))).alias("found"))
    empty = F.array().cast("array<struct<word:string,lemma:string>>")
    return docs.select(key, "text").join(found, key, "left").select(key, _answer(F.col("text"), F.coalesce("found", empty)).alias("json"))


def syntax_format(text: Column) -> Column:
    """The format of a drawing request: brackets begin a tree, a letter a dependency list, a
    digit a table of dependencies; null for others."""
    first = F.substring(F.ltrim(text), 1, 1)
    return F.when(first == "(", "tree").when(first.rlike(r"^\p{N}"), "table").when(first.rlike(r"^\p{L}"), "dependencies")
