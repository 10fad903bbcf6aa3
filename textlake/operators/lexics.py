"""Stemming, dictionary lemmas and word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that ask for their neighbours at a time.
ASKED = 256

_VOWELS = frozenset("aeiou")
_STEP2 = {"alism": "al", "aliti": "al", "alli": "al", "anci": "ance", "ation": "ate", "ational": "ate", "ator": "ate", "biliti": "ble", "bli": "ble", "eli": "e", "enci": "ence", "entli": "ent", "fulness": "ful", "iveness": "ive", "iviti": "ive", "ization": "ize", "izer": "ize", "logi": "log", "ousli": "ous", "ousness": "ous", "tional": "tion"}
_STEP3 = {"alize": "al", "ative": "", "ful": "", "ical": "ic", "icate": "ic", "iciti": "ic", "ness": ""}
_STEP4 = ("able", "al", "ance", "ant", "ate", "ence", "ent", "er", "ible", "ic", "ism", "iti", "ive", "ize", "ment", "ou", "ous")


def _consonant(word: str, i: int) -> bool:
    if word[i] in _VOWELS:
        return False
    return word[i] != "y" or i == 0 or not _consonant(word, i - 1)


def _measure(stem: str) -> int:
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and _consonant(word, n - 1) and not _consonant(word, n - 2) and _consonant(word, n - 3) and word[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


def stem(word: str, strict: bool = False) -> str:
    """The Porter stem of a word of more than two letters. Not ``strict``: step 1b also adds an
    e after "is" and also follows a shortened "eed", and step 4 lacks "ement"."""
    if len(word) <= 2:
        return word
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    cut = False
    if word.endswith("eed"):
        if _measure(word[:-3 if strict else -2]) > 0:
            word, cut = word[:-1], not strict
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        word, cut = word[:-2], True
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        word, cut = word[:-3], True
    if cut:
        if word.endswith(("at", "bl", "iz") if strict else ("at", "bl", "iz", "is")) or (_measure(word) == 1 and _cvc(word)):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    if word.endswith("ion") and len(word) > 3 and word[-4] in "st":
        if _measure(word[:-3]) > 1:
            word = word[:-3]
    else:
        for suffix in sorted((*_STEP4, "ement") if strict else _STEP4, key=len, reverse=True):
            if word.endswith(suffix):
                if _measure(word[: len(word) - len(suffix)]) > 1:
                    word = word[: len(word) - len(suffix)]
                break
    if word.endswith("e"):
        m = _measure(word)
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """word and stem of each distinct word: a kernel over the vocabulary, to be joined back."""
    return words.select(F.lower(word).alias("word")).distinct().withColumn("stem", F.pandas_udf(_stems, "string")("word"))


#: A small dictionary of invented coverage: form, its tag, lemma, the lemma's tag, precedence.
FORMS = [("heed", "VB", "heed", "VB", 1), ("heeding", "VBG", "heed", "VB", 2), ("heeded", "VBD", "heed", "VB", 2), ("heeded", "VBN", "heed", "VB", 3), ("things", "NNS", "thing", "NN", 1), ("thing", "NN", "thing", "NN", 1), ("was", "VBD", "be", "VB", 1), ("is", "VBZ", "be", "VB", 1), ("are", "VBP", "be", "VB", 1), ("been", "VBN", "be", "VB", 2), ("be", "VB", "be", "VB", 1), ("leaves", "NNS", "leaf", "NN", 1), ("leaves", "VBZ", "leave", "VB", 2), ("ties", "NNS", "tie", "NN", 1), ("ties", "VBZ", "tie", "VB", 2)]


def dictionary(spark) -> DataFrame:
    return spark.createDataFrame(FORMS, "form string, tag string, lemma string, lemma_tag string, rank int")


def lemmatized(words: DataFrame, forms: DataFrame, tag: Column | None = None) -> DataFrame:
    """word, lemma, lemma_tag and n_readings. Unknown words are their own lemma without a tag;
    a word that is a base form stays; among readings that of least rank wins, then the shortest
    tag and lemma. With ``tag`` (a column) only readings of that tag count, and a known word
    without one has a null lemma."""
    readings = forms if tag is None else forms.where(F.col("tag") == tag)
    best = readings.groupBy(F.col("form").alias("word")).agg(F.min(F.struct((F.col("form") != F.col("lemma")).alias("derived"), "rank", F.length("lemma_tag").alias("a"), F.length("lemma").alias("b"), "lemma", "lemma_tag")).alias("r"), F.count("*").alias("n"))
    known = forms.select(F.col("form").alias("word")).distinct().withColumn("known", F.lit(True))
    out = words.join(F.broadcast(known), "word", "left").join(F.broadcast(best), "word", "left")
    lemma = F.when(F.col("known").isNull(), F.col("word")).otherwise(F.col("r.lemma"))
    return out.select(*words.columns, lemma.alias("lemma"), F.col("r.lemma_tag").alias("lemma_tag"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_readings"))


def inflected(lemmas: DataFrame, forms: DataFrame) -> DataFrame:
    """The forms of (lemma, tag) rows."""
    return lemmas.join(F.broadcast(forms.select("lemma", "tag", "form")), ["lemma", "tag"], "left")


def precedence(tag: Column, order: list[str]) -> Column:
    """The tag's place in a list, from 0; beyond all places if it isn't there."""
    at = F.array_position(F.array(*map(F.lit, order)), tag)
    return F.when(at > 0, at - 1).otherwise(F.lit(2**31 - 1).cast("bigint"))


def looked_up(words: DataFrame, vectors: DataFrame, key: str, size: int) -> DataFrame:
    """``words`` with their vectors; unknown words have zeros."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return words.join(vectors, key, "left").withColumn("vec", F.coalesce("vec", zero))


def cosine(x: Column, y: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def neighbours(vectors: DataFrame, asked: DataFrame, key: str, n: int = 10) -> DataFrame:
    """For each asked row the n other rows of greatest cosine, rounded, ties by key. The asked rows
    go out in blocks of ``ASKED``; every task keeps the best n of its own rows, so what
    is shuffled grows with the asked rows and the tasks. Rows without a vector are left out."""
    from pyspark.sql import Window

    spark = asked.sparkSession
    wanted = asked.where("vec is not null").select(F.col(key).cast("bigint").alias("asked"), "vec")
    few = [x["asked"] for x in wanted.select("asked").orderBy("asked").toLocalIterator()]
    rows = vectors.where("vec is not null").select(F.col(key).cast("bigint").alias("key"), "vec")
    found = spark.createDataFrame([], "asked bigint, other bigint, cosine double")
    for i in range(0, len(few), ASKED):
        block = wanted.where(F.col("asked").between(few[i], few[min(i + ASKED, len(few)) - 1])).orderBy("asked").toArrow()
        ids, x = block["asked"].to_numpy(), _unit(block["vec"].combine_chunks())
        shared = spark.sparkContext.broadcast((ids, x))
        found = found.union(rows.mapInArrow(_best(shared, n), "asked bigint, other bigint, cosine double"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _best(shared, n: int):
    """Of each asked row the n best of a task's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, y = batch.column(0).to_numpy(), _unit(batch.column(1))
            for i in range(0, len(keys), 4096):
                own, c = keys[i : i + 4096], np.round(x @ y[i : i + 4096].T, 6)
                a, o = np.nonzero(ids[:, None] != own[None, :])
                every = [np.concatenate(z) for z in zip(best, (ids[a], own[o], c[a, o]), strict=True)]
                order = np.lexsort((every[1], -every[2], every[0]))
                every = [z[order] for z in every]
                first = np.flatnonzero(np.append(True, every[0][1:] != every[0][:-1]))
                place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                best = [z[place < n] for z in every]
        yield pa.record_batch([pa.array(z) for z in best], ["asked", "other", "cosine"])

    return work
