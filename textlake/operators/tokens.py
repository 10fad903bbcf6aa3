"""Segmentation: paragraphs, lines, sentences, words, and the token table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import CHUNK, WHITE, WORD

ABBREVIATIONS = ("A.D.", "Ave.", "B.C.", "Dr.", "Mr.", "Mrs.", "Ms.", "Mt.", "Rd.", "St.", "e.g.", "i.e.")


def tokens(docs: DataFrame, pattern: str = WORD, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All matches of a pattern with their places, from 0; one narrow pass."""
    return docs.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "word"))


def chunks(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return tokens(docs, CHUNK, text, keep)


def paragraphs(docs: DataFrame, pattern: str = r"[\n\r]\s*[\n\r]", text: str = "text") -> DataFrame:
    """doc_id, parag_ix and parag: trimmed pieces between blank lines; those of a character go."""
    pieces = docs.select("doc_id", F.posexplode(F.split(text, pattern)).alias("parag_ix", "parag")).withColumn("parag", F.btrim("parag", F.lit(WHITE)))
    return pieces.where(F.length("parag") > 1)


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_ix, beg and line; ``beg`` is the running place of the first character."""
    pieces = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_ix", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_ix").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("beg", F.coalesce(F.sum(F.length("line") + 1).over(order), F.lit(0)).cast("bigint"))


def _ends(word: Column, after: Column, line: Column) -> Column:
    last, before = F.substring(word, -1, 1), F.when(F.length(word) > 1, F.substring(word, -2, 1))
    enders = [".", "?", "!", "…", "¶"]
    sign = F.when(last.isin(enders), ~word.isin(*ABBREVIATIONS)).when(last.isin(")", '"', "'", "»", "”"), F.coalesce(before.isin(enders), F.lit(False))).otherwise(False)
    initial = word.rlike(r"^\p{Lu}\.$")
    normal = ~after.rlike(r"^\p{Ll}") & ~initial
    return after.isNull() | (sign & (normal | ~line.rlike(r"\p{Lu}") | ~line.rlike(r"\p{Ll}")))


def sentence_words(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id (or what is kept), line_ix, sent_ix (within the line), pos and word; a line's end ends a sentence.

    The windows run over arrays of one line, inside the row, so nothing is shuffled.
    """
    rows = docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_ix", "line"))
    words = rows.select(*keep, "line_ix", "line", F.regexp_extract_all("line", F.lit(CHUNK), F.lit(0)).alias("w"))
    ends = F.transform("w", lambda x, i: F.when(_ends(x, F.try_element_at("w", i + 2), F.col("line")), i).otherwise(-1))
    words = words.withColumn("ends", F.filter(ends, lambda x: x >= 0))  # none of a line without words
    sent = F.transform("ends", lambda e, i: F.struct(i.cast("int").alias("sent_ix"), F.when(i == 0, 0).otherwise(F.element_at("ends", i) + 1).alias("first"), e.alias("last")))
    return words.select(*keep, "line_ix", "w", F.explode(sent).alias("s")).select(*keep, "line_ix", "s.sent_ix", F.col("s.first").alias("pos"), F.slice("w", F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + 1).alias("words"))


def sentences(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, line_ix, sent_ix, n_words and sent (words joined by a blank)."""
    return sentence_words(docs, text, keep).select(*keep, "line_ix", "sent_ix", F.size("words").alias("n_words"), F.array_join("words", " ").alias("sent"))


_AN = "0-9A-Za-z"
_SIGNS = "".join(map(re.escape, sorted("()[]{}⟨⟩<>|/#$%&*+=@^`~,:;…«»“”‘’\"'‒–—―№¶")))
RULES = (
    r"\w+://[$-_a-z]+",
    f"[{_AN}_.+-]+@[{_AN}-]+.[{_AN}.-]+",
    "[-+]?[0-9](?:[-.,0-9]*[0-9])?",
    r"\w(?:[-`’'\w]?\w+)*",
    r"\w.(?:\w.)+\w?",
    f"[{_SIGNS}]",
    "[!?.]+",
    "-+",
)
#: The rules of the Ukrainian profile also keep endings of ordinals with their number.
RULES_UK = (*RULES[:2], "[0-9]+-[а-яіїєґ']+", *RULES[2:])
_QUOTES = "'\"«»‘’“”"
_MARKS = set("`‘’'")
_WHO, _MARK = "(?:they|we|you|s?he|i)", "[`‘’']"
_TWO = re.compile(f"(?:i{_MARK}m|{_WHO}{_MARK}d|\\w{_MARK}s)$", re.I)
_THREE = re.compile(f"(?:{_WHO}{_MARK}(?:[rv]e|ll)|n{_MARK}t)$", re.I)
_QUOTED = re.compile(r"\w'+$")


@lru_cache(4)
def _compiled(rules: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(rules))


def merged_words(text: str, rules: tuple[str, ...] = RULES) -> list[tuple[str, int, int]]:
    """(word, beg, end): matches of the rules line by line, then one pass from left to right
    that joins abbreviations, decimals and times and splits contractions; what is joined
    depends on what has been joined before, which is why this isn't an expression."""
    raw, at = [], 0
    for line in text.split("\n"):
        raw += [(m.group(), at + m.start(), at + m.end()) for m in _compiled(rules).finditer(line)]
        at += len(line) + 1
    out: list[tuple[str, int, int]] = []
    marks = not _MARKS.isdisjoint(text)  # without one, no contraction or quoted word
    i = 0

    def split(word: str, beg: int, end: int, n: int) -> None:
        if len(word) > n:
            out.append((word[:-n], beg, end - n))
        out.append((word[-n:], end - n, end))

    while i < len(raw):
        word, beg, end = raw[i]
        after = raw[i + 1] if i + 1 < len(raw) else None
        if out:
            prev, first, last = out[-1]
            glue = beg == last and (
                (word == "." and after is not None and after[0][0] not in _QUOTES and after[0][0] != ")" and prev[-1].isalnum())
                or (prev[-1] == "." and word[0].isalnum())
                or (set(prev) == {"'"} and set(word) == {"'"})
            )
            if glue:
                out[-1] = (prev + word, first, end)
                i += 1
                continue
            if word == ":" and prev[-1].isdigit() and after is not None and after[0][0].isdigit():
                out[-1] = (text[first : after[2]], first, after[2])
                i += 2
                continue
        if not marks:
            out.append(raw[i])
        elif _TWO.search(word):
            split(word, beg, end, 2)
        elif _THREE.search(word):
            split(word, beg, end, 3)
        elif _QUOTED.search(word):
            split(word, beg, end, len(word) - len(word.rstrip("'")))
        else:
            out.append(raw[i])
        i += 1
    return out


def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else [{"word": w, "beg": b, "end": e} for w, b, e in merged_words(t)])


SPAN = StructType([StructField("word", StringType()), StructField("beg", IntegerType()), StructField("end", IntegerType())])


def word_spans(text: str | Column) -> Column:
    """The merged words of a text, Arrow batch by batch."""
    return F.pandas_udf(_spans, ArrayType(SPAN))(text)


#: Tokens that leave the kernel at a time.
BLOCK = 1 << 16


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tokens from rows that end with a sentence."""
    rows: list[int] = []
    places: list[int] = []
    found: list[tuple[str, int, int]] = []

    def taken(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = batch.select(range(batch.num_columns - 1)).take(pa.array(rows, pa.int64()))
        words = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
        out = pa.record_batch([*kept.columns, pa.array(places, pa.int32()), *words], [*kept.schema.names, "tok_ix", "word", "beg", "end"])
        for c in (rows, places, found):
            c.clear()
        return out

    for batch in batches:
        for r, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            own = merged_words(text)
            rows += [r] * len(own)
            places += range(len(own))
            found += own
            if len(rows) >= BLOCK:
                yield taken(batch)
        if rows:
            yield taken(batch)


def _sents(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, parag_ix, sent_ix and sent."""
    keep = ("doc_id", "parag_ix")
    parags = paragraphs(docs, r"\r?\n|\r", text)
    return sentences(parags.select(*keep, F.col("parag").alias("text")), keep=keep).select(*keep, "sent_ix", "sent")


def full_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """The token table: doc_id, parag_ix, sent_ix, tok_ix, word, beg and end (within the sentence)."""
    sents = _sents(docs, text)
    kinds = ", ".join(f"{c} {sents.schema[c].dataType.simpleString()}" for c in sents.columns[:-1])
    return sents.mapInArrow(_token_rows, f"{kinds}, tok_ix int, word string, beg int, end int")


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of rows that end with a sentence; none of a sentence without any."""
    for batch in batches:
        rows: list[int] = []
        found: list[list[str]] = []
        size = 0

        def taken(batch: pa.RecordBatch = batch, rows: list[int] = rows, found: list[list[str]] = found) -> pa.RecordBatch:
            kept = batch.select(range(batch.num_columns - 1)).take(pa.array(rows, pa.int64()))
            out = pa.record_batch([*kept.columns, pa.array(found, pa.list_(pa.string()))], [*kept.schema.names, "words"])
            rows.clear()
            found.clear()
            return out

        for r, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            own = [w for w, _, _ in merged_words(text)]
            if own:
                rows.append(r)
                found.append(own)
                size += len(own)
            if size >= BLOCK:
                yield taken()
                size = 0
        if rows:
            yield taken()


def sentence_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, parag_ix, sent_ix and the words of ``full_tokens``, a row for each sentence that has any."""
    sents = _sents(docs, text)
    kinds = ", ".join(f"{c} {sents.schema[c].dataType.simpleString()}" for c in sents.columns[:-1])
    return sents.mapInArrow(_word_lists, f"{kinds}, words array<string>")


def joined_sentences(sents: DataFrame) -> DataFrame:
    """``joined_text`` of the token table from ``sentence_tokens``: sentences go to their document's
    partition once, where paragraphs and texts are made."""
    parts = int(sents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.transform("words", lambda w, i: F.struct("sent_ix", i.alias("tok_ix"), w.alias("word")))
    every = F.sort_array(F.flatten(F.collect_list(own)))
    parags = sents.repartition(parts, "doc_id").groupBy("doc_id", "parag_ix").agg(F.array_join(F.transform(every, lambda x: x["word"]), " ").alias("parag"))
    return parags.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("parag_ix", "parag"))), lambda x: x["parag"]), "\n").alias("text"))


def joined_text(table: DataFrame) -> DataFrame:
    """doc_id and text of a token table: words by blanks, paragraphs by newlines."""
    parags = table.groupBy("doc_id", "parag_ix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_ix", "tok_ix", "word"))), lambda x: x["word"]), " ").alias("parag"))
    return parags.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("parag_ix", "parag"))), lambda x: x["parag"]), "\n").alias("text"))
