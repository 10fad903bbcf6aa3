"""Column expressions on words and texts. Patterns work alike in Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
WORD_OR_SIGN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]"
CHUNK = r"[^ \t\n\r\f]+"
NUMBER = r"^-*[0-9][0-9,\.]+$"
EMAIL = r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+$"
URL = r"^[A-Za-z]+://[^ ]+$"
WHITE = " \t\n\r\f "
PERIODS = r"^[.?!]+$"


def upper_first(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def lower_first(word: Column) -> Column:
    return word.rlike(r"^\p{Ll}")


def ending_word(word: Column) -> Column:
    """Only signs that end sentences, or the paragraph sign."""
    return F.substring(word, 1, 1).isin(".", "?", "!", "¶") & (word.rlike(PERIODS) | (word == "¶"))  # few words come to the pattern


def normalized(word: Column, longest: int | None = None) -> Column:
    """Numbers become a class of their magnitude, addresses and links one token each, other
    words lower case; words longer than ``longest`` null."""
    digits = F.length(F.regexp_replace(F.split(F.regexp_replace(word, "^-+", ""), r"\.")[0], ",", ""))
    number = F.when(digits <= 2, "00").when(digits == 3, "00h").when(digits == 4, "00k").when(digits <= 6, "0kk").when(digits <= 9, "00m").otherwise("00+")
    out = F.when(word.rlike(NUMBER), number).when(word.rlike(EMAIL), "@__").when(word.rlike(URL), "@@@").otherwise(F.lower(word))
    return out if longest is None else F.when(F.length(word) <= longest, out)


def word_shape(word: Column) -> Column:
    """u, l and d for runs of upper-case letters, others and digits; a dash for runs of the rest."""
    x = F.regexp_replace(word, r"[^\p{L}\p{N}]+", "-")
    x = F.regexp_replace(x, r"\p{N}+", "\u0001")
    x = F.regexp_replace(x, r"\p{Lu}+", "\u0002")
    x = F.regexp_replace(x, r"\p{L}+", "\u0003")
    return F.translate(x, "\u0001\u0002\u0003", "dul")


def tagged(word: Column, pos: Column) -> Column:
    return F.concat_ws("/", word, pos)


def base_pos(pos: Column) -> Column:
    return F.substring(pos, 1, 2)


def split_tagged(token: Column) -> Column:
    """word and pos around the last slash."""
    return F.struct(F.regexp_extract(token, r"^(.*)/([^/]*)$", 1).alias("word"), F.regexp_extract(token, r"^(.*)/([^/]*)$", 2).alias("pos"))


def normal_random(seed: int) -> Column:
    return F.randn(seed)


def timestamp_label() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMddHHmmss")


def close_to(x: Column, y: Column, epsilon: float = 0.01) -> Column:
    return F.abs(x - y) < epsilon


def padded(text: Column, width: int, right: bool = False) -> Column:
    return F.rpad(text, width, " ") if right else F.lpad(text, width, " ")
