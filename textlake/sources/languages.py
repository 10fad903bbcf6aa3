"""Language profiles: codes, names, word rules and stopwords."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.tokens import ABBREVIATIONS, RULES, RULES_UK

#: ISO 639-1 codes of common languages; alternative names are rows of their own.
ISO = [("ar", "Arabic"), ("bg", "Bulgarian"), ("cs", "Czech"), ("da", "Danish"), ("de", "German"), ("el", "Greek"), ("en", "English"), ("es", "Spanish"), ("es", "Castilian"), ("fi", "Finnish"), ("fr", "French"), ("he", "Hebrew"), ("hi", "Hindi"), ("hu", "Hungarian"), ("it", "Italian"), ("ja", "Japanese"), ("ko", "Korean"), ("nl", "Dutch"), ("nl", "Flemish"), ("pl", "Polish"), ("pt", "Portuguese"), ("ro", "Romanian"), ("ru", "Russian"), ("sv", "Swedish"), ("tr", "Turkish"), ("uk", "Ukrainian"), ("zh", "Chinese")]


def iso_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ISO, "iso string, name string")


@dataclass(frozen=True)
class Profile:
    """What differs between languages; passed to a call, not switched globally."""

    iso: str
    rules: tuple[str, ...] = RULES
    abbreviations: tuple[str, ...] = ABBREVIATIONS
    stopwords: tuple[str, ...] = ()


PROFILES = {"en": Profile("en", stopwords=("a", "an", "and", "in", "is", "of", "the", "to")), "uk": Profile("uk", RULES_UK), "de": Profile("de", stopwords=("der", "die", "und")), "fr": Profile("fr", stopwords=("de", "la", "le", "les"))}


def profile(iso: str) -> Profile:
    return PROFILES.get(iso, PROFILES["en"])


def iso_of(name: str) -> str | None:
    return next((iso for iso, n in ISO if n.lower() == name.lower()), None)
