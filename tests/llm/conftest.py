import random

import pytest


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    long = prose(rng, 60_000)
    rows = [(1, "", "s", "x", 1), (2, None, "s", "x", 2), (None, prose(rng, 80), "s", "x", 3), (3, prose(rng, 80), None, None, None), (3, "again under one id", "s", "x", 4), (4, "twice " * 70, "t", "y", 5), (4, "twice " * 70, "t", "y", 5), (5, long, "t", "y", 6), (6, long, "t", "y", 7), (7, "!!! ... ---", "u", "z", 8), (8, "ein Wörtchen ñandú 漢字 😀 \t\n x", "u", "z", 9)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, jaccard string, n_tokens int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
