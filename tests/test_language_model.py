import math
import random
from collections import Counter

import pytest

from textlake.operators import language_model as lm


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)] + ["", None, "_s_ w1 _e_"]
    sents = [" ".join(rng.choices([*words, "new"], k=rng.randint(1, 9))) for _ in range(8)] + ["", None, "_s_ w1"]
    return docs, sents


def frames(spark, texts):
    return (spark.createDataFrame(list(enumerate(x)), "item_id int, text string") for x in texts)


def walked(docs, sent, order):
    """The backoff score of a text by counts of all n-grams."""
    pad = lambda t: ["_s_"] * (order - 1) + t.split() + ["_e_"]
    grams, before = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for t in map(pad, (d for d in docs if d is not None)):
        for i in range(order - 1, len(t)):
            for n in range(1, order + 1):
                grams[n][tuple(t[i - n + 1 : i + 1])] += 1
                before[n][tuple(t[i - n + 1 : i])] += 1
    total, out = sum(grams[1].values()), 0
    t = pad(sent)
    for i in range(order - 1, len(t)):
        n = next((n for n in range(order, 0, -1) if grams[n][tuple(t[i - n + 1 : i + 1])]), 0)
        out += math.log2(lm.ALPHA ** (order - n) * (grams[n][tuple(t[i - n + 1 : i + 1])] / before[n][tuple(t[i - n + 1 : i])] if n else 1 / total))
    return out


@pytest.mark.parametrize("asked", [500_000, 30])
def test_backoff_is_that_of_all_counts(spark, texts, monkeypatch, asked):
    monkeypatch.setattr(lm, "ASKED", asked)
    got = {r.item_id: r.backoff for r in lm.backoff_scores(*frames(spark, texts), "item_id", 3).collect()}
    assert got == {i: pytest.approx(walked(texts[0], s, 3), abs=1e-5) for i, s in enumerate(texts[1]) if s is not None}


def test_only_what_is_asked_is_counted(spark, texts):
    """The tables of counts have no n-gram of the documents that isn't asked."""
    docs, sents = frames(spark, texts)
    asked = lm._spots(sents, ["item_id"], 2, 3, 3).select("w1", "w2", "w3").distinct()
    found = lm.asked_counts(lm._spots(docs, [], 2, 3, 3), asked, [("w3",), ("w2", "w3"), ("w1", "w2", "w3")])
    assert 0 < found[2].count() <= asked.count() < lm._spots(docs, [], 2, 3, 3).distinct().count()
