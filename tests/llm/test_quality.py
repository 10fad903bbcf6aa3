import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.llm import quality as q

from .conftest import prose


def corpus():
    rng = random.Random(8)
    bad = ["glorp", "snarf", "vexle"]
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(20, 400)).split()
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), toxic, junk))
        if i < 600:
            labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic boolean, junk boolean")
    got = {r.doc_id: r for r in q.classify(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    held = [r for r in rows if r[0] >= 600]
    assert np.mean([(got[i].quality_score < 0.5) == junk for i, _, _, junk in held]) > 0.98
    assert np.mean([(got[i].toxic_score >= 0.5) == toxic for i, _, toxic, _ in held]) > 0.95
    assert np.mean([got[i].keep for i, _, toxic, junk in held if not toxic and not junk]) > 0.97
    assert all(0 <= got[i].top_passage < got[i].n_passages == max(1, -(-len(t.split()) // q.PASSAGE)) for i, t, _, _ in held)


def test_attention_learns_the_passage_that_decides():
    rng = np.random.default_rng(1)
    many = rng.integers(1, 6, 80)
    at = np.concatenate([[0], np.cumsum(many)])
    x = rng.normal(size=(at[-1], 5))
    y = np.array([float(x[a:b, 0].max() > 1) for a, b in zip(at[:-1], at[1:], strict=True)])
    head = q.fitted(x, at, y)
    p, a = head.score(x, at)
    assert ((p > 0.5) == y).mean() > 0.95
    assert np.add.reduceat(a, at[:-1]) == pytest.approx(np.ones(80))


def test_slopes_are_those_of_differences():
    rng = np.random.default_rng(2)
    at = np.array([0, 3, 4, 9])
    x, y = rng.normal(size=(9, 4)), np.array([1.0, 0.0, 1.0])
    w = {"encode": rng.normal(size=(4, 3)), "shift": rng.normal(size=3), "v": rng.normal(size=(3, 3)), "u": rng.normal(size=(3, 3)), "w": rng.normal(size=3), "o": rng.normal(size=3), "b": rng.normal(size=1)}
    head = q.Head(np.zeros(4), np.ones(4), w)

    def loss():
        p = head.forward(x, at[:-1])["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    slopes = head.slopes(x, at[:-1], y)
    for name, value in w.items():
        for i in np.ndindex(value.shape):
            was = value[i]
            value[i] = was + 1e-6
            up = loss()
            value[i] = was - 1e-6
            down = loss()
            value[i] = was
            assert slopes[name][i] == pytest.approx((up - down) / 2e-6, abs=1e-7)


def test_labels_of_other_values(spark):
    rows, labels = corpus()
    train = spark.createDataFrame([r[:2] for r in rows[:200]], "doc_id bigint, text string")
    plain = spark.createDataFrame(labels[:200], "doc_id bigint, quality int, toxic int")
    odd = plain.union(spark.createDataFrame([(1, -5, 9), (2, 3, None), (700, 18, 7)], plain.schema))
    want, got = ({r.doc_id: (r.quality_score, r.toxic_score) for r in q.classify(train, x).collect()} for x in (plain, odd))
    assert got == {i: pytest.approx(p) for i, p in want.items()}


def test_odd_rows(spark, odd_docs, no_docs):
    rows, labels = corpus()
    gold = spark.createDataFrame([*labels[:200], (None, 1, 0), (3, None, None), (0, 1, None)], "doc_id bigint, quality int, toxic int")
    train = spark.createDataFrame([r[:2] for r in rows[:200]], "doc_id bigint, text string")
    every = odd_docs.select("doc_id", "text").union(train)
    got = q.classify(every, gold).collect()
    assert len(got) == every.count()
    null = [r for r in got if r.doc_id == 2 and r.quality_score is None]
    assert len(null) == 1 and not null[0].keep
    none = q.classify(odd_docs, gold.where(F.lit(False))).collect()
    assert all(r.quality_score is None and r.toxic_score is None for r in none) and sum(r.keep for r in none) == len(none) - 1
    assert q.classify(no_docs, gold).count() == 0
    kept = q.rejected_dropped(odd_docs, gold.where(F.lit(False)))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1
    assert q.rejected_dropped(no_docs, gold).count() == 0
