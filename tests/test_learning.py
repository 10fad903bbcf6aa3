import math

import numpy as np
import pytest

from textlake.operators import learning as L
from textlake.operators import metrics, tagging

#: outlook, temperature, humidity, wind and whether to play.
GOLF = [("sunny", 85.0, 85.0, False, False), ("sunny", 80.0, 90.0, True, False), ("overcast", 83.0, 78.0, False, True), ("rain", 70.0, 96.0, False, True), ("rain", 68.0, 80.0, False, True), ("rain", 65.0, 70.0, True, False), ("overcast", 64.0, 65.0, True, True), ("sunny", 72.0, 95.0, False, False), ("sunny", 69.0, 70.0, False, True), ("rain", 75.0, 80.0, False, True), ("sunny", 75.0, 70.0, True, True), ("overcast", 72.0, 90.0, True, True), ("overcast", 81.0, 75.0, False, True), ("rain", 71.0, 80.0, True, False)]
ROWS = [(r[:4], r[4]) for r in GOLF]


def parts(i):
    return [[r for r in ROWS if r[0][i] == v] for v in dict.fromkeys(r[0][i] for r in ROWS)]


def test_criteria():
    assert L.entropy((0.5, 0.5)) == 1 and L.entropy((0.67, 0.33)) == pytest.approx(0.914, abs=0.01) and L.entropy((1, 0, 0, 0)) == 0
    assert L.info_gain(ROWS, parts(0)) == pytest.approx(0.246, abs=0.01)
    assert L.split_info(ROWS, 0) == pytest.approx(1.577, abs=0.01)
    assert L.gini([((), True)] * 2 + [((), False)] * 2) == 0.5
    assert L.gini_split([[((), True)], [((), True)] * 2 + [((), False)] * 2]) == pytest.approx(0.4)


def test_criteria_relational(spark):
    df = spark.createDataFrame(GOLF, "outlook string, t double, h double, windy boolean, gold boolean")
    got = {r.feature: r for r in metrics.split_criteria(df, ["outlook", "windy"]).collect()}
    assert got["outlook"].info_gain == pytest.approx(L.info_gain(ROWS, parts(0)), abs=1e-6)
    assert got["outlook"].entropy == pytest.approx(0.693, abs=0.01) and got["outlook"].split_info == pytest.approx(1.577, abs=0.01)
    assert got["windy"].gini_split == pytest.approx(L.gini_split(parts(3)), abs=1e-6)


def test_trees(spark):
    tree = L.grow(ROWS)
    assert tree == ("case", 0, {"sunny": ("<=", 2, 70.0, (True, 1.0), (False, 1.0)), "overcast": (True, 1.0), "rain": ("case", 3, {False: (True, 1.0), True: (False, 1.0)})})
    cart = L.grow(ROWS, "cart")
    assert cart[:3] == ("eq", 0, "overcast") and cart[3] == (True, 1.0) and cart[4][:3] == ("<=", 1, 75.0)
    df = spark.createDataFrame(GOLF, "outlook string, t double, h double, windy boolean, gold boolean")
    for t in (tree, cart):
        assert all(r.gold == r.guess for r in df.select("gold", L.tree_column(t, df.columns[:4]).alias("guess")).collect())
    assert L.tree_depth(tree) == 2 and len(L.tree_nodes(tree)) == 8


def test_perceptron_weights(spark, tmp_path):
    from textlake.sources.sinks import load_weights, save_weights

    data = [(["bias", "x"], "a"), (["bias", "y"], "b"), (["bias", "x", "y"], "a")]
    w = L.perceptron(data)
    assert [L.best_class(w, fs, ["a", "b"]) for fs, _ in data] == ["a", "b", "a"]
    w["a"]["zero"] = 0.0
    save_weights(spark, w, f"{tmp_path}/w")
    assert load_weights(spark, f"{tmp_path}/w") == w
    rows = spark.createDataFrame([(i, fs) for i, (fs, _) in enumerate(data)], "id int, fs array<string>")
    got = {r.id: r.guess for r in L.classified(rows, L.weight_table(spark, w), ["a", "b"]).collect()}
    assert got == {0: "a", 1: "b", 2: "a"}


def test_softmax():
    rng = np.random.default_rng(0)
    x = np.c_[np.ones(300), rng.normal(size=(300, 2))]
    gold = (x[:, 1] + x[:, 2] > 0).astype(int)
    w, costs = L.softmax(x, gold, 2, epochs=200, l2=0.001)
    assert (L.softmax_probabilities(x, w).argmax(1) == gold).mean() > 0.97
    assert costs[-1] < costs[0] == pytest.approx(math.log(2), abs=0.05)


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "gold string, guess string")
    got = {r["class"]: r for r in metrics.class_metrics(df).collect()}
    assert (got["a"].prec, got["a"].rec) == (1.0, 0.5) and got["c"].f == 0 and got["b"].prec == pytest.approx(1 / 3, abs=1e-6)
    assert got["avg"].n == 3 and got["wavg"].n == 4 and got["wavg"].rec == pytest.approx(0.5)
    assert metrics.accuracy(df).first().accuracy == 50


def test_taggers():
    from textlake.catalog.annotation import tagged_sents

    sents = tagged_sents()
    model = tagging.train(sents)
    assert all(tagging.tag([w for w, _ in s], model) == [t for _, t in s] for s in sents)
    own = tagging.hmm(sents, 2)
    right = sum(a == b for s in sents for a, (_, b) in zip(tagging.viterbi([w for w, _ in s], own), s, strict=True))
    assert right / sum(map(len, sents)) > 0.85
    assert len(tagging.features(["One", "two"], 0, "-start2-", "-start-")) == 14
