"""Classifiers: averaged perceptron, softmax, decision trees; forests by pyspark.ml.

Scoring is relational (features joined to weights, trees as CASE expressions). Learners that
depend on the order of examples are kernels over an ordered table of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Weights = dict[str, dict[str, float]]


def feature_strings(**parts: Column) -> Column:
    """An array of "name value" strings."""
    return F.array(*(F.concat_ws(" ", F.lit(name), value.cast("string")) for name, value in parts.items()))


class Averaged:
    """An averaged perceptron that learns an example at a time."""

    def __init__(self, classes: Sequence[str]) -> None:
        self.classes, self.step = list(classes), 0
        self.w: Weights = {}
        self.total: Weights = {}
        self.stamp: dict[tuple[str, str], int] = {}

    def change(self, fs: Sequence[str], c: str, by: float) -> None:
        own, sums = self.w.setdefault(c, {}), self.total.setdefault(c, {})
        for f in fs:
            sums[f] = sums.get(f, 0.0) + (self.step - self.stamp.get((c, f), 0)) * own.get(f, 0.0)
            own[f] = own.get(f, 0.0) + by
            self.stamp[c, f] = self.step

    def learn(self, fs: Sequence[str], gold: str) -> str:
        """The guess before the example is learnt."""
        self.step += 1
        guess = best_class(self.w, fs, self.classes)
        if guess != gold:
            self.change(fs, gold, 1.0)
            self.change(fs, guess, -1.0)
        return guess

    def weights(self) -> Weights:
        """Averages; weights that end as 0 are dropped."""
        return {c: {f: (self.total[c].get(f, 0.0) + (self.step - self.stamp[c, f]) * x) / self.step for f, x in own.items() if x} for c, own in self.w.items()}


def perceptron(examples: Sequence[tuple[Sequence[str], str]], epochs: int = 5) -> Weights:
    """Averaged weights, in the examples' order."""
    own = Averaged(sorted({gold for _, gold in examples}))
    for _ in range(epochs):
        for fs, gold in examples:
            own.learn(fs, gold)
    return own.weights()


def best_class(w: Weights, fs: Sequence[str], classes: Sequence[str]) -> str:
    """The class of the greatest score, the first of equal ones."""
    scores = [sum(w.get(c, {}).get(f, 0.0) for f in fs) for c in classes]
    return classes[scores.index(max(scores))]


def weight_table(spark: SparkSession, w: Weights) -> DataFrame:
    rows = [(c, f, float(x)) for c, own in w.items() for f, x in own.items()]
    return spark.createDataFrame(rows, "class string, feature string, weight double")


def weights_of(table: DataFrame) -> Weights:
    out: Weights = {}
    for row in table.collect():
        out.setdefault(row["class"], {})[row["feature"]] = row["weight"]
    return out


def classified(rows: DataFrame, weights: DataFrame, classes: Sequence[str], key: str = "id", fs: str = "fs") -> DataFrame:
    """key and guess: features joined to weights, summed by class; the first of equal classes."""
    hits = rows.select(key, F.explode(fs).alias("feature")).join(weights, "feature").groupBy(key, "class").agg(F.sum("weight").alias("score"))
    order = F.array_position(F.array(*map(F.lit, classes)), F.col("class"))
    every = rows.select(key, F.explode(F.array(*map(F.lit, classes))).alias("class")).join(hits, [key, "class"], "left")
    return every.groupBy(key).agg(F.max_by("class", F.struct(F.coalesce("score", F.lit(0.0)), -order)).alias("guess"))


def softmax(x: np.ndarray, gold: np.ndarray, n_classes: int, epochs: int = 1000, al: float = 0.1, mo: float = 0.0, l1: float = 0.0, l2: float = 0.1, de: float = 1e-6, start: np.ndarray | None = None, seed: int = 1) -> tuple[np.ndarray, list[float]]:
    """Weights (features, classes) by full-batch descent, and the cost of each epoch."""
    w = np.random.default_rng(seed).normal(0, 0.01, (x.shape[1], n_classes)) if start is None else start.copy()
    hot, before, costs = np.eye(n_classes)[gold], np.zeros_like(w), []
    for _ in range(epochs):
        p = softmax_probabilities(x, w)
        g = x.T @ (p - hot)
        costs.append(float(-np.log(np.maximum((p * hot).sum(1), 1e-3)).mean() + l1 * np.abs(w).sum() + l2 / 2 * (w * w).sum()))
        w -= al * (g / len(x) + l1 + l2 * w) + mo * before
        before = g
        if len(costs) > 1 and abs(costs[-1] - costs[-2]) < de:
            break
    return w, costs


def softmax_probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    e = np.exp(np.minimum(x @ w, 10))
    return e / e.sum(1, keepdims=True)


# Trees over (features, gold) rows with boolean gold: a leaf is (gold, share), a node
# ("case", feature, {value: tree}) or (op, feature, value, yes, no).


def entropy(shares: Sequence[float]) -> float:
    return -sum(p * math.log2(p) for p in shares if p)


def _bits(rows: list) -> float:
    share = sum(g for _, g in rows) / len(rows)
    return entropy((share, 1 - share))


def gini(rows: list) -> float:
    return 1 - sum((n / len(rows)) ** 2 for n in Counter(g for _, g in rows).values())


def gini_split(parts: list[list]) -> float:
    n = sum(map(len, parts))
    return sum(len(p) / n * gini(p) for p in parts)


def info_gain(rows: list, parts: list[list]) -> float:
    return _bits(rows) - sum(len(p) / len(rows) * _bits(p) for p in parts if p)


def split_info(rows: list, i: int) -> float:
    return entropy([n / len(rows) for n in Counter(fs[i] for fs, _ in rows).values()])


def _candidates(values: list) -> list:
    values = sorted(set(values))
    return values if len(values) <= 100 else [values[round(i * (len(values) - 1) / 99)] for i in range(100)]


def grow(rows: list, kind: str = "c4.5", features: list[int] | None = None, depth: int = 32, least: int = 1):
    """A tree on (features, gold) rows. c4.5: information gain, many-way splits of categories,
    which are used up; cart: 1 - gini of two-way splits. Numbers (floats) split by <=. The
    first of equal gains wins; if no feature is better than another, there is no split."""
    if not rows:
        return None
    counts = Counter(g for _, g in rows)
    if len(counts) == 1:
        return (rows[0][1], 1.0)
    top = max(counts.values())
    leaf = (next(g for _, g in rows if counts[g] == top), top / len(rows))
    features = list(range(len(rows[0][0]))) if features is None else features
    if not features or not depth or len(rows) < least:
        return leaf
    gain: Callable[[list[list]], float] = (lambda parts: info_gain(rows, parts)) if kind == "c4.5" else (lambda parts: 1 - gini_split([p for p in parts if p]))
    found = []
    for i in features:
        values = [fs[i] for fs, _ in rows]
        if isinstance(values[0], float):
            tests = [("<=", v, [[r for r in rows if r[0][i] <= v], [r for r in rows if r[0][i] > v]]) for v in _candidates(values)]
        elif kind == "cart":
            tests = [("eq", v, [[r for r in rows if r[0][i] == v], [r for r in rows if r[0][i] != v]]) for v in dict.fromkeys(values)]
        else:
            tests = [("case", None, [[r for r in rows if r[0][i] == v] for v in dict.fromkeys(values)])]
        best = max(tests, key=lambda t: gain(t[2]))
        found.append((gain(best[2]), i, *best))
    if len({round(f[0], 12) for f in found}) == 1:
        return leaf
    _, i, op, value, parts = max(found, key=lambda f: f[0])
    if sum(bool(p) for p in parts) < 2:
        return leaf
    if op == "case":
        rest = [f for f in features if f != i]
        return ("case", i, {p[0][0][i]: grow(p, kind, rest, depth - 1, least) for p in parts})
    return (op, i, value, *(grow(p, kind, features, depth - 1, least) for p in parts))


def tree_depth(tree) -> int:
    if tree is None or isinstance(tree[0], bool) or len(tree) == 2:
        return 0
    below = tree[2].values() if tree[0] == "case" else tree[3:]
    return 1 + max(map(tree_depth, below))


def tree_column(tree, columns: Sequence[str]) -> Column:
    """The tree as nested CASE expressions, which are compiled with the rest of the plan."""
    if tree is None:
        return F.lit(None).cast("boolean")
    if tree[0] == "case":
        out = None
        for value, below in tree[2].items():
            test = F.col(columns[tree[1]]) == F.lit(value)
            out = F.when(test, tree_column(below, columns)) if out is None else out.when(test, tree_column(below, columns))
        return out
    if tree[0] in ("<=", "eq"):
        c = F.col(columns[tree[1]])
        return F.when(c <= tree[2] if tree[0] == "<=" else c == F.lit(tree[2]), tree_column(tree[3], columns)).otherwise(tree_column(tree[4], columns))
    return F.lit(bool(tree[0]))


def tree_nodes(tree) -> list[tuple]:
    """(node_id, parent_id, branch, feature, op, value, class, prob), for storage."""
    out: list[tuple] = []

    def walk(node, parent: int, branch: str) -> None:
        me = len(out)
        if node is None or node[0] not in ("case", "<=", "eq"):
            out.append((me, parent, branch, None, None, None, None if node is None else str(node[0]), None if node is None else float(node[1])))
            return
        value = None if node[0] == "case" else str(node[2])
        out.append((me, parent, branch, node[1], node[0], value, None, None))
        for name, below in node[2].items() if node[0] == "case" else (("yes", node[3]), ("no", node[4])):
            walk(below, me, str(name))

    walk(tree, -1, "")
    return out


def grown_from(rows: DataFrame, columns: Sequence[str], gold: str, kind: str = "c4.5", depth: int = 8, least: int = 2):
    """A tree on the distinct rows of a table, which one aggregation finds; meant for columns of
    few values (bin numbers first), since their combinations come to the driver."""
    counts = rows.groupBy(*columns, gold).count().orderBy(*columns, gold).collect()
    data = [([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r[:-2]], bool(r[-2])) for r in counts for _ in range(r[-1])]
    return grow(data, kind, depth=depth, least=least)


def forest(rows: DataFrame, numbers: Sequence[str], gold: str, trees: int = 10, seed: int = 5):
    """A fitted random forest (two thirds of the rows a tree, the square root of the features)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    model = RandomForestClassifier(labelCol=gold, featuresCol="__x", numTrees=trees, subsamplingRate=2 / 3, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(numbers), outputCol="__x"), model]).fit(rows)


def sampled(rows: DataFrame, n: int, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """Exactly n rows (all, if there are fewer), by a hash of the key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def resampled(rows: DataFrame, label: str, value: object, times: int) -> DataFrame:
    """Rows of one label ``times`` times, others once."""
    n = F.when(F.col(label) == F.lit(value), times).otherwise(1)
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(1), n))).drop("__i")


def feature_ids(rows: DataFrame, fs: str = "fs") -> DataFrame:
    """feature and id, by decreasing frequency, ties by name. A feature's place is the number of
    features of greater frequency, a running sum over the few distinct frequencies, and its
    place among those of its own, which is counted in parts of equal first characters."""
    counts = rows.select(F.explode(fs).alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).withColumn("part", F.substring("feature", 1, 4))
    sizes = counts.groupBy("n", "part").agg(F.count("*").alias("many"))
    levels = sizes.groupBy("n").agg(F.sum("many").alias("level")).withColumn("above", F.sum("level").over(Window.orderBy(F.desc("n"))) - F.col("level"))
    before = sizes.withColumn("before", F.sum("many").over(Window.partitionBy("n").orderBy("part")) - F.col("many"))
    ranked = counts.withColumn("at", F.row_number().over(Window.partitionBy("n", "part").orderBy("feature")) - 1)
    placed = ranked.join(before.select("n", "part", "before"), ["n", "part"]).join(levels.select("n", "above"), "n")
    return placed.select("feature", "n", (F.col("above") + F.col("before") + F.col("at")).cast("int").alias("id"))
