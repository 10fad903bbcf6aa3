"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages (runs of ``PASSAGE`` words that together cover the whole
text). Each passage is encoded from its surface (lengths, letter cases, signs, repetition) and
from two lexicons of hashed words that speak for or against a label. A small network
encodes the passages further, learns from document labels alone how much attention each
passage deserves, and scores the attention-weighted passage representation. There is one
head for quality and one for toxicity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed
from .textcore import IS_WORD, buffers, slices, words

PASSAGE = 64
#: Labelled documents that the classifier is fitted on at most, those of the least hashes of their ids.
SAMPLE = 20_000
BUCKETS = 1 << 18
HEADS = ("quality", "toxic")
FEATURES = 17
SCHEMA = "doc_id bigint, n_passages int, top_passage int, quality_score double, toxic_score double, keep boolean"


def _bucket(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(46)).astype(np.int64)


def _class(*names: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    for name in names:
        table[[*name.encode("latin-1")]] = 1
    return table


_UPPER, _DIGIT, _LINE = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("\n")
_SIGN, _MARK = _class("#$%&*|<>{}[]\\^~@=+"), _class("!?.,;:'\"()-/")
_WIDE = np.zeros(256, np.int64)
_WIDE[128:] = 1
_PLAIN = IS_WORD.astype(np.int64)
_PLAIN[128:] = 0


def encoded(data: np.ndarray, offsets: np.ndarray, lexicons: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of texts laid end to end, and where each text's begin. A text
    without words has one passage. ``lexicons`` has a row of ``BUCKETS`` scores for each head."""
    begin, end, value, bounds = words(data, offsets)
    counts = np.diff(bounds)
    many = np.maximum(1, -(-counts // PASSAGE))
    at = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(counts)), many)
    k = np.arange(at[-1]) - at[doc]
    first = bounds[doc] + k * PASSAGE
    last = np.minimum(first + PASSAGE, bounds[doc + 1])
    lo = offsets[doc].copy()
    lo[k > 0] = begin[first[k > 0]]
    hi = np.append(lo[1:], offsets[-1])
    n, size = last - first, np.maximum(hi - lo, 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return (total[hi] - total[lo]) / size

    def summed(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[last] - total[first]

    some, per = n > 0, np.maximum(n, 1)
    of = np.repeat(np.arange(len(n)), n)
    key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(n))
    again = np.zeros(len(value))
    if len(value) > 1:
        again[1:] = (value[1:] == value[:-1]) & (of[1:] == of[:-1])
    out = [np.log1p(n), np.minimum(summed(end - begin) / per, 40), share(_UPPER), share(_DIGIT), share(_LINE), share(_SIGN), share(_MARK), share(_WIDE), share(_PLAIN), distinct / per, summed(again) / per]
    bucket = _bucket(value)
    for lexicon in lexicons:
        score = lexicon[bucket].astype(np.float64)
        most, least = np.zeros(len(n)), np.zeros(len(n))
        if some.any():
            most[some] = np.maximum.reduceat(score, first[some])
            least[some] = np.minimum.reduceat(score, first[some])
        out += [most, least, summed(score) / per]
    return np.stack(out, 1), at


def _segments(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Head:
    """One trained network: encoder, gated attention and output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``x`` is standardised; bags are runs of rows that begin at ``starts``."""
        w = self.weights
        many = np.diff(np.append(starts, len(x)))
        h = np.maximum(x @ w["encode"] + w["shift"], 0)
        t, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        e = (t * g) @ w["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), many))
        a = e / np.repeat(_segments(e, starts), many)
        z = _segments(a[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["o"] + w["b"][0]), "many": many}

    def slopes(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """The slopes of the mean log loss of bags with labels ``y``, by weight."""
        w, f = self.weights, self.forward(x, starts)
        h, t, g, a, many = (f[k] for k in ("h", "t", "g", "a", "many"))
        slope = (f["p"] - y) / len(y)
        dz = np.repeat(slope, many)[:, None] * w["o"]
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(_segments(a * da, starts), many))
        dtg = de[:, None] * w["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["v"].T + dg @ w["u"].T) * (h > 0)
        return {"encode": x.T @ dh, "shift": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ de, "o": f["z"].T @ slope, "b": np.array([slope.sum()])}

    def score(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each bag and the attention of each passage."""
        found = self.forward((x - self.mean) / self.scale, at[:-1])
        return found["p"], found["a"]


def fitted(x: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 30, hidden: int = 16, seed: int = 3) -> Head | None:
    """A head for labels 0 and 1 of bags; None if there is but one label."""
    if len(y) == 0 or y.min() == y.max():
        return None
    random = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    d = x.shape[1]
    w = {"encode": random.normal(0, (2 / d) ** 0.5, (d, hidden)), "shift": np.zeros(hidden), "v": random.normal(0, 0.3, (hidden, hidden)), "u": random.normal(0, 0.3, (hidden, hidden)), "w": random.normal(0, 0.3, hidden), "o": random.normal(0, 0.3, hidden), "b": np.zeros(1)}
    head = Head(mean, scale, w)
    x = (x - mean) / scale
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    step, batch = 0, 128
    epochs = max(epochs, -(-3000 * batch // len(y)))
    epochs = min(epochs, 400)
    for epoch in range(epochs):
        order = random.permutation(len(y))
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        for i in range(0, len(y), batch):
            bags = order[i : i + batch]
            many = at[bags + 1] - at[bags]
            starts = np.concatenate([[0], np.cumsum(many)[:-1]])
            rows = np.repeat(at[bags] - starts, many) + np.arange(many.sum())
            xb = x[rows]
            slopes = head.slopes(xb, starts, y[bags])
            step += 1
            for name, value in slopes.items():
                value = value + 1e-4 * w[name]
                first[name] = 0.9 * first[name] + 0.1 * value
                second[name] = 0.999 * second[name] + 0.001 * value * value
                w[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return head


@dataclass
class Classifier:
    lexicons: np.ndarray
    heads: list[Head | None]

    def work(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            missing = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                x, at = encoded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.lexicons)
                null = missing[i:j]
                scores, top = [], np.zeros(j - i, np.int32)
                for head in self.heads:
                    if head is None:
                        scores.append(pa.nulls(j - i, pa.float64()))
                        continue
                    p, a = head.score(x, at)
                    if not scores:
                        order = np.lexsort((a, np.repeat(np.arange(j - i), np.diff(at))))
                        top = (order[at[1:] - 1] - at[:-1]).astype(np.int32)
                    scores.append(pa.array(p, mask=null))
                good = ~null
                for score, wanted in zip(scores, (True, False), strict=True):
                    p = score.to_numpy(zero_copy_only=False)
                    good &= np.where(np.isnan(p), ~null, (p >= 0.5) == wanted)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(np.diff(at).astype(np.int32), mask=null), pa.array(top, mask=null), *scores, pa.array(good)], ["doc_id", "n_passages", "top_passage", "quality_score", "toxic_score", "keep"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fold, label value and bucket, the documents that have a word there."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        group = batch.column("group").to_numpy()
        found = []
        for i, j in slices(offsets):
            _, _, value, bounds = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            doc = np.repeat(np.arange(j - i), np.diff(bounds))
            key = np.unique(doc * BUCKETS + _bucket(value))
            found.append(group[i:j][key // BUCKETS] * BUCKETS + key % BUCKETS)
        if found:
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(n)], ["key", "n"])


def lexicon(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """How surely each bucket speaks for label 1 (above 0) or 0 (below), from -1 to 1, by the
    Wilson bound of its share that lies nearer the share of all: ``counts`` and ``docs`` are of
    labels 0 and 1."""
    base = docs[1] / max(1, docs.sum())
    n = counts.sum(0)
    share, z = counts[1] / np.maximum(n, 1), 1.96
    middle = (share + z * z / (2 * np.maximum(n, 1))) / (1 + z * z / np.maximum(n, 1))
    reach = z / (1 + z * z / np.maximum(n, 1)) * np.sqrt(share * (1 - share) / np.maximum(n, 1) + z * z / (4 * np.maximum(n, 1) ** 2))
    more, less = np.maximum(0, middle - reach - base) / max(1 - base, 1e-9), np.maximum(0, base - middle - reach) / max(base, 1e-9)
    return np.where(n > 0, more - less, 0).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fits both heads on at most ``sample`` labelled documents.

    The lexicons that encode a training document come from the other half of the sample, so
    that words seen once don't pass for evidence; new documents get the lexicons of both.
    Repeated labels of a document count once, with the worse value; values other than 0 and 1
    count as missing. A label without two values gives no head.
    """
    spark = docs.sparkSession
    known = lambda c: F.when(F.col(c).isin(0, 1), F.col(c).cast("int")).alias(c)
    worst = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), known("quality"), known("toxic")).where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    worst = worst.where("quality is not null or toxic is not null")
    chosen = worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    q, t = F.coalesce(F.col("quality"), F.lit(2)), F.coalesce(F.col("toxic"), F.lit(2))
    group = (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)) * 9 + q * 3 + t).cast("int")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = checkpointed(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", group.alias("group"), "text"))
    table = rows.mapInArrow(_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((18, BUCKETS))
    key = table["key"].to_numpy()
    counts[key // BUCKETS, key % BUCKETS] = table["n"].to_numpy()
    sizes = np.zeros(18)
    for row in rows.groupBy("group").count().collect():
        sizes[row["group"]] = row["count"]
    counts, sizes = counts.reshape(2, 3, 3, BUCKETS), sizes.reshape(2, 3, 3)

    def both(fold: slice) -> np.ndarray:
        quality = lexicon(counts[fold].sum((0, 2))[:2], sizes[fold].sum((0, 2))[:2])
        toxic = lexicon(counts[fold].sum((0, 1))[:2], sizes[fold].sum((0, 1))[:2])
        return np.stack([quality, toxic])

    folds = [both(slice(1, 2)), both(slice(0, 1))]  # each half is encoded with the other's
    shared = spark.sparkContext.broadcast(folds)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("group").to_numpy()
            for fold in (0, 1):
                part = batch.filter(pa.array(group // 9 == fold))
                data, offsets = buffers(part.column("text"))
                for i, j in slices(offsets):
                    x, at = encoded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value[fold])
                    x = [r.tobytes() for r in np.split(x.astype(np.float32), at[1:-1])]
                    yield pa.record_batch([part.column("doc_id").slice(i, j - i), part.column("group").slice(i, j - i), pa.array(x, pa.binary())], ["doc_id", "group", "x"])

    got = rows.mapInArrow(features, "doc_id bigint, group int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("group", "ascending")])
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["x"].to_pylist()]
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, FEATURES))
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    group = got["group"].to_numpy() % 9
    heads = []
    for label in (group // 3, group % 3):
        bag = np.flatnonzero(label < 2)
        many = np.diff(at)[bag]
        own = np.concatenate([[0], np.cumsum(many)])
        part = x[np.repeat(at[bag] - own[:-1], many) + np.arange(own[-1])]
        heads.append(fitted(part, own, label[bag].astype(float)))
    return Classifier(both(slice(0, 2)), heads)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_passages, top_passage (of most attention for quality), quality_score,
    toxic_score and keep, one row for each row of ``docs``.

    A document is kept if its quality score is at least one half and its toxic score below.
    Only the fit uses a sample (``SAMPLE`` labelled documents); every passage of every document
    is scored, in one pass without a shuffle. A null text has null scores and isn't kept, an
    empty one is scored as one passage without words. A head that can't be trained has null
    scores and rejects nothing. Repeated rows give repeated rows, null ids stay, other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: shared.value.work(batches), SCHEMA)


def rejected_dropped(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with their columns, that the classifier keeps; one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    at = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), batch.column(at.index("text"))], ["doc_id", "text"])
            keep = [x.column("keep") for x in shared.value.work(iter([pair]))]
            if keep:
                yield batch.filter(pa.chunked_array(keep).combine_chunks())

    return docs.mapInArrow(work, docs.schema)
