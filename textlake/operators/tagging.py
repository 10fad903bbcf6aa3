"""Part-of-speech tagging and word alignment."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .learning import Averaged, Weights, best_class

Sent = Sequence[tuple[str, str]]


def normal(word: str) -> str:
    """Lower case; numbers and addresses as classes."""
    if word[:1].isdigit() and all(c.isdigit() or c in ",." for c in word) and len(word) > 1:
        return "00"
    return "@__" if "@" in word[1:] else word.lower()


def features(words: Sequence[str], i: int, prev: str, prev2: str) -> list[str]:
    """The 14 features of a word in its sentence."""
    around = ["-start-", "-start2-", *map(normal, words), "-end-", "-end2-"]
    j, word = i + 2, words[i]

    def suffix(w: str) -> str:
        return "" if w.startswith("-") and w.endswith("-") and len(w) > 2 else w[-3:]

    return [
        "bias", f"i pref1 {word[0]}", f"i suf3 {word.lower()[-3:]}", f"i word {word}",
        f"i-1 pos {prev}", f"i-2 pos {prev2}", f"i-1 pos + i-2 pos {prev} {prev2}", f"i-1 pos + i word {prev} {word}",
        f"i-1 word {around[j - 1]}", f"i-1 suf3 {suffix(around[j - 1])}", f"i+1 word {around[j + 1]}", f"i+1 suf3 {suffix(around[j + 1])}",
        f"i-2 word {around[j - 2]}", f"i+2 word {around[j + 2]}",
    ]


def single_tags(sents: Sequence[Sent], oftener: int = 20, share: float = 0.97) -> dict[str, str]:
    counts: dict[str, Counter] = {}
    for word, tag in (x for s in sents for x in s):
        counts.setdefault(word, Counter())[tag] += 1
    top = {w: (c.most_common(1)[0], sum(c.values())) for w, c in counts.items()}
    return {w: tag for w, ((tag, n), total) in top.items() if total > oftener and n > share * total}


def train(sents: Sequence[Sent], epochs: int = 5) -> tuple[Weights, list[str], dict[str, str]]:
    """Weights, tags and the words of a single tag. A word's history is what the model would have
    given the words before: the tag of a single-tag word, else its own guess at that time."""
    tags, single = sorted({t for s in sents for _, t in s}), single_tags(sents)
    own = Averaged(tags)
    for _ in range(epochs):
        for sent in sents:
            words, prev, prev2 = [w for w, _ in sent], "-start2-", "-start-"
            for i, (word, gold) in enumerate(sent):
                guess = single.get(word) or own.learn(features(words, i, prev, prev2), gold)
                prev, prev2 = guess, prev
    return own.weights(), tags, single


def tag(words: Sequence[str], model: tuple[Weights, list[str], dict[str, str]]) -> list[str]:
    """Greedy: words of a single tag get it, others the best class given the tags before."""
    weights, tags, single = model
    out, prev, prev2 = [], "-start2-", "-start-"
    for i, word in enumerate(words):
        found = single.get(word) or best_class(weights, features(words, i, prev, prev2), tags)
        out.append(found)
        prev, prev2 = found, prev
    return out


def tagged_column(words: Column, model, kernel=None) -> Column:
    """Tags of word arrays by a kernel (``tag`` by default); the model travels with the plan."""
    of = kernel or tag

    def batch_tags(batch: pd.Series) -> pd.Series:
        return batch.map(lambda ws: None if ws is None else of(list(ws), model))

    return F.pandas_udf(batch_tags, ArrayType(StringType()))(words)


def rare_class(word: str) -> str:
    if any(c.isdigit() for c in word):
        return "_NUM_"
    return "_CAPS_" if word.isupper() else "_LASTCAP_" if word[-1:].isupper() else "_RARE_"


def hmm(sents: Sequence[Sent], least: int = 5) -> dict:
    """Emission and trigram transition shares; words rarer than ``least`` count as their class."""
    freq = Counter(w for s in sents for w, _ in s)
    emit, tags, tri, bi = Counter(), Counter(), Counter(), Counter()
    for sent in sents:
        path = ["*", "*", *(t for _, t in sent), "STOP"]
        for w, t in sent:
            emit[t, w if freq[w] >= least else rare_class(w)] += 1
            tags[t] += 1
        for i in range(2, len(path)):
            tri[tuple(path[i - 2 : i + 1])] += 1
            bi[tuple(path[i - 2 : i])] += 1
    known = {w for w, n in freq.items() if n >= least}
    return {"known": known, "tags": sorted(tags), "emit": {k: n / tags[k[0]] for k, n in emit.items()}, "move": {k: n / bi[k[:2]] for k, n in tri.items()}}


#: Sequences whose tags a process remembers.
REMEMBERED = 20_000


def viterbi(words: Sequence[str], model: dict) -> list[str]:
    """The most likely tags under the trigram model; unseen moves have a small share. Words count
    by their classes only, so sequences of equal classes are tagged once (as far as they are remembered)."""
    seen = tuple([w if w in model["known"] else rare_class(w) for w in words])
    memo = _memo(model)
    if seen not in memo.paths:
        if len(memo.paths) >= REMEMBERED:
            memo.paths.clear()
        memo.paths[seen] = memo.path(seen)
    return list(memo.paths[seen])


class _Memo:
    """The logarithms of a model's shares, as far as they were asked, and tags of sequences."""

    def __init__(self, model: dict) -> None:
        self.model, self.fits, self.moves, self.paths = model, {}, {}, {}

    def fit(self, w: str) -> list[tuple[str, float]]:
        if w not in self.fits:
            emit = self.model["emit"]
            tags = [t for t in self.model["tags"] if (t, w) in emit] or self.model["tags"]
            self.fits[w] = [(t, math.log(emit.get((t, w), 0) or TINY)) for t in tags]
        return self.fits[w]

    def move(self, key: tuple[str, str, str]) -> float:
        if key not in self.moves:
            self.moves[key] = math.log(self.model["move"].get(key, 0) or TINY)
        return self.moves[key]

    def path(self, seen: tuple[str, ...]) -> list[str]:
        best, back = {("*", "*"): 0.0}, []
        for w in seen:
            new: dict[tuple[str, str], float] = {}
            came: dict[tuple[str, str], tuple[str, str]] = {}
            for (u, v), score in best.items():
                for t, emitted in self.fit(w):
                    s = score + self.move((u, v, t)) + emitted
                    if (v, t) not in new or s > new[v, t]:
                        new[v, t], came[v, t] = s, (u, v)
            best = new
            back.append(came)
        if not seen:
            return []
        at, out = max(best.items(), key=lambda kv: (kv[1] + self.move((*kv[0], "STOP")), kv[0]))[0], []
        for came in reversed(back):
            out.append(at[1])
            at = came[at]
        return out[::-1]


TINY = 1e-6
_last: list[_Memo] = []


def _memo(model: dict) -> _Memo:
    """That of the model last used here."""
    if not _last or _last[0].model is not model:
        _last[:] = [_Memo(model)]
    return _last[0]


def alignment_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, at, e and f: every word of a text beside each word (at place ``at``) of its counterpart."""
    return left.select(key, F.explode("words").alias("e")).join(right.select(key, F.posexplode("words").alias("at", "f")), key)


def em_start(pairs: DataFrame) -> DataFrame:
    """t(f | e) alike for all f beside e."""
    seen = pairs.select("e", "f").distinct()
    return seen.join(seen.groupBy("e").agg(F.count("*").alias("n")), "e").select("e", "f", (1.0 / F.col("n")).alias("t"))


def em_round(pairs: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """One round of model 1: each f is shared among the words beside it in proportion to t; the
    shares, summed by (e, f), are normalised for each e."""
    rows = pairs.join(table, ["e", "f"])
    rows = rows.join(rows.groupBy(key, "at").agg(F.sum("t").alias("all")), [key, "at"])
    counts = rows.groupBy("e", "f").agg(F.sum(F.col("t") / F.col("all")).alias("c"))
    return counts.join(counts.groupBy("e").agg(F.sum("c").alias("all")), "e").select("e", "f", (F.col("c") / F.col("all")).alias("t"))


#: Parts of a turn's words by hash, which spread the pairs of a frequent word.
PARTS = 16


def em_first(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``em_round`` of ``em_start``: e, f and t, without a shuffle of pairs. As t is 1 / n for all f
    beside e, the share that e has of an f depends on the words beside e only: it is found, and
    normalised, from words and texts. Words then meet the texts beside them, whose words are
    parted by hash, and only there become pairs."""
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Of texts of one key, the words at one place share what is given to that place.
    texts = right.where("words is not null").groupBy(key).agg(F.collect_list("words").alias("lists"))
    each = F.transform("lists", lambda ws: F.transform(ws, lambda f, at: F.struct(f.alias("f"), (1.0 / F.aggregate("lists", F.lit(0), lambda n, other: n + F.when(F.size(other) > at, 1).otherwise(0))).alias("part"))))
    alone = F.transform(F.element_at("lists", 1), lambda f: F.struct(f.alias("f"), F.lit(1.0).alias("part")))
    texts = texts.select(key, F.when(F.size("lists") == 1, alone).otherwise(F.flatten(each)).alias("fs")).where(F.size("fs") > 0)
    blocks = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda b: F.filter("fs", lambda x: F.pmod(F.xxhash64(x["f"]), F.lit(PARTS)) == b))
    texts = texts.select(key, F.aggregate("fs", F.lit(0.0), lambda n, x: n + x["part"]).alias("size"), blocks.alias("blocks"))
    words = left.select(key, F.explode("words").alias("e")).groupBy(key, "e").agg(F.count("*").alias("many"))

    def beside(rows: DataFrame, *carried: str) -> DataFrame:
        met = rows.join(texts.select(key, "blocks"), key).select("e", *carried, F.posexplode("blocks").alias("b", "own")).where(F.size("own") > 0)
        return met.repartition(parts, "e", "b").select("e", "b", *carried, F.explode("own").alias("x"))

    seen = beside(words).select("e", "b", F.col("x.f").alias("f")).groupBy("e", "b", "f").agg(F.lit(1)).groupBy("e").agg(F.count("*").alias("n"))
    rows = words.join(texts.select(key, "size"), key).join(seen, "e").withColumn("w", F.col("many") / F.col("n"))
    rows = rows.join(rows.groupBy(key).agg(F.sum("w").alias("every")), key).withColumn("w", F.col("w") / F.col("every"))
    rows = rows.join(rows.groupBy("e").agg(F.sum(F.col("w") * F.col("size")).alias("all")), "e").select(key, "e", (F.col("w") / F.col("all")).alias("w"))
    return beside(rows, "w").groupBy("e", "b", F.col("x.f").alias("f")).agg(F.sum(F.col("w") * F.col("x.part")).alias("t")).select("e", "f", "t")


def placed_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``alignment_pairs`` with the place j of e and both lengths, n_e and n_f."""
    of = left.select(key, F.size("words").alias("n_e"), F.posexplode("words").alias("j", "e"))
    return of.join(right.select(key, F.size("words").alias("n_f"), F.posexplode("words").alias("at", "f")), key)


PLACES = ["at", "n_e", "n_f", "j"]


def place_start(pairs: DataFrame) -> DataFrame:
    """q(j | at, n_e, n_f) alike for all j."""
    return pairs.select(*PLACES).distinct().withColumn("q", 1.0 / F.col("n_e"))


def em_round_placed(pairs: DataFrame, key: str, table: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of model 2: each f is shared in proportion to q times t. Returns t(f | e) and
    q(j | at, n_e, n_f), both from the same shares."""
    rows = pairs.join(table, ["e", "f"]).join(places, PLACES).withColumn("w", F.col("q") * F.col("t"))
    rows = rows.join(rows.groupBy(key, "at").agg(F.sum("w").alias("all")), [key, "at"]).withColumn("c", F.col("w") / F.col("all"))
    words, spots = rows.groupBy("e", "f").agg(F.sum("c").alias("c")), rows.groupBy(*PLACES).agg(F.sum("c").alias("c"))
    t = words.join(words.groupBy("e").agg(F.sum("c").alias("all")), "e").select("e", "f", (F.col("c") / F.col("all")).alias("t"))
    at = PLACES[:-1]
    q = spots.join(spots.groupBy(*at).agg(F.sum("c").alias("all")), at).select(*PLACES, (F.col("c") / F.col("all")).alias("q"))
    return t, q
