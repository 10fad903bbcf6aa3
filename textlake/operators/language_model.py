"""N-gram language models as tables, scored by joins."""

from __future__ import annotations

import random
from bisect import bisect
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD
from .ngrams import gram_freqs

ALPHA = 0.4


def model(docs: DataFrame, order: int = 2) -> list[DataFrame]:
    """Frequencies of the lower-cased n-grams of orders 1 to ``order`` within texts padded
    with <s> and </s>."""
    padded = docs.select(F.concat_ws(" ", F.lit("_S_"), F.lower("text"), F.lit("_E_")).alias("text"))
    return [gram_freqs(padded, n) for n in range(1, order + 1)]


def unigram_logprob(docs: DataFrame, sents: DataFrame, key: str) -> DataFrame:
    """key, n_words and logprob (base 2): the sum over a text's words; null with an unseen one."""
    freqs = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("freq"))
    total = freqs.agg(F.sum("freq").alias("total"))
    rows = sents.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    scored = rows.join(freqs, "w", "left").crossJoin(F.broadcast(total))
    out = scored.groupBy(key).agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * F.log2(F.col("freq") / F.col("total"))).alias("s"), F.count_if(F.col("freq").isNull()).alias("unseen"))
    return out.select(key, "n_words", F.when(F.col("unseen") == 0, F.round("s", 6)).alias("logprob"))


#: Most asked n-grams of a round, each of which reads the documents once; they are broadcast.
ASKED = 500_000


def _spots(rows: DataFrame, keep: list[str], starts: int, first: int, n: int) -> DataFrame:
    """w1 .. wn: the n words up to each place from ``first`` on of texts padded with start marks
    and an end mark; before a text's begin null. Texts that are null have no places."""
    words = F.concat(F.array_repeat(F.lit("_s_"), starts), F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), F.array(F.lit("_e_")))
    rows = rows.select(*keep, words.alias("t"))
    rows = rows.select(*keep, "t", F.explode(F.when(F.col("t").isNotNull(), F.expr(f"sequence({first}, size(t))"))).alias("i"))
    word = lambda j: F.try_element_at("t", F.when(F.col("i") > j, F.col("i") - j))
    return rows.select(*keep, *(word(n - j).alias(f"w{j}") for j in range(1, n + 1)))


def asked_counts(docs: DataFrame, asked: DataFrame, sets: list[tuple[str, ...]]) -> list[DataFrame]:
    """For each set of columns its asked values and their numbers among all rows of ``docs``
    (c0, c1, ..), and a last table of one row, the number of all rows. Only what is asked is counted, so that the n-grams
    of the documents aren't shuffled; a set of which a part has been looked up before is only looked up where that is found."""
    flags = [f"found{k}" for k in range(len(sets))]
    for k, own in enumerate(sets):
        want = asked.select(*(F.col(c).alias(f"a{k}{c}") for c in own)).distinct().withColumn(flags[k], F.lit(True))
        part = max((i for i in range(k) if set(sets[i]) < set(own)), key=lambda i: len(sets[i]), default=None)
        first = F.col(own[0]) if part is None else F.when(F.col(flags[part]), F.col(own[0]))
        same = [(first if c == own[0] else F.col(c)) == F.col(f"a{k}{c}") for c in own]
        docs = docs.join(F.broadcast(want), same, "left").drop(*(f"a{k}{c}" for c in own))
    hit = lambda k: F.struct(F.lit(k).alias("k"), F.array(*sets[k]).alias("g"))
    none = F.struct(F.lit(len(sets)).alias("k"), F.array().cast("array<string>").alias("g"))
    hits = F.array_compact(F.array(none, *(F.when(F.col(f), hit(k)) for k, f in enumerate(flags))))
    found = docs.select(F.explode(hits).alias("x")).groupBy("x.k", "x.g").agg(F.count("*").alias("n")).persist()
    of = lambda k: found.where(F.col("k") == k)
    return [of(k).select(*(F.col("g")[j].alias(c) for j, c in enumerate(own)), F.col("n").alias(f"c{k}")) for k, own in enumerate(sets)] + [of(len(sets)).select(F.col("n").alias("total"))]


def _counted(docs: DataFrame, asked: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """``asked`` with c0, c1, .. (null if unseen) and total."""
    names = sorted({c for own in sets for c in own})
    rounds = max(1, -(-asked.select(*names).distinct().count() // ASKED))
    out = None
    for r in range(rounds):
        own = asked.where(F.pmod(F.xxhash64(*names), F.lit(rounds)) == r) if rounds > 1 else asked
        *counts, total = asked_counts(docs, own, sets)
        for count, columns in zip(counts, sets, strict=True):
            own = own.join(count, list(columns), "left")
        own = own.join(F.broadcast(total), F.lit(True), "left")
        out = own if out is None else out.unionByName(own)
    return out


def bigram_scores(docs: DataFrame, sents: DataFrame, key: str, alpha: float = ALPHA) -> DataFrame:
    """key, n_pairs, n_seen, logprob (maximum likelihood; null with an unseen pair) and backoff
    (stupid backoff: alpha times the last word's probability, for unseen words alpha squared
    times that of a word seen once). Both base 2."""
    asked = _spots(sents, [key], 1, 2, 2).groupBy(key, "w1", "w2").agg(F.count("*").alias("n"))
    scored = _counted(_spots(docs, [], 1, 1, 2), asked, [("w2",), ("w1", "w2"), ("w1",)]).withColumn("p2", F.col("c1") / F.col("c2"))
    backed = F.coalesce(F.col("p2"), alpha * F.col("c0") / F.col("total"), alpha * alpha / F.col("total"))
    out = scored.groupBy(key).agg(
        F.sum("n").alias("n_pairs"),
        F.sum(F.when(F.col("p2").isNotNull(), F.col("n")).otherwise(0)).alias("n_seen"),
        F.sum(F.col("n") * F.log2("p2")).alias("mle"),
        F.sum(F.col("n") * F.log2(backed)).alias("b"),
    )
    return out.select(key, "n_pairs", "n_seen", F.when(F.col("n_seen") == F.col("n_pairs"), F.round("mle", 6)).alias("logprob"), F.round("b", 6).alias("backoff"))


def backoff_scores(docs: DataFrame, sents: DataFrame, key: str, order: int = 3, alpha: float = ALPHA) -> DataFrame:
    """key, n_words (with the end mark), n_seen (whole n-grams seen) and backoff (base 2): stupid
    backoff of any order. Texts begin with order - 1 start marks. The share of an unseen
    n-gram is alpha times that of the next shorter one; an unseen word's is that of a word seen once.
    The n-grams of the asked texts, and what precedes their last words, are counted in one pass."""
    names = [f"w{j}" for j in range(1, order + 1)]
    grams = [tuple(names[order - n :]) for n in range(1, order + 1)]
    before = [tuple(names[order - n : -1]) for n in range(2, order + 1)]
    asked = _spots(sents, [key], order - 1, order, order).groupBy(key, *names).agg(F.count("*").alias("n"))
    out = _counted(_spots(docs, [], order - 1, order, order), asked, grams + before)
    shares = [F.col("c0") / F.col("total"), *(F.col(f"c{n - 1}") / F.col(f"c{order + n - 2}") for n in range(2, order + 1))]
    score = F.coalesce(*(alpha ** (order - n) * shares[n - 1] for n in range(order, 0, -1)), alpha**order / F.col("total"))
    seen = F.when(F.col(f"c{order - 1}").isNotNull(), F.col("n")).otherwise(0)
    return out.groupBy(key).agg(F.sum("n").alias("n_words"), F.sum(seen).alias("n_seen"), F.round(F.sum(F.col("n") * F.log2(score)), 6).alias("backoff"))


def perplexity(scores: DataFrame, logprob: str, words: str) -> DataFrame:
    """One row: 2 to the mean negative log probability of a word."""
    return scores.agg(F.round(F.pow(F.lit(2.0), -F.sum(logprob) / F.sum(words)), 6).alias("perplexity"))


def cumulative_transitions(table: DataFrame) -> DataFrame:
    """Transition weights with running sums within the prefix, for sampling."""
    order = Window.partitionBy("prefix").orderBy("word")
    return table.withColumn("upto", F.sum("weight").over(order))


def generated(transitions: list[tuple[str, str, float]], length: int, seed: int, start: str = "¶") -> list[str]:
    """A walk of ``length`` words over (prefix, word, weight) rows, prefixes of one or more
    words, nearest first; it starts anew where a prefix has no continuation."""
    table: dict[str, tuple[list[str], list[float]]] = {}
    for prefix, word, weight in sorted(transitions):
        words, sums = table.setdefault(prefix, ([], []))
        words.append(word)
        sums.append((sums[-1] if sums else 0.0) + weight)
    order = len(next(iter(table)).split(" ")) if table else 1
    draw, out, state = random.Random(seed), [], [start] * order
    while table and len(out) < length:
        found = table.get(" ".join(state))
        if found is None:
            if state == [start] * order:
                break
            state = [start] * order
            continue
        words, sums = found
        word = words[min(bisect(sums, draw.random() * sums[-1]), len(words) - 1)]
        out.append(word)
        state = [word, *state[:-1]]
    return out


def walked(table: DataFrame, length: int, seed: int, start: str = "¶", order: int = 1) -> list[str]:
    """The walk of ``generated`` over a table of all transitions, which stays distributed: only
    the rows of visited prefixes are collected, once each. Partitions are sorted by prefix, so that
    a visit reads only the batches whose range holds it."""
    steps = table.select("prefix", "word", "weight").sortWithinPartitions("prefix").persist()
    draw, out, state, known = random.Random(seed), [], [start] * order, {}
    while len(out) < length:
        prefix = " ".join(state)
        if prefix not in known:
            rows = sorted((r["word"], r["weight"]) for r in steps.where(F.col("prefix") == prefix).collect())
            known[prefix] = ([w for w, _ in rows], list(accumulate(x for _, x in rows)))
        words, sums = known[prefix]
        if not words:
            if state == [start] * order:
                break
            state = [start] * order
            continue
        out.append(words[min(bisect(sums, draw.random() * sums[-1]), len(words) - 1)])
        state = [out[-1], *state[:-1]]
    steps.unpersist()
    return out
