"""N-gram, context and transition indexes as grouped aggregations over token arrays.

Neighbours are taken inside the row, from the document's token array, so the only shuffle of
an index is that of its counts, after partial aggregation. Rows are chosen by their places and
not by filters on the array, which would make it twice, and words are never null, so that no
filter for that keeps two readers of one index from sharing its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD, WORD_OR_SIGN, ending_word, upper_first
from .tokens import tokens


def _places(first: int, after: int = 0, stride: int = 1) -> Column:
    """Places (from 1) of an array t from ``first`` to the last but ``after``; no row if there are none."""
    return F.explode(F.when(F.size("t") >= first + after, F.expr(f"sequence({first}, size(t) - {after}, {stride})"))).alias("i")


def _word(step: int = 0) -> Column:
    """The word so many places after i."""
    return F.coalesce(F.element_at("t", F.col("i") + step), F.lit(""))


def grams(docs: DataFrame, n: int, pattern: str = WORD, stride: int = 1, lower: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """w1 .. wn of each document, sliding by ``stride``; one row an occurrence."""
    text = F.lower("text") if lower else F.col("text")
    rows = docs.select(*keep, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("t"))
    rows = rows.select(*keep, "t", _places(1, n - 1, stride))
    return rows.select(*keep, *(_word(j).alias(f"w{j + 1}") for j in range(n)))


def gram_freqs(docs: DataFrame, n: int, **options: object) -> DataFrame:
    rows = grams(docs, n, **options)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("freq"))


def stats(freqs: DataFrame, freq: str = "freq") -> DataFrame:
    """One row: n_types, total, most, least."""
    return freqs.agg(F.count("*").alias("n_types"), F.coalesce(F.sum(freq), F.lit(0)).alias("total"), F.max(freq).alias("most"), F.min(freq).alias("least"))


def with_total(freqs: DataFrame) -> DataFrame:
    """freqs beside the one-row total: a broadcast, where a window over everything would bring
    all rows to one partition."""
    return freqs.crossJoin(F.broadcast(freqs.agg(F.sum("freq").alias("total"))))


def probabilities(freqs: DataFrame) -> DataFrame:
    out = with_total(freqs).withColumn("prob", F.col("freq") / F.col("total"))
    return out.withColumn("logprob", F.when(F.col("prob") > 0, F.log2("prob"))).drop("total")


def hapaxes(freqs: DataFrame) -> DataFrame:
    """The rows of least frequency."""
    return freqs.join(F.broadcast(freqs.agg(F.min("freq").alias("__least"))), F.col("freq") == F.col("__least"), "left_semi")


def top(freqs: DataFrame, n: int, *ties: str) -> DataFrame:
    return freqs.orderBy(F.desc("freq"), *ties).limit(n)


def conditional(freqs: DataFrame, prefix: list[str]) -> DataFrame:
    """freq and its share among the rows of the same prefix. Totals are combined before their
    shuffle and joined, so a frequent prefix is no partition of its own; the rows aren't sorted for
    that, only a partition's totals are held."""
    totals = freqs.groupBy(*prefix).agg(F.sum("freq").alias("total"))
    return freqs.join(totals.hint("shuffle_hash"), prefix).select(*freqs.columns, (F.col("freq") / F.col("total")).alias("prob"))


def marked_unigrams(docs: DataFrame, pattern: str = WORD_OR_SIGN) -> DataFrame:
    """word and freq with sentence marks: <S> at a text's begin and after a sentence's end (also
    the last one); </S> one less."""
    rows = docs.select(F.concat(F.array(F.lit("<S>")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("t"))
    rows = rows.select("t", _places(1)).select("t", "i", _word().alias("word"))
    after = F.try_element_at("t", F.col("i") + 1)
    ends = F.substring("word", 1, 1).isin(".", "?", "!") & F.col("word").rlike(r"^[.?!]+$") & (after.isNull() | upper_first(after))
    marked = rows.select(F.explode(F.when(ends, F.array("word", F.lit("<S>"))).otherwise(F.array("word"))).alias("word"))
    freqs = marked.groupBy("word").agg(F.count("*").alias("freq"))
    row = lambda word, freq: F.struct(word.alias("word"), freq.alias("freq"))
    own = row(F.col("word"), F.col("freq"))
    both = F.when(F.col("word") == "<S>", F.array(own, row(F.lit("</S>"), F.col("freq") - 1))).otherwise(F.array(own))
    return freqs.select(F.explode(both).alias("x")).select("x.word", "x.freq")


def marked_bigrams(docs: DataFrame, pattern: str = WORD_OR_SIGN) -> DataFrame:
    """w1, w2 and freq; a pair across a sentence's end counts as (w1, </S>) and (<S>, w2)."""
    rows = docs.select(F.concat(F.array(F.lit("<S>")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.array(F.lit("</S>"))).alias("t"))
    rows = rows.select("t", F.when(F.size("t") > 2, F.lit(1)).alias("more")).select("t", F.explode(F.when(F.col("more") == 1, F.expr("sequence(1, size(t) - 1)"))).alias("i")).select(_word().alias("a"), _word(1).alias("b"))
    cut = F.substring("a", 1, 1).isin(".", "?", "!") & F.col("a").rlike(r"^[.?!]+$") & upper_first(F.col("b"))
    pair = lambda x, y: F.struct(x.alias("w1"), y.alias("w2"))
    pairs = F.when(cut, F.array(pair(F.col("a"), F.lit("</S>")), pair(F.lit("<S>"), F.col("b")))).otherwise(F.array(pair(F.col("a"), F.col("b"))))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.w1", "p.w2").agg(F.count("*").alias("freq"))


def transitions(docs: DataFrame, n: int = 1) -> DataFrame:
    """prefix (n words before, the nearest first, blank-joined), word, freq and weight."""
    start = F.array(*[F.lit("¶")] * n)
    rows = docs.select(F.concat(start, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("t"))
    rows = rows.select("t", _places(n + 1))
    rows = rows.select(F.concat_ws(" ", *(_word(-j) for j in range(1, n + 1))).alias("prefix"), _word().alias("word"))
    if n > 1:
        # Most rows are of their own then: each goes once, to the partition of its prefix.
        rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "prefix")
        freqs = rows.groupBy("prefix", "word").agg(F.count("*").alias("freq"))
        return freqs.withColumn("weight", F.col("freq") / F.sum("freq").over(Window.partitionBy("prefix")))
    freqs = rows.groupBy("prefix", "word").agg(F.count("*").alias("freq"))
    return conditional(freqs, ["prefix"]).withColumnRenamed("prob", "weight")


def context_freqs(docs: DataFrame, ignore_order: bool = False, pattern: str = WORD_OR_SIGN) -> DataFrame:
    """word, context (previous_next) and freq."""
    rows = docs.select(F.concat(F.array(F.lit("<S>")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.array(F.lit("</S>"))).alias("t"))
    rows = rows.select("t", _places(2, 1))
    rows = rows.select(*(_word(j).alias(c) for j, c in ((-1, "p"), (0, "word"), (1, "n"))))
    p = F.when(ending_word(F.col("p")) & upper_first(F.col("word")), "<S>").otherwise(F.col("p"))
    n = F.when(ending_word(F.col("word")) & upper_first(F.col("n")), "</S>").otherwise(F.col("n"))
    sides: tuple[Column, Column] = (F.least(p, n), F.greatest(p, n)) if ignore_order else (p, n)
    return rows.select("word", F.concat_ws("_", *sides).alias("context")).groupBy("word", "context").agg(F.count("*").alias("freq"))


def contexts(docs: DataFrame, ignore_order: bool = False, pattern: str = WORD_OR_SIGN) -> DataFrame:
    """word, context (previous_next), freq and weight (share within the word)."""
    return conditional(context_freqs(docs, ignore_order, pattern), ["word"]).withColumnRenamed("prob", "weight")


def similar(freqs: DataFrame, word: str, n: int = 20) -> DataFrame:
    """other and score: words by the summed products of weights over contexts shared with one.

    Products are of ``context_freqs``; sums are divided by both words' totals. The word is chosen
    after the counting, so that there is one index and no other pass over the texts.
    """
    counted = freqs.withColumn("this", F.when(F.col("freq") > 0, F.col("word")) == word)
    own = counted.where("this").select("context", F.col("freq").alias("own"))
    totals = freqs.groupBy("word").agg(F.sum("freq").alias("total"))
    asked = counted.where("this").agg(F.sum("freq").alias("all"))
    shared = counted.where("not this").join(own.hint("shuffle_hash"), "context").groupBy("word").agg(F.sum(F.col("freq") * F.col("own")).alias("both"))
    scored = shared.join(totals.hint("shuffle_hash"), "word").crossJoin(F.broadcast(asked))
    return scored.select(F.col("word").alias("other"), F.round(F.col("both") / F.col("total") / F.col("all"), 9).alias("score")).orderBy(F.desc("score"), "other").limit(n)


def common_contexts(table: DataFrame, one: str, two: str) -> DataFrame:
    a = table.where(F.col("word") == one).select("context", F.col("freq").alias("freq_1"))
    return a.join(table.where(F.col("word") == two).select("context", F.col("freq").alias("freq_2")), "context")


def llr(both: Column, left: Column, right: Column, neither: Column) -> Column:
    """Dunning's G2 in bits of a 2 x 2 table."""
    total = both + left + right + neither
    h = lambda x: F.when(x == 0, 0.0).otherwise(x / total * F.log2(x / total))
    cells = h(both) + h(left) + h(right) + h(neither)
    return 2 * total * (cells - (h(both + left) + h(right + neither)) - (h(both + right) + h(left + neither)))


def collocations(freqs: DataFrame, n: int = 20, stopwords: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """w1, w2, freq and llr of the n bigrams of the greatest log-likelihood ratio.

    Marginals are sums of the bigram counts, which are far fewer than the tokens, joined to the
    bigrams that count.
    """
    left, right = (freqs.groupBy(w).agg(F.sum("freq").alias(c)) for w, c in (("w1", "l"), ("w2", "r")))
    x = freqs.where(F.col("freq") >= least).join(left.hint("shuffle_hash"), "w1").join(right.hint("shuffle_hash"), "w2")
    x = x.crossJoin(F.broadcast(left.agg(F.sum("l").alias("total"))))
    x = x.where(F.col("freq") >= least).where(~F.lower("w1").isin(*stopwords) & ~F.lower("w2").isin(*stopwords)) if stopwords else x.where(F.col("freq") >= least)
    f, l, r, t = (F.col(c).cast("double") for c in ("freq", "l", "r", "total"))
    x = x.withColumn("llr", F.round(llr(f, l - f, r - f, t - l - r + f), 6))
    return x.orderBy(F.desc("llr"), "w1", "w2").limit(n).select("w1", "w2", "freq", "llr")


def word_freqs(docs: DataFrame, lower: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    word = F.lower("word") if lower else F.col("word")
    return tokens(docs, keep=keep).select(*keep, word.alias("word")).groupBy(*keep, "word").agg(F.count("*").alias("freq"))
