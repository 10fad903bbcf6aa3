import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textlake.llm import mixing, sharding

from .conftest import prose


def docs_of(spark, n=400):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 90)), rng.choice(("a", "a", "a", "b", None))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string"), rows


def test_sizes_are_exact(spark):
    df, rows = docs_of(spark)
    goal = {r.source: r.target for r in mixing.targets(df, 500, {"a": 1, "b": 3}).collect()}
    assert goal == {"a": 125, "b": 375, None: 0}
    got = Counter()
    for r in mixing.sampled(df, 500, {"a": 1, "b": 3}).collect():
        got[r.source] += r.n_copies
    assert got == {"a": 125, "b": 375}
    assert mixing.mixed(df, total=500, weights={"a": 1, "b": 3}).count() == 500


def test_clashing_columns(spark):
    df, rows = docs_of(spark, 60)
    names = ["__id", "__source", "__s", "__size", "__tie", "__rank", "__bucket", "__copy", "copy", "c0", "c1", "x2", "n_chars", "target", "n_copies", "place"]
    wide = df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    want = {r.doc_id: r.n_copies for r in mixing.sampled(df).collect()}
    got = mixing.sampled(wide)
    assert got.columns == [c for c in wide.columns if c != "n_copies"] + ["n_copies"]
    assert {r.doc_id: r.n_copies for r in got.collect()} == want
    many = mixing.mixed(wide)
    assert many.columns == wide.columns and Counter(r.doc_id for r in many.collect()) == want
    assert {r.n_copies for r in many.collect()} == {names.index("n_copies")}


def test_inclusion_follows_length(spark):
    df, rows = docs_of(spark)
    chars = sum(len(t) for _, t, s in rows if s == "a")
    taken = Counter()
    for seed in range(25):
        taken.update({r.doc_id: r.n_copies for r in mixing.sampled(df, 40, {"a": 1}, seed=seed).collect()})
    own = [(len(t), taken[i]) for i, t, s in rows if s == "a"]
    half = sorted(own)[len(own) // 2 :]
    share = sum(n for _, n in half) / sum(n for _, n in own)
    assert share == pytest.approx(sum(x for x, _ in half) / chars, abs=0.08)


def test_against_brute_force(spark):
    df, rows = docs_of(spark, 150)
    goal = {r.source: (r.target, r.n_chars) for r in mixing.targets(df).collect()}
    u = {r.doc_id: r.u for r in df.select("doc_id", mixing.uniform(F.col("doc_id"), 7).alias("u")).collect()}
    want = {}
    for source, (target, chars) in goal.items():
        ranks, left = [], target
        for i, text, s in rows:
            if s == source:
                whole, part = divmod(target * len(text), chars)
                left -= whole
                want[i] = whole
                if part:
                    p = part / chars
                    ranks.append((u[i] * (1 - p) / ((1 - u[i]) * p), i))
        for _, i in sorted(ranks)[:left]:
            want[i] += 1
    got = {r.doc_id: r.n_copies for r in mixing.sampled(df).collect()}
    assert got == {i: n for i, n in want.items() if n}


def first_fit(sizes, capacity):
    bins, out = [], []
    for size in sorted(sizes, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= size]
        if size > capacity or not fit:
            bins.append(max(0, capacity - size))
            out.append((size, len(bins) - 1))
        else:
            best = min(fit, key=lambda b: bins[b])
            bins[best] -= size
            out.append((size, best))
    return bins


def test_packing_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(0, 60) for _ in range(rng.randint(0, 80))]
        places, shards = sharding.packed(Counter(sizes).items(), 50)
        load, bins = Counter(), first_fit([s for s in sizes], 50)
        for size, lo, hi, first, each in places:
            for rank in range(lo, hi):
                load[first + (rank - lo) // each] += size
        assert sum(load.values()) == sum(sizes) and shards == len(bins)
        assert sorted(max(0, 50 - load[b]) for b in range(shards)) == sorted(bins)


def test_shards_hold_groups(spark):
    df, _ = docs_of(spark)
    rows = sharding.shards(df.union(df), 2000).collect()
    by = {}
    for r in rows:
        assert by.setdefault(r.group_id, (r.shard, r.group_bytes)) == (r.shard, r.group_bytes)
    load = Counter()
    for shard, size in by.values():
        load[shard] += size
    assert len(rows) == 800 and max(load.values()) <= 2000 and sorted(load) == list(range(len(load)))


def test_odd_rows(odd_docs, no_docs):
    got = sharding.shards(odd_docs)
    assert got.count() == odd_docs.count() and sharding.shards(no_docs).count() == 0
    assert len({r.group_id for r in got.collect() if r.doc_id in (5, 6)}) == 1
    mix = mixing.sampled(odd_docs)
    assert mix.columns == [*odd_docs.columns, "n_copies"]
    assert not {1, 2} & {r.doc_id for r in mix.collect()}
    assert mixing.sampled(no_docs).count() == 0 and mixing.mixed(no_docs).columns == odd_docs.columns
