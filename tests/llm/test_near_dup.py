import itertools
import random
import re

import numpy as np

from textlake.llm import near_dup as nd

from .conftest import prose

WORD = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+")


def grams(text, n=3):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, threshold):
    sets = {i: grams(t) for i, t in docs if t}
    return {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if x and y and len(x & y) >= threshold * len(x | y)}


def keyed(docs):
    """The ids of each word sequence, by its words."""
    out = {}
    for i, t in docs:
        words = tuple(WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")))
        if words and i is not None:
            out.setdefault(words, set()).add(i)
    return out


def found_pairs(spark, docs):
    """Pairs of ids: those between different word sequences, and those within one."""
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    same = list(keyed(docs).values())
    least = {}
    for ids in same:
        least.setdefault(min(ids), []).append(ids)
    assert all(len(x) == 1 for x in least.values())
    out = {tuple(sorted(p)): 1.0 for ids in same for p in itertools.combinations(ids, 2)}
    for r in nd.jaccard_pairs(frame).collect():
        for p in itertools.product(least[r.doc_id_a][0], least[r.doc_id_b][0]):
            out[tuple(sorted(p))] = r.jaccard
    return out


def corpus():
    rng = random.Random(7)
    docs, line = [], prose(rng, 13)
    for i in range(120):
        words = prose(rng, rng.randint(30, 200)).split()
        docs.append(" ".join(words))
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy = words[:]
            for _ in range(rng.randint(0, len(words) // 15)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            docs.append(" ".join(copy) + (f"\n{line}" if rng.random() < 0.3 else ""))
    docs += [docs[0]] * 30
    return list(enumerate(docs))


def test_recall_and_exactness(spark):
    docs = corpus()
    found = found_pairs(spark, docs)
    true = brute(docs, nd.THRESHOLD)
    assert len(true) > 400
    assert set(found) <= set(true)
    assert all(abs(found[p] - true[p]) < 1e-9 for p in found)
    assert len(found) >= nd.RECALL * len(true)
    apart = {p for p, j in true.items() if j < 1}
    assert len(apart & set(found)) >= nd.RECALL * len(apart)


def classes_of(pairs, ids):
    """The least id of each id's component, and its number of pairs."""
    root = {i: i for i in ids}
    count = dict.fromkeys(ids, 0)
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    return {i: (root[i], count[i]) for i in ids}


def test_classes_and_links_are_those_of_the_pairs(spark):
    docs = corpus()
    rows = nd.jaccard_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == classes_of(set(found_pairs(spark, docs)), [i for i, _ in docs])
    assert len(rows) == len(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = nd.jaccard_classes(odd_docs)
    assert rows.columns == ["doc_id", "class_id", "class_key", "n_links"]
    got = sorted((r.doc_id, r.class_id, r.class_key is None, r.n_links) for r in rows.collect())
    assert got == [(1, 1, True, 0), (2, 2, True, 0), (3, 3, False, 0), (3, 3, False, 0), (4, 4, False, 0), (5, 5, False, 1), (6, 5, False, 1), (7, 7, True, 0), (8, 8, False, 0)]
    assert len({r.class_key for r in rows.where("class_key is not null").collect()}) == 5
    assert nd.jaccard_classes(no_docs).count() == 0 and nd.jaccard_pairs(no_docs).count() == 0
    kept = nd.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 3, 4, 5, 7, 8]
    assert nd.one_of_each(no_docs).count() == 0


def test_texts_of_one_id_are_judged_apart(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 60) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (3, c), (3, c + "!"), (None, a)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text.rstrip("!")) for r in nd.one_of_each(docs).collect()) == sorted([(1, a), (2, b), (3, c), (0, a)])
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in nd.jaccard_classes(docs).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 0), (3, 3, 0)]


def test_clashing_columns(spark):
    rng = random.Random(32)
    a = prose(rng, 60)
    names = ["id", "t", "k", "sign", "of", "at", "stay", "_of", "n", "class_id", "least", "root", "home"]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in ((1, a), (2, a), (3, "x"))], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = nd.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert nd.jaccard_classes(docs).count() == 3


def test_short_texts_and_ties(spark):
    docs = [(1, "one"), (2, "ONE"), (3, "one two"), (4, "One, two!"), (5, "two one")]
    rows = nd.jaccard_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in rows) == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (5, 5, 0)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)]
    got = {r.id: r.root for r in nd.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
    assert nd.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hot_groups_leave_the_recall_of_weak_pairs(spark):
    rng = random.Random(12)
    hot = prose(rng, 150).split()
    docs = [" ".join([*hot[:i], "changed", *hot[i + 1 :]]) for i in range(90)]
    for _ in range(150):  # one changed word in nine leaves about half of the 3-grams
        words = prose(rng, 90).split()
        docs += [" ".join(words), " ".join("other" if i % 9 == 4 and i < 76 else w for i, w in enumerate(words))]
    docs = list(enumerate(docs))
    weak = {p for p, j in brute(docs, nd.THRESHOLD).items() if p[0] >= 90}
    assert len(weak) == 150
    found = found_pairs(spark, docs)
    assert len(weak & set(found)) >= 0.95 * len(weak)


def test_lone_weak_pairs(spark):
    rng = random.Random(15)
    for _ in range(3):
        words = prose(rng, 90).split()
        docs = [(1, " ".join(words)), (2, " ".join("other" if i % 9 == 4 and i < 76 else w for i, w in enumerate(words)))]
        assert set(found_pairs(spark, docs)) == {(1, 2)}


def test_prefix_depth():
    assert [nd.prefix_depth(s, nd.RECALL) for s in (0.9, 0.5, 0.3, 0.01)] == [8, 3, 2, 1]


def test_chance_prefixes_are_no_candidates(spark):
    """Texts share a prefix by chance the more often the more there are; sketches tell them apart."""
    rng = random.Random(21)
    common = prose(rng, 30)
    docs = [(i, f"{common} {prose(rng, 60)}") for i in range(300)]
    words = prose(rng, 90).split()
    docs += [(300, " ".join(words)), (301, " ".join("other" if i % 9 == 4 and i < 76 else w for i, w in enumerate(words)))]
    true = brute(docs, nd.THRESHOLD)
    assert set(true) == {(300, 301)}
    data = spark.createDataFrame(docs, "id bigint, text string").selectExpr("id", "xxhash64(text) as t", "text")
    signed = nd.checkpointed(data.mapInArrow(nd._signed, "id bigint, t bigint, k bigint, sign binary"))
    ids = {r.k: r.id for r in signed.collect()}
    pairs = {tuple(sorted((ids[r.a], ids[r.b]))) for r in nd.candidates(signed, nd.THRESHOLD, nd.RECALL).collect()}
    assert (300, 301) in pairs and len(pairs) < 300


def test_sketches_agree_as_texts_do():
    rng = random.Random(22)
    seen, share = [], []
    for _ in range(200):
        words = prose(rng, 90).split()
        pair = [" ".join(words), " ".join("other" if i % 9 == 4 and i < 76 else w for i, w in enumerate(words))]
        data = [x.encode() for x in pair]
        offsets = np.cumsum([0, *map(len, data)])
        _, _, value, bounds = nd.words(np.frombuffer(b"".join(data), np.uint8), offsets)
        planes = nd.sketches(nd.signatures(*nd.ngrams(value, bounds, nd.GRAM)))
        share += brute(list(enumerate(pair)), 0.1).values()
        seen.append(int(nd.agreement(planes, np.array([0]), np.array([1]))[0]))
    assert min(seen) >= nd.least_agreement(nd.THRESHOLD)
    assert len(share) == 200 and abs(sum(seen) / nd.SKETCH - sum(0.25 + 0.75 * j for j in share)) < 2


def crowd(n, seed=3):
    """Short texts of a few common lines, of which very many pairs are similar."""
    rng = random.Random(seed)
    lines = [prose(rng, 12) for _ in range(6)]
    return [(i, "\n".join([*rng.sample(lines, 4), prose(rng, rng.randint(1, 14))])) for i in range(n)]


def test_pairs_of_a_run_are_not_held():
    """Verified pairs leave the kernel while those of the same run still come in."""
    import zlib

    import pyarrow as pa

    docs, taken = crowd(200), []
    pairs = list(itertools.combinations(range(len(docs)), 2))

    def batch(kind, a, b, text):
        return pa.record_batch([pa.array([5] * len(a)), pa.array([kind] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.binary())], ["home", "kind", "a", "b", "text"])

    def batches():
        yield batch(0, [i for i, _ in docs], [0] * len(docs), [zlib.compress(t.encode()) for _, t in docs])
        for s in range(0, len(pairs), 500):
            taken.append(s)
            some = pairs[s : s + 500]
            yield batch(1, [a for a, _ in some], [b for _, b in some], [None] * len(some))

    out, early = {}, None
    for found in nd._verified(0.5)(batches()):
        early = early or len(taken)
        out |= {(r["a"], r["b"]): r["jaccard"] for r in found.to_pylist()}
    assert early <= 2 < len(taken)
    assert out == brute(docs, 0.5) and len(out) > 1000


def test_large_runs_are_parted(spark, monkeypatch):
    """Cells have few texts, whatever a run has, and lose no pair."""
    docs = crowd(150, 8)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in nd.jaccard_pairs(frame).collect()}
    monkeypatch.setattr(nd, "TEXTS", 10)
    monkeypatch.setattr(nd, "MANY", 1)
    cells = []
    real = nd.needed_texts
    monkeypatch.setattr(nd, "needed_texts", lambda pairs: cells.append(real(pairs)) or cells[-1])
    assert {(r.doc_id_a, r.doc_id_b): r.jaccard for r in nd.jaccard_pairs(frame).collect()} == want and len(want) > 500
    whole, parted = (max(r["count"] for r in c.groupBy("home").count().collect()) for c in cells)
    assert whole > 60 and parted < 50
