import os
import random

import numpy as np
import pyarrow as pa

from textlake.llm import passages as ps

from .conftest import prose


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for _ in range(150):
        at = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 4))])
        h, least = rng.integers(0, 25, at[-1]).astype(np.uint64), int(rng.integers(1, 8))
        want = set()

        def walk(lo, hi, h=h, least=least, want=want):
            if hi - lo + 1 >= least:
                c = lo + int(np.argmin(h[lo : hi + 1]))
                want.add((lo, c, hi))
                walk(lo, c - 1)
                walk(c + 1, hi)

        for a, b in zip(at[:-1], at[1:], strict=True):
            walk(int(a), int(b) - 1)
        assert set(zip(*(z.tolist() for z in ps.compact_windows(h, at, least)), strict=True)) == want


def test_packing():
    rng = np.random.default_rng(8)
    sides = [rng.integers(0, 1 << 63, 3).astype(np.uint64) for _ in range(2 * len(ps.BESIDE))]
    s = ps.packed(np.array([0, 4, 500]), np.array([60, 0, 100_000]), sides)
    left, right = ps.reaches(s)
    assert left.tolist() == [0, 4, 127] and right.tolist() == [60, 0, 127]
    assert min(127, 127) >= ps.LEAST
    for i, side in enumerate(reversed(sides)):
        assert (ps.side_of(s, i) == (side >> np.uint64(52)).astype(np.int64)).all()


def rows_of(rng, n):
    """Rows in few groups with few sides, sorted as they come."""
    v, ids = rng.integers(0, 6, n), rng.integers(0, 40, n)
    order = np.lexsort((ids, v))
    sides = [rng.integers(0, 3, n).astype(np.uint64) << np.uint64(62) for _ in range(2 * len(ps.BESIDE))]
    return v[order], ids[order], ids[order] * 7, ps.packed(rng.integers(0, 60, n), rng.integers(0, 60, n), sides)


def walked(v, ids, s):
    """The links of ``ps.links`` by their definition."""
    (left, right), out = ps.reaches(s), set()
    for x in range(len(v)):
        for i in range(-1, 2 * len(ps.BESIDE)):
            own = [y for y in range(len(v)) if v[y] == v[x] and ids[y] < ids[x] and (i < 0 or ps.side_of(s[[y]], i) == ps.side_of(s[[x]], i))]
            for y in own[:1] + own[-1:]:
                if min(left[x], left[y]) + min(right[x], right[y]) + 1 >= ps.LEAST - 2 * ps.SHINGLE:
                    out.add((x, y))
    return out


def test_links_by_definition():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 30, 80):
        for _ in range(5):
            v, ids, _, s = rows_of(rng, n)
            x, y, _ = ps.links(v, ids, s)
            assert set(zip(x.tolist(), y.tolist(), strict=True)) == walked(v, ids, s)


def test_blocks_leave_no_link_out(monkeypatch):
    rng = np.random.default_rng(6)
    v, ids, t, s = rows_of(rng, 400)
    t = np.arange(400)
    batches = [pa.record_batch([pa.array(c[i : i + 7]) for c in (v, ids, t, s)], ["v", "id", "t", "s"]) for i in range(0, 400, 7)]

    def got(size):
        monkeypatch.setattr(ps, "BLOCK", size)
        out = {}
        for b in ps._linked(iter(batches)):
            for r in b.to_pylist():
                out[r["xt"], r["yt"]] = out.get((r["xt"], r["yt"]), 0) + r["votes"]
        return out

    whole = got(10_000)
    assert got(1) == got(20) == whole and len(whole) > 400
    assert set(whole) == walked(v, ids, s)


def test_hot_groups_are_parted():
    rng = np.random.default_rng(7)
    n = 300
    v = np.where(np.arange(n) < 100, 5, np.where(np.arange(n) < 120, 6, 100 + np.arange(n)))
    ids = rng.permutation(n)
    _, _, _, s = rows_of(rng, n)
    own, new_ids, t, new_s = ps.parted([v, ids, ids, s], 9)
    assert (own[:100] != 5).all() and len(set(own[:100].tolist())) == 1 and (own[100:n] == v[100:]).all()
    top = set(new_ids[n:].tolist())
    assert (own[n:] == 5).all() and min(ids[:100]) in top and len(top) <= 1 + 3 * 2 * len(ps.BESIDE)
    for i in range(2 * len(ps.BESIDE)):
        for side in range(1 << ps.SIDE):
            of = ids[:100][ps.side_of(s[:100], i) == side]
            assert len(of) == 0 or min(of) in top
    assert ps.parted([v, ids, ids, s], 10)[0][0] != own[0]


def corpus():
    """Passages of 50 to 120 words in two to forty documents, some with a changed word."""
    rng = random.Random(3)
    shared = [(prose(rng, rng.randint(50, 120)).split(), rng.choice((2, 2, 3, 5, 40))) for _ in range(30)]
    docs = [[prose(rng, rng.randint(20, 150))] for _ in range(300)]
    planted: dict[int, set] = {}
    for number, (passage, many) in enumerate(shared):
        for d in rng.sample(range(len(docs)), many):
            docs[d] += [" ".join(passage), prose(rng, rng.randint(5, 60))]
            planted.setdefault(number, set()).add(d)
    return [(i, "\n".join(parts)) for i, parts in enumerate(docs)], planted, shared


def test_finds_repeated_passages(spark):
    docs, planted, shared = corpus()
    texts = dict(docs)
    rows = ps.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    for r in rows:
        assert r.source_doc_id < r.doc_id and r.n_words >= ps.LEAST
        assert texts[r.doc_id][r.begin_char] != " " and 0 <= r.source_begin_char < len(texts[r.source_doc_id])
    wanted = {(d, n) for n, ds in planted.items() for d in ds if d != min(ds)}

    def covered(d, n):
        begin = texts[d].index(" ".join(shared[n][0]))
        end = begin + len(" ".join(shared[n][0]))
        return any(r.doc_id == d and r.begin_char <= begin and r.end_char >= end for r in rows)

    assert sum(covered(*x) for x in wanted) >= 0.95 * len(wanted)
    assert {r.doc_id for r in rows} <= {d for d, _ in wanted}


def test_near_passages(spark):
    rng = random.Random(9)
    docs, near = [], 0
    for i in range(60):
        passage = prose(rng, 90).split()
        docs.append((2 * i, prose(rng, 30) + " " + " ".join(passage)))
        passage[rng.randrange(20, 70)] = "changed"
        docs.append((2 * i + 1, " ".join(passage) + " " + prose(rng, 30)))
    rows = ps.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    near = {r.doc_id for r in rows if r.source_doc_id == r.doc_id - 1}
    assert len(near) >= 54


def test_removal_keeps_the_earliest(spark):
    rng = random.Random(5)
    passage, tails = prose(rng, 60), [prose(rng, 30) for _ in range(3)]
    docs = [(1, f"{passage} {tails[0]}", 9), (2, f"{tails[1]} {passage}", 9), (3, passage, 9), (4, f"{tails[2]} é {passage}", 9), (5, "", 0), (6, None, None)]
    out = {r.doc_id: (r.text, r.n_chars) for r in ps.passages_removed(spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint")).collect()}
    assert out == {1: (docs[0][1], 9), 2: (tails[1], len(tails[1])), 4: (f"{tails[2]} é", len(tails[2]) + 2), 5: ("", 0), 6: (None, None)}


def test_odd_rows(odd_docs, no_docs):
    rows = ps.repeated_passages(odd_docs).collect()
    assert [(r.doc_id, r.source_doc_id, r.n_words) for r in rows] == [(6, 5, 60_000)]
    assert ps.repeated_passages(no_docs).count() == 0
    kept = ps.passages_removed(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 3, 4, 4, 5, 7, 8]
    assert ps.passages_removed(no_docs).count() == 0


def all_pairs(docs):
    """(doc_id, text, source id, words) of the repeats between any two texts of different ids."""
    hashed = [(i, t, np.array([hash(w) & (1 << 63) - 1 for w in t.split()], np.uint64)) for i, t in docs]
    return {(i, t, j, e - s) for i, t, x in hashed for j, _, y in hashed if j < i for s, e, *_ in ps.shared_runs(x, y)}


def test_texts_of_one_id_are_told_apart(spark):
    rng = random.Random(33)
    passage, other, a = prose(rng, 60), prose(rng, 130), prose(rng, 120)
    docs = [(1, f"{passage} {prose(rng, 30)}"), (2, f"{prose(rng, 40)} {passage}"), (2, other), (3, a), (4, a), (4, f"{prose(rng, 20)} {' '.join(other.split()[30:100])}"), (5, other)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.source_doc_id, r.n_words) for r in ps.repeated_passages(frame).collect()}
    want = all_pairs(docs)
    assert got <= {(i, j, n) for i, _, j, n in want}
    assert {(i, n) for i, _, n in got} == {(i, n) for i, _, _, n in want}  # a source of each passage
    left = sorted((r.doc_id, r.text) for r in ps.passages_removed(frame).collect())
    cut = {(2, docs[1][1]): docs[1][1].removesuffix(passage).strip(), (4, docs[5][1]): " ".join(docs[5][1].split()[:20])}
    assert left == sorted((i, cut.get((i, t), t)) for i, t in docs if (i, t) not in {(4, a), (5, other)})


def test_clashing_columns(spark):
    rng = random.Random(34)
    a = prose(rng, 60)
    names = ["id", "t", "v", "x", "xt", "y", "yt", "of", "own", "cuts", "_of", "_cuts", "__id", "__spans"]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in ((1, a), (2, f"more {a}"), (3, "x"))], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = ps.passages_removed(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()} == {1: a, 2: "more", 3: "x"}
    assert {(r.doc_id, r.source_doc_id) for r in ps.repeated_passages(docs).collect()} == {(2, 1)}


def test_least_after():
    rng = np.random.default_rng(2)
    at = np.array([0, 9, 9, 30, 31])
    h, last = rng.integers(0, 99, 31).astype(np.uint64), np.repeat(at[1:] - 1, np.diff(at))
    for far in (1, 5, 8):
        want = [min((int(x) for x in h[i + 1 : min(i + far, last[i]) + 1]), default=2**64 - 1) for i in range(31)]
        assert ps.least_after(h, last, far).tolist() == want


def test_edited_passages(spark):
    """Passages of 50 to 100 words with an edit every 10 to 20 words, against brute force."""
    rng = random.Random(21)
    docs = []
    for i in range(120):
        passage, every = prose(rng, rng.randint(50, 100)).split(), rng.randint(10, 20)
        docs.append((2 * i, f"{prose(rng, 70)} {' '.join(passage)} {prose(rng, 40)}"))
        edited = ["edit" + prose(rng, 1) if k % every == every // 2 else w for k, w in enumerate(passage)]
        docs.append((2 * i + 1, f"{prose(rng, 30)} {' '.join(edited)} {prose(rng, 90)}"))
    hashed = [np.array([hash(w) & (1 << 63) - 1 for w in t.split()], np.uint64) for _, t in docs]
    true = {2 * i + 1 for i in range(120) if ps.shared_runs(hashed[2 * i + 1], hashed[2 * i])}
    assert len(true) > 60
    rows = ps.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(true & {r.doc_id for r in rows if r.source_doc_id == r.doc_id - 1}) >= 0.9 * len(true)


def test_passages_beside_a_hot_text(spark):
    """A text of 35 words is in all documents; some share 20 words more, after or before it."""
    rng = random.Random(23)
    hot, docs = prose(rng, 35), [[prose(rng, 60), "", "", prose(rng, 60)] for _ in range(800)]
    for i in range(100):
        more = prose(rng, 20)
        for d in (100 + i, 500 + 3 * i):
            docs[d][1 if i % 2 else 2] = more
    texts = [" ".join([a, b, hot, c, d]) for a, b, c, d in docs]
    rows = ps.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    found = {(r.source_doc_id, r.doc_id) for r in rows}
    true = {(100 + i, 500 + 3 * i) for i in range(100)}
    assert found <= true and len(found) >= 0.97 * len(true)


def test_pairs_are_compared_in_rounds(spark, monkeypatch):
    """Many pairs to a text take several rounds, with the same result as one, and leave no texts behind."""
    rng = random.Random(36)
    passages = [prose(rng, 60) for _ in range(12)]
    docs = spark.createDataFrame([(i, " ".join([*rng.sample(passages, 6), prose(rng, 20)])) for i in range(60)], "doc_id bigint, text string")
    rounds, made = ps.rounds_of, []
    monkeypatch.setattr(ps, "rounds_of", lambda *x: made.append(rounds(*x)) or made[-1])
    got = sorted(map(tuple, ps.repeated_passages(docs).collect()))
    assert made[0] > 2
    monkeypatch.setattr(ps, "rounds_of", lambda *x: 1)
    assert got and got == sorted(map(tuple, ps.repeated_passages(docs).collect()))
    folder = ps.shared_folder(spark).removeprefix("file:")
    assert not [name for name in os.listdir(folder) if name.startswith("texts-")]
