from collections import defaultdict

import pytest

from textlake.operators import tagging as Y

TEXTS = [("the house", "das haus"), ("the book", "das buch"), ("a book", "ein buch"), ("the the house", "haus das haus"), ("", "leer")]


def shares(counts, given):
    total = defaultdict(float)
    for k, c in counts.items():
        total[given(k)] += c
    return {k: c / total[given(k)] for k, c in counts.items()}


def walked(rounds):
    """t and q by loops over sentences."""
    pairs = [(a.split(), b.split()) for a, b in TEXTS]
    seen = {(e, f) for a, b in pairs for e in a for f in b}
    t = shares(dict.fromkeys(seen, 1.0), lambda k: k[0])
    q = {(i, len(a), len(b), j): 1 / len(a) for a, b in pairs for i in range(len(b)) for j in range(len(a))}
    for _ in range(rounds):
        ct, cq = defaultdict(float), defaultdict(float)
        for a, b in pairs:
            for i, f in enumerate(b):
                w = [q[i, len(a), len(b), j] * t[e, f] for j, e in enumerate(a)]
                for j, e in enumerate(a):
                    ct[e, f] += w[j] / sum(w)
                    cq[i, len(a), len(b), j] += w[j] / sum(w)
        t, q = shares(ct, lambda k: k[0]), shares(cq, lambda k: k[:3])
    return t, q


@pytest.mark.parametrize("rounds", [1, 2])
def test_model_2_is_a_walk_over_sentences(spark, rounds):
    frame = lambda side: spark.createDataFrame([(k, x[side].split()) for k, x in enumerate(TEXTS)], "k int, words array<string>")
    pairs = Y.placed_pairs(frame(0), frame(1), "k")
    t, q = Y.em_start(pairs), Y.place_start(pairs)
    for _ in range(rounds):
        t, q = Y.em_round_placed(pairs, "k", t, q)
    want_t, want_q = walked(rounds)
    assert {(r.e, r.f): r.t for r in t.collect()} == pytest.approx(want_t)
    assert {(r["at"], r.n_e, r.n_f, r.j): r.q for r in q.collect()} == pytest.approx(want_q)


def test_first_round_is_that_of_all_pairs(spark):
    """Repeated words, and several texts of a key on either side, as over the table of pairs."""
    left = [(k, x[0].split()) for k, x in enumerate(TEXTS)] + [(1, ["the", "old", "book"]), (9, ["alone"]), (0, None)]
    right = [(k, x[1].split()) for k, x in enumerate(TEXTS)] + [(1, ["das", "alte", "buch", "da"]), (8, ["allein"]), (0, None)]
    left, right = (spark.createDataFrame(x, "k int, words array<string>") for x in (left, right))
    pairs = Y.alignment_pairs(left, right, "k")
    want = {(r.e, r.f): r.t for r in Y.em_round(pairs, "k", Y.em_start(pairs)).collect()}
    first = Y.em_first(left, right, "k")
    assert {(r.e, r.f): r.t for r in first.collect()} == pytest.approx(want) and len(want) > 12


def test_first_round_shuffles_no_pairs(spark):
    from textlake.plans import physical_plan

    frame = lambda n: spark.createDataFrame([(k, [f"{n}{i}" for i in range(20)]) for k in range(4)], "k int, words array<string>")
    plan = physical_plan(Y.em_first(frame("e"), frame("f"), "k"))
    assert "hashpartitioning(e" in plan and ", f#" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)


def test_places_leave_in_bounded_batches():
    """However many and long the texts of a batch are, and nulls and blank texts among them."""
    import pyarrow as pa

    from textlake.sources import alignment

    texts = ["ab  c\n", None, "", " \t", "x " * 200_000, *["one two " * 500] * 300]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = list(alignment._places(iter([batch])))
    assert max(b.num_rows for b in out) <= alignment.SLICE
    rows = [r for b in out for r in b.to_pylist()]
    assert rows[:2] == [{"doc_id": 0, "tok_ix": 0, "word": "ab", "beg": 0, "end": 2}, {"doc_id": 0, "tok_ix": 1, "word": "c", "beg": 4, "end": 5}]
    assert len(rows) == 2 + 200_000 + 300 * 1000 and all(texts[r["doc_id"]][r["beg"] : r["end"]] == r["word"] for r in rows[::997])
    assert [r["tok_ix"] for r in rows if r["doc_id"] == 4] == list(range(200_000))
