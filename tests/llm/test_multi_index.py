import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textlake.llm import multi_index as mi

from .test_near_dup import classes_of


def test_nearest_cells():
    rng = np.random.default_rng(2)
    one, two = rng.random((20, 7)), rng.random((20, 7))
    for visits in (1, 3, 10, 49):
        got = mi.nearest_cells(one, two, visits)
        for r in range(20):
            total = (one[r][:, None] + two[r][None, :]).ravel()
            assert got[r].tolist() == np.argsort(total, kind="stable")[:visits].tolist()


def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 32))
    for i in range(0, 300):
        x[600 + i] = x[i % 60] + rng.normal(scale=0.07, size=32) * np.linalg.norm(x[i % 60]) / 5
    x[40] = x[41]
    return x


def found(spark, x):
    """(pairs of ids with cosines, rows by id) of vectors."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    rows, pairs = (z.collect() for z in mi.similar_vectors(df))
    ids = {}
    for r in rows:
        ids.setdefault(r.k, []).append(r.id)
    got = {tuple(sorted(p)): r.cosine for r in pairs for p in itertools.product(ids[r.a], ids[r.b])}
    got |= {tuple(sorted(p)): 1.0 for same in ids.values() for p in itertools.combinations(same, 2)}
    return got, {r.vec_id: (r.class_id, r.n_links) for r in mi.near_duplicates(df).collect()}


def checked(x, got):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    true = {(i, j) for i, j in zip(*(z.tolist() for z in np.nonzero(np.triu(c >= mi.THRESHOLD, 1))), strict=True)}
    assert len(true) > 300
    assert len(true & set(got)) >= mi.RECALL * len(true)
    assert all(abs(c[p] - s) < 1e-5 and s >= mi.THRESHOLD for p, s in got.items())


def test_recall_and_classes(spark):
    x = vectors()
    got, rows = found(spark, x)
    checked(x, got)
    assert rows == classes_of(set(got), range(len(x)))


def test_large_cells_are_parted(spark, monkeypatch):
    x = vectors()
    whole, _ = found(spark, x)
    monkeypatch.setattr(mi, "PART", 3)
    assert found(spark, x)[0].keys() == whole.keys()


def test_groups_that_go_on(monkeypatch):
    """A part's vectors and questions in many batches."""
    rng = np.random.default_rng(5)
    n = 60
    x = np.repeat(rng.normal(size=(6, 8)), 10, 0) + rng.normal(scale=0.02, size=(n, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    k = np.concatenate([np.arange(n), np.arange(n)])
    cell, query = np.concatenate([np.arange(n) // 30] * 2), np.repeat([0, 1], n)
    order = np.lexsort((query, cell))
    columns = [pa.array(cell[order]), pa.array(np.zeros(2 * n, np.int32)), pa.array(query[order]), pa.array(k[order]), pa.array([x[i].tobytes() for i in k[order]], pa.binary())]
    whole = pa.record_batch(columns, ["cell", "part", "query", "k", "v"])
    pairs = [{(r["a"], r["b"], r["side"]) for b in mi._asked(0.9)(whole.slice(i, size) for i in range(0, 2 * n, size)) for r in b.to_pylist()} for size in (1, 7, 2 * n)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) >= 2 * 6 * 45


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, None, 0), (4, [], 0), (5, [0.0] * 4, 0), (6, [1.0, None, 3.0, 4.0], 0), (7, [float("nan")] * 4, 0), (8, [1.0, 2.0], 0), (None, v, 0), (9, [-x for x in v], 0), (10, [2.0, 4.0], 0), (11, [2 * x for x in v], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cosine int")
    got = mi.near_duplicates(df)
    assert got.columns == ["vec_id", "class_id", "class_key", "n_links"]
    assert sorted((r.vec_id, r.class_id, r.n_links) for r in got.collect()) == [(1, 1, 2), (2, 1, 2), (8, 8, 1), (9, 9, 0), (10, 8, 1), (11, 1, 2)]
    empty = mi.near_duplicates(df.where(F.lit(False)))
    assert empty.columns == got.columns and empty.count() == 0
    assert [(r.vec_id, r.n_links) for r in mi.near_duplicates(df.where("vec_id = 1")).collect()] == [(1, 0)]


def test_an_empty_round_is_not_the_last():
    assert not mi.complete(0, 0.0, mi.RECALL) and not mi.complete(90, 100.0, mi.RECALL) and mi.complete(95, 100.0, mi.RECALL)


def test_what_is_made_at_a_time_is_bounded():
    """Copies that are all near each other, and many visits, don't make batches of any size."""
    rng = np.random.default_rng(24)
    n, d = 1500, 32
    x = (np.ones((n, d)) + rng.normal(0, 0.01, (n, d))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = pa.array([r.tobytes() for r in x], pa.binary())
    cells, keys = np.zeros(2 * n, np.int64), np.tile(np.arange(n), 2)
    rows = pa.record_batch([pa.array(cells), pa.array(cells.astype(np.int32)), pa.array(np.repeat([0, 1], n).astype(np.int32)), pa.array(keys), pa.chunked_array([v, v]).combine_chunks()], ["cell", "part", "query", "k", "v"])
    found = list(mi._asked(0.9)(iter([rows])))
    assert sum(b.num_rows for b in found) == n * (n - 1)
    assert max(b.num_rows for b in found) * 8 * d <= mi.MADE

    class Shared:
        value = [rng.normal(0, 1, (40, d // 2)) for _ in range(2)]

    asked = list(mi.placed(Shared, d, 8, 1024)(iter([pa.record_batch([pa.array(np.arange(n)), v], ["k", "v"])])))
    assert sum(b.num_rows for b in asked) == n * (1024 - 8) + n
    assert max(b.nbytes for b in asked) <= mi.MADE
