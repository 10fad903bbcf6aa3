"""Embedding near-duplicates by an inverted multi-index.

The halves of the normalised vectors have codebooks of their own, trained by k-means over all
vectors; a pair of codewords is a cell of the product grid. Every vector is kept in its cell
and asks the cells nearest to it, in the order of a multi-sequence traversal (by the sum of
both halves' distances). A pair can be found from either of its vectors, so the pairs found
from one side, from the other and from both give a capture-recapture estimate of all pairs;
the number of visited cells doubles until the estimated recall reaches the target, and each
round visits only cells that the rounds before didn't. Cosines are verified exactly. Equal
vectors are collapsed first; a cell of many vectors is parted, and its questions go to each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed, small_batches, tidy, trimmed
from .near_dup import classes

THRESHOLD, RECALL = 0.9, 0.95
#: Vectors to a cell on average, rounds of k-means, cells visited at first.
OCCUPANCY, ROUNDS, VISITS = 8, 6, 8
BLOCK = 2048
#: Vectors of a part of a cell.
PART = 4096
#: Bytes of what is made at a time of questions, or of pairs that are verified; questions of a product.
MADE, ASKS = 1 << 23, 256


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in column]) if len(column) else np.zeros((0, d), np.float32)


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances to codewords, without the part that is the same for all of them."""
    return (codes * codes).sum(1) - 2 * x @ codes.T


def _nearest(x: np.ndarray, deep: int) -> np.ndarray:
    """The places of the ``deep`` least values of each row, in their order."""
    if 4 * deep >= x.shape[1]:
        return np.argsort(x, 1, kind="stable")[:, :deep]
    some = np.sort(np.argpartition(x, deep - 1, 1)[:, :deep], 1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(x, some, 1), 1, kind="stable"), 1)


def nearest_cells(one: np.ndarray, two: np.ndarray, visits: int) -> np.ndarray:
    """The ``visits`` cells of least summed distance for each row, as i * codewords + j. The
    cell of ranks (i, j) has (i + 1)(j + 1) - 1 cells before it, so the traversal can't come
    to others than those of (i + 1)(j + 1) <= visits."""
    k = one.shape[1]
    deep = min(visits, k)
    order1, order2 = _nearest(one, deep), _nearest(two, deep)
    i, j = (z.ravel() for z in np.meshgrid(np.arange(deep), np.arange(deep), indexing="ij"))
    front = (i + 1) * (j + 1) <= visits
    i, j = i[front], j[front]
    total = np.take_along_axis(one, order1, 1)[:, i] + np.take_along_axis(two, order2, 1)[:, j]
    best = np.argsort(total, 1, kind="stable")[:, :visits]
    return np.take_along_axis(order1, i[best], 1) * k + np.take_along_axis(order2, j[best], 1)


def _normalised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, k (a hash of the vector as it is) and unit vector (bytes of float32); only vectors without gaps, not zero."""
    whole = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and size(v) > 1 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('inf'))")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = batch.column(2).flatten().to_numpy().astype(np.float64), np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            size = np.sqrt(np.add.reduceat(flat * flat, at[:-1])) if batch.num_rows else np.zeros(0)
            unit = (flat / np.repeat(np.where(size > 0, size, 1), np.diff(at))).astype(np.float32).tobytes()
            some = pa.array(size > 0)
            v = pa.array([unit[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), v], ["id", "k", "v"]).filter(some)

    return whole.select("id", F.xxhash64("v").alias("k"), "v").mapInArrow(work, "id bigint, k bigint, v binary")


def codebooks(units: DataFrame, d: int, k: int) -> list[np.ndarray]:
    """k codewords for each half, by k-means over all vectors from those of least id hashes."""
    spark = units.sparkSession
    start = np.stack([np.frombuffer(bytes(r["v"]), np.float32) for r in units.orderBy(F.xxhash64("k"), "k").limit(k).collect()]).astype(np.float64)
    cut = d // 2
    books = [start[:, :cut], start[:, cut:]]
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(books)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(b), b.shape[1] + 1)) for b in shared.value]
            for batch in batches:
                x = _matrix(batch.column(1), d).astype(np.float64)
                for part, book, total in zip((x[:, :cut], x[:, cut:]), shared.value, sums, strict=True):
                    for s in range(0, len(part), BLOCK):
                        rows = part[s : s + BLOCK]
                        near = _distances(rows, book).argmin(1)
                        order = np.argsort(near, kind="stable")
                        first = np.flatnonzero(np.append(True, np.diff(near[order]) > 0))
                        total[near[order][first], :-1] += np.add.reduceat(rows[order], first)
                        total[:, -1] += np.bincount(near, minlength=len(book))
            for half, total in enumerate(sums):
                used = np.flatnonzero(total[:, -1])
                if len(used):
                    yield pa.record_batch([pa.array(np.full(len(used), half, np.int32)), pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64()))], ["half", "code", "total"])
            trimmed()

        parts = units.mapInArrow(work, "half int, code int, total array<double>").select("half", "code", F.posexplode("total").alias("p", "x"))
        found = parts.groupBy("half", "code", "p").agg(F.sum("x").alias("x")).toArrow()
        new = [np.zeros((len(b), b.shape[1] + 1)) for b in books]
        half, code, p, x = (found[c].to_numpy() for c in ("half", "code", "p", "x"))
        for h in (0, 1):
            of = half == h
            new[h][code[of], p[of]] = x[of]
        books = [np.where(t[:, -1:] > 0, t[:, :-1] / np.maximum(t[:, -1:], 1), b) for t, b in zip(new, books, strict=True)]
        shared.unpersist()
    return books


def _asked(threshold: float):
    """Pairs of questions and vectors of a part of a cell; its vectors come before its questions."""
    names = ["a", "b", "cosine", "side"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, mine = None, np.zeros(0, np.int64), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cell, part, query, k = (batch.column(c).to_numpy() for c in ("cell", "part", "query", "k"))
            x = _matrix(batch.column("v"), 0)
            edges = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))).tolist() + [batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                here = s + int(np.searchsorted(query[s:e], 1))
                if at == (cell[s], part[s]):
                    own, mine = np.concatenate([own, k[s:here]]), np.concatenate([mine, x[s:here]])
                else:
                    at, own, mine = (cell[s], part[s]), k[s:here], x[s:here]
                if here == e or len(own) == 0:
                    continue
                few = max(1, MADE // (8 * x.shape[1]))
                for b in range(here, e, ASKS):
                    near = np.flatnonzero(x[b : min(b + ASKS, e)] @ mine.T >= threshold - 1e-4)
                    for i in range(0, len(near), few):  # in a cell of copies all pairs are near
                        p, q = np.divmod(near[i : i + few], len(own))
                        p += b
                        p, q = p[k[p] != own[q]], q[k[p] != own[q]]
                        exact = np.einsum("ij,ij->i", x[p].astype(np.float64), mine[q].astype(np.float64))
                        good = exact >= threshold
                        p, q, exact = k[p[good]], own[q[good]], exact[good]
                        if len(p):
                            yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(exact), pa.array(np.where(p < q, 1, 2).astype(np.int32))], names)

    return tidy(work)


def placed(shared, d: int, done: int, visits: int):
    """Rows of the vectors' own cells and of their questions to the cells of ranks ``done`` to ``visits``,
    under the shared codebooks, so few vectors at a time that their questions have ``MADE`` bytes."""
    cut, step = d // 2, max(1, min(BLOCK, MADE // (visits * (4 * d + 24))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, v = batch.column(0), batch.column(1)
            for s in range(0, batch.num_rows, step):
                here = slice(s, min(s + step, batch.num_rows))
                rows = _matrix(v[here], d).astype(np.float64)
                one, two = _distances(rows[:, :cut], shared.value[0]), _distances(rows[:, cut:], shared.value[1])
                cells = nearest_cells(one, two, visits)
                own, new = np.ascontiguousarray(cells[:, 0]), cells[:, done:]
                at = pa.array(np.repeat(np.arange(s, s + len(rows)), new.shape[1]))
                yield pa.record_batch([pa.array(new.ravel()), pa.array(np.ones(new.size, np.int32)), keys.take(at), v.take(at)], ["cell", "query", "k", "v"])
                yield pa.record_batch([pa.array(own), pa.array(np.zeros(len(rows), np.int32)), keys[here], v[here]], ["cell", "query", "k", "v"])

    return tidy(work)


def complete(n: int, every: float, recall: float) -> bool:
    """Whether n pairs are enough of the estimate; a round without pairs estimates nothing."""
    return 0 < recall * every <= n


def _of_size(units: DataFrame, n: int, d: int, threshold: float, recall: float) -> DataFrame:
    """Pairs (a < b, cosine) of the k of distinct vectors of one size."""
    spark = units.sparkSession
    k = max(1, min(n, round((n / OCCUPANCY) ** 0.5)))
    shared = spark.sparkContext.broadcast(codebooks(units, d, k))
    schema = "cell bigint, query int, k bigint, v binary"
    own = units.mapInArrow(placed(shared, d, 1, 1), schema).where("query = 0").groupBy("cell").agg(F.count("*").alias("many"))
    large = checkpointed(own.where(F.col("many") > PART).select(F.col("cell").alias("large"), F.ceil(F.col("many") / PART).cast("int").alias("parts")))
    parts, done, visits = int(spark.conf.get("spark.sql.shuffle.partitions")), 0, min(VISITS, k * k)
    rounds: list[DataFrame] = []
    while True:
        cells = units.mapInArrow(placed(shared, d, done, visits), schema).join(large, F.col("cell") == F.col("large"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.when(F.col("query") == 0, F.array(F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        cells = cells.select("cell", F.explode(part).alias("part"), "query", "k", "v").repartition(parts, "cell", "part").sortWithinPartitions("cell", "part", "query")
        found = cells.mapInArrow(_asked(threshold), "a bigint, b bigint, cosine double, side int")
        for before in rounds:
            found = found.union(before)
        found = checkpointed(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.bit_or("side").alias("side")))
        rounds = [found]
        row = found.agg(F.count("*").alias("n"), F.count_if(F.col("side") != 2).alias("a"), F.count_if(F.col("side") != 1).alias("b"), F.count_if(F.col("side") == 3).alias("m")).first()
        every = (row["a"] + 1) * (row["b"] + 1) / (row["m"] + 1) - 1
        if complete(row["n"], every, recall) or visits >= k * k:
            return found.drop("side")
        done, visits = visits, min(2 * visits, k * k)


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): id and k (hash of its vector) of each row that can be compared, and the
    pairs (a < b, cosine) of the k of distinct vectors that reach the threshold."""
    small_batches(vectors.sparkSession)
    units = checkpointed(_normalised(vectors, id_col, vector_col))
    distinct = checkpointed(units.groupBy("k").agg(F.min("v").alias("v")))
    pairs = units.sparkSession.createDataFrame([], "a bigint, b bigint, cosine double")
    for size in distinct.groupBy(F.length("v").alias("bytes")).count().where("count > 1").orderBy("bytes").collect():
        pairs = pairs.union(_of_size(distinct.where(F.length("v") == size["bytes"]), size["count"], size["bytes"] // 4, threshold, recall))
    return units.select("id", "k"), pairs


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, class_id, class_key and n_links, one row for each vector: an id with one of its
    vectors.

    n_links counts the other vectors whose cosine with it is ``threshold`` at least, equal ones
    among them; classes are linked over any number of links, class_id is the least vec_id of a
    class and class_key the hash of its vector. Every vector asks. Vectors of different sizes
    are compared with those of their size. Null vectors, vectors with null or infinite parts, zero
    vectors, those of one number and rows without an id are left out; repeated rows count
    once. Other columns are not read. An empty table has no rows. The codebooks, which are
    broadcast, grow as the square root of the number of vectors.
    """
    return classes(*similar_vectors(vectors, threshold, recall, id_col, vector_col)).withColumnRenamed("id", "vec_id")
