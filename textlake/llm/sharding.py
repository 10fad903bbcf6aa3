"""Sharding by best-fit-decreasing bin packing of indivisible groups.

What the packing does depends on the groups' sizes alone, so only the count of groups of
each size comes to the driver, where sizes enter in decreasing order: all groups of a size
and all bins of one remaining capacity are handled at a time, with the same outcome as one
group after another. The distinct remaining capacities lie in a balanced search tree. Which
group takes which of the places of its size is settled by ranks that are counted in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 16 << 20
#: Parts into which the groups of one size are split to be ranked; ranks of one part are sequential.
PARTS = 32
#: Ranks that share a key in the join with the places.
STRIDE = 1024


class Tree:
    """A search tree over integers, balanced by priorities that are hashes of the keys."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    @classmethod
    def _split(cls, node: list | None, key: int) -> tuple[list | None, list | None]:
        """Keys below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = cls._split(node[3], key)
            node[3] = low
            return node, high
        low, high = cls._split(node[2], key)
        node[2] = high
        return low, node

    @classmethod
    def _merge(cls, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = cls._merge(a[3], b)
            return a
        b[2] = cls._merge(a, b[2])
        return b

    def add(self, key: int) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, key * 0x9E3779B97F4A7C15 % 0xFFFFFFFFFFFFFFC5, None, None]), high)

    def remove(self, key: int) -> None:
        low, high = self._split(self.root, key)
        _, high = self._split(high, key + 1)
        self.root = self._merge(low, high)

    def least_from(self, key: int) -> int | None:
        """The least member that is not below ``key``."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= key:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best


def packed(sizes: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for the groups of (size, count): rows (size, first rank, rank after the last,
    first shard, groups to each shard), and the number of shards. A group larger than the
    capacity has a shard of its own; groups of size 0 go to the fullest shard."""
    places: list[tuple[int, int, int, int, int]] = []
    tree, bins, opened = Tree(), {}, 0

    def put(remaining: int, first: int, count: int) -> None:
        if count:
            if remaining not in bins:
                bins[remaining] = []
                tree.add(remaining)
            bins[remaining].append((first, count))

    for size, many in sorted(sizes, reverse=True):
        rank = 0
        while rank < many:
            left = many - rank
            remaining = capacity if size > capacity else tree.least_from(size)
            if size > capacity or remaining is None:
                each = max(1, capacity // size) if size else left
                full, rest = divmod(left, each)
                first, start = opened, rank
                opened += full + (rest > 0)
                places.append((size, start, many, first, each))
                put(max(0, capacity - each * size), first, full)
                if rest:
                    put(capacity - rest * size, first + full, 1)
                rank = many
                continue
            each = remaining // size if size else left
            first, count = bins[remaining].pop()
            if not bins[remaining]:
                del bins[remaining]
                tree.remove(remaining)
            full, rest = divmod(left, each)
            if full >= count:
                full, rest = count, 0
            taken = full * each + rest
            places.append((size, rank, rank + taken, first, each))
            put(remaining - each * size, first, full)
            if rest:
                put(remaining - rest * size, first + full, 1)
            put(remaining, first + full + (rest > 0), count - full - (rest > 0))
            rank += taken
    return places, opened


def shards(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None) -> DataFrame:
    """doc_id, group_id, group_bytes and shard, one row for each row of ``docs``.

    Rows of equal ``group`` (rows with the same text, if it isn't given) stay together; a
    group's id is its least doc_id and its size the bytes of its texts. Shards are numbered
    from 0 and hold ``capacity`` bytes; a larger group has one of its own. Null texts count 0
    bytes and are one group, as are empty ones; null ids stay. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    keys = ["__a", "__b"]
    of = F.struct(text) if group is None else F.struct(group)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("__bytes"), F.xxhash64(of).alias("__a"), F.xxhash64(F.lit(1), of).alias("__b"))
    groups = rows.groupBy(*keys).agg(F.min("doc_id").alias("group_id"), F.sum("__bytes").alias("group_bytes"))
    groups = groups.withColumn("__part", F.pmod(F.col("__a"), F.lit(PARTS)).cast("int"))
    counted = groups.groupBy("group_bytes", "__part").agg(F.count("*").alias("__n"))
    spark = docs.sparkSession
    sizes = counted.groupBy("group_bytes").agg(F.sum("__n").alias("n")).toArrow()
    places, _ = packed(zip(sizes["group_bytes"].to_pylist(), sizes["n"].to_pylist(), strict=True), capacity)
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame(places, columns=["group_bytes", "__lo", "__hi", "__shard", "__each"]).astype("int64"), "group_bytes bigint, __lo bigint, __hi bigint, __shard bigint, __each bigint")
    table = table.withColumn("__key", F.explode(F.sequence(F.floor(F.col("__lo") / STRIDE), F.floor((F.col("__hi") - 1) / STRIDE))))
    before = counted.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("group_bytes").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = groups.withColumn("__row", F.row_number().over(Window.partitionBy("group_bytes", "__part").orderBy("group_id", "__a", "__b")) - 1)
    ranked = ranked.join(before.drop("__n"), ["group_bytes", "__part"]).withColumn("__rank", F.col("__before") + F.col("__row")).withColumn("__key", F.floor(F.col("__rank") / STRIDE))
    placed = ranked.join(table, ["group_bytes", "__key"]).where("__rank >= __lo and __rank < __hi")
    placed = placed.select(*keys, "group_id", "group_bytes", (F.col("__shard") + F.floor((F.col("__rank") - F.col("__lo")) / F.col("__each"))).cast("bigint").alias("shard"))
    return rows.join(placed, keys).select("doc_id", "group_id", "group_bytes", "shard")
