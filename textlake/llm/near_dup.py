"""N-gram Jaccard join by a MinHash LSH forest.

Every document has ``TREES`` labels of ``DEPTH`` min-hashes. The labels of each tree are kept
sorted, which makes them a prefix trie; a pair of documents is a candidate once their labels
in some tree share a prefix. A pair of similarity s is found at depth d with probability
1 - (1 - s^d)^TREES; prefixes are shortened until that is the target for a pair at the threshold
itself, so what is found of a pair doesn't depend on the other pairs of a corpus. Short prefixes are
shared by chance too, by ever more pairs of a growing corpus: labels carry a sketch (two bits of
``SKETCH`` of the min-hashes), and a pair whose sketches agree so little that one at the threshold
does so with probability ``MISS`` at most isn't a candidate. Candidates are verified exactly on
their n-gram sets.

Documents of equal word sequences are collapsed first, so a group of copies costs as much as one
text. For verification, pairs meet at a run of a trie that holds both; a text is sent once to
each such run, not once to each of its pairs. A large run is parted into cells of bounded size, and a
cell's pairs, whose number grows with its square, pass through the kernel batch by batch.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed, fresh, small_batches, tidy, whole_groups
from .textcore import buffers, mix, ngrams, slices, words

GRAM, THRESHOLD, RECALL = 3, 0.5, 0.95
TREES, DEPTH = 32, 8
#: Min-hashes of a sketch, two bits of each; probability with which sketches hide a pair at the threshold.
SKETCH, MISS = 128, 1e-6
PLANES = [f"s{i}" for i in range(SKETCH // 32)]
_U = np.uint64
_random = np.random.default_rng(20240229)
_A = (_random.integers(0, 1 << 32, TREES * DEPTH, np.uint64) | _U(1)).astype(np.uint32)
_B = _random.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)
PAIR = ["a", "b"]
#: Texts and bytes of a home from which it is parted; pairs that are compared by bits, and 64-bit words of these at a time.
TEXTS, BYTES, MANY, BITS = 1000, 8 << 20, 64, 1 << 22


def prefix_depth(threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is found with the target's probability
    (1 if there is none)."""
    return next((d for d in range(DEPTH, 1, -1) if 1 - (1 - threshold**d) ** TREES >= recall), 1)


def least_agreement(threshold: float) -> int:
    """The most min-hashes of a sketch in which a pair at the threshold agrees but for ``MISS``: two
    bits agree if the min-hashes do, else once in four."""
    p, below = 0.25 + 0.75 * threshold, 0.0
    for m in range(SKETCH + 1):
        below += math.comb(SKETCH, m) * p**m * (1 - p) ** (SKETCH - m)
        if below > MISS:
            return m
    return SKETCH


def sketches(sign: np.ndarray) -> list[np.ndarray]:
    """Of signatures, the last two bits of every other min-hash: first planes of the one bit, then of the other."""
    some = sign.reshape(len(sign), -1)[:, :: TREES * DEPTH // SKETCH]
    return [np.packbits((some >> bit & 1).astype(np.uint8), 1).view(np.int64)[:, i] for bit in (0, 1) for i in range(SKETCH // 64)]


def agreement(planes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of min-hashes in which the sketches of rows i and j agree."""
    total, half = np.zeros(len(i), np.int64), len(planes) // 2
    for one, two in zip(planes[:half], planes[half:], strict=True):
        total += np.bitwise_count(~((one[i] ^ one[j]) | (two[i] ^ two[j])).view(np.uint64))
    return total


def sequence_keys(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each document's sequence of words."""
    counts = np.diff(bounds)
    place = np.arange(len(value), dtype=np.uint64) - np.repeat(bounds[:-1], counts).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + mix(place + _U(77))), dtype=np.uint64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + counts.astype(np.uint64)).view(np.int64)


def signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of each min-hash of each document that has n-grams, a row for each."""
    short = (grams >> _U(32)).astype(np.uint32)
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), TREES * DEPTH), np.uint16)
    for j in range(TREES * DEPTH):
        least = np.minimum.reduceat(short * _A[j] + _B[j], starts)
        out[:, j] = (mix(least.astype(np.uint64) + _U(j)) & _U(0xFFFF)).astype(np.uint16)
    return out


@tidy
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; one without words has neither key nor signature."""
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        for i, j in slices(offsets):
            _, _, value, bounds = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            none = np.diff(bounds) == 0
            sign = np.zeros((j - i, TREES * DEPTH), np.uint16)
            if not none.all():
                sign[~none] = signatures(*ngrams(value, bounds, GRAM))
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * TREES * DEPTH), j - i, [None, pa.py_buffer(sign.tobytes())]).cast(pa.binary())
            given = [pa.nulls(j - i, pa.binary()) if none.all() else rows.filter(pa.array(~none)).take(pa.array(np.cumsum(~none) - 1, mask=none))]
            yield pa.record_batch([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(sequence_keys(value, bounds), mask=none), *given, pa.array(np.diff(offsets[i : j + 1]))], ["id", "t", "k", "sign", "size"])


def _labels(depth: int):
    """Rows of the tries: the tree with the first three places of a label, the others up to a
    depth, the sketch and the key of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            data, _ = buffers(batch.column(1))
            sign = data.view(np.uint16).reshape(n, TREES, DEPTH).astype(np.uint64)
            root = np.tile(np.arange(TREES, dtype=np.uint64), (n, 1))
            for j in range(min(depth, 3)):
                root = root << _U(16) | sign[..., j]
            rest = np.zeros((n, TREES), np.uint64)
            for j in range(3, depth):
                rest = mix(rest + sign[..., j] + _U(1))
            columns = [root, rest][: 1 + (depth > 3)]
            each = [*sketches(data.view(np.uint16).reshape(n, TREES * DEPTH)), batch.column(0).to_numpy()]
            yield pa.record_batch([*(pa.array(c.ravel().view(np.int64)) for c in columns), *(pa.array(np.repeat(c, TREES)) for c in each)], [*["root", "rest"][: len(columns)], *PLANES, "k"])

    return work


def _matches(least: int):
    """Pairs whose labels are equal as far as they are given, and whose sketches agree in ``least``
    min-hashes, from sorted tries."""

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        label = [table[c].to_numpy() for c in table.column_names if c in ("root", "rest")]
        k = table["k"].to_numpy()
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in label]))
        run = np.cumsum(new) - 1
        keep = np.flatnonzero(np.bincount(run)[run] > 1)
        if len(keep) == 0:
            return
        k, run = k[keep], run[keep]
        planes = [table[c].to_numpy()[keep] for c in PLANES]
        home = np.zeros(len(keep), np.uint64)
        for c in label:
            home = mix(home + c[keep].view(np.uint64) + _U(7))
        home = home.view(np.int64)
        i, step = np.arange(len(run)), 1
        while len(i):
            i = i[i + step < len(run)]
            i = i[run[i] == run[i + step]]
            for s in range(0, len(i), 100_000):
                p = i[s : s + 100_000]
                p = p[agreement(planes, p, p + step) >= least]
                if len(p):
                    yield pa.record_batch([pa.array(np.minimum(k[p], k[p + step])), pa.array(np.maximum(k[p], k[p + step])), pa.array(home[p])], [*PAIR, "home"])
            step += 1

    return tidy(lambda batches: whole_groups(batches, ["root"], of))


class _Sets:
    """The n-gram sets of texts at homes: those of a batch and of the home that goes on in the next one."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, int], int] = {}
        self.grams: list[np.ndarray] = []

    def add(self, home: list[int], k: list[int], packed: pa.Array) -> None:
        raw = [zlib.decompress(x.as_buffer()) for x in packed]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        for i, j in slices(offsets):
            _, _, value, bounds = words(np.frombuffer(b"".join(raw[i:j]), np.uint8), offsets[i : j + 1] - offsets[i])
            grams, at = ngrams(value, bounds, GRAM)
            for r in range(i, j):
                self.number[home[r], k[r]] = len(self.grams)
                self.grams.append(np.unique(grams[at[r - i] : at[r - i + 1]]))

    def keep(self, home: int) -> None:
        """Lets go of all but one home's."""
        left = [(key, self.grams[n]) for key, n in self.number.items() if key[0] == home]
        self.number, self.grams = {key: n for n, (key, _) in enumerate(left)}, [g for _, g in left]

    def shares(self, home: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """The similarities of pairs, sorted by home; 0 of those that can't reach the threshold."""
        x, y = (np.fromiter(map(self.number.__getitem__, zip(home.tolist(), c.tolist(), strict=True)), np.int64, len(c)) for c in (a, b))
        size = np.array([len(g) for g in self.grams], np.int64)
        share = np.zeros(len(x))
        may = np.flatnonzero(np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]))
        x, y = x[may], y[may]
        cuts = [0, *(np.flatnonzero(np.diff(home[may])) + 1).tolist(), len(may)]
        both = np.concatenate([self._common(x[i:j], y[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])
        share[may] = both / (size[x] + size[y] - both)
        return share

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The numbers of common n-grams: of many pairs by bits of those that several texts have."""
        if len(x) >= MANY:
            rows, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            flat = np.concatenate([self.grams[r] for r in rows.tolist()])
            _, which, many = np.unique(flat, return_inverse=True, return_counts=True)
            wide = -(-int((many > 1).sum()) // 64)
            if len(rows) * wide <= BITS:
                spot = (np.cumsum(many > 1) - 1)[which]
                row = np.repeat(np.arange(len(rows)), [len(self.grams[r]) for r in rows.tolist()])[many[which] > 1]
                spot = spot[many[which] > 1]
                bits = np.zeros((len(rows), wide), np.uint64)
                np.bitwise_or.at(bits, (row, spot >> 6), _U(1) << (spot & 63).astype(np.uint64))
                both, step = np.zeros(len(x), np.int64), max(1, BITS // max(1, 4 * wide))
                i, j = place[: len(x)], place[len(x) :]
                for s in range(0, len(x), step):
                    both[s : s + step] = np.bitwise_count(bits[i[s : s + step]] & bits[j[s : s + step]]).sum(1, dtype=np.int64)
                return both
        both = np.zeros(len(x), np.int64)
        for n, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            p, q = self.grams[i], self.grams[j]
            if len(p) > len(q):
                p, q = q, p
            spot = np.minimum(np.searchsorted(q, p), len(q) - 1)
            both[n] = (q[spot] == p).sum()
        return both


def _verified(threshold: float):
    """Exact similarities; a home's texts come before its pairs, which are judged as they come and
    not held."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kind, home, a, b = (batch.column(c).to_numpy() for c in (1, 0, 2, 3))
            text = kind == 0
            sets.add(home[text].tolist(), a[text].tolist(), batch.column(4).filter(pa.array(text)))
            if not text.all():
                a, b = a[~text], b[~text]
                share = sets.shares(home[~text], a, b, threshold)
                good = share >= threshold
                if good.any():
                    yield pa.record_batch([*(pa.array(c[good]) for c in (a, b)), pa.array(share[good])], [*PAIR, "jaccard"])
            sets.keep(int(home[-1]))

    return work


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they are shuffled."""
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        raw = [zlib.compress(data[offsets[r] : offsets[r + 1]], 1) for r in range(batch.num_rows)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["id", "t", "text"])


def candidates(signed: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Pairs (a < b) of the k of signed texts that may reach the threshold, each with a run that holds both (home)."""
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = prefix_depth(threshold, recall)
    label = ["root", "rest"] if depth > 3 else ["root"]
    # Equal word sequences have equal signatures: any one of them will do.
    labels = signed.where("k is not null").groupBy("k").agg(F.min("sign").alias("sign")).mapInArrow(_labels(depth), ", ".join(f"{c} bigint" for c in [*label, *PLANES, "k"]))
    tries = labels.repartition(parts, "root").sortWithinPartitions(*label)
    pairs = tries.mapInArrow(_matches(least_agreement(threshold)), "a bigint, b bigint, home bigint")
    return checkpointed(pairs.groupBy(*PAIR).agg(F.min("home").alias("home")))


def needed_texts(pairs: DataFrame) -> DataFrame:
    """home and k of the texts of pairs."""
    return pairs.select("home", F.col("a").alias("k")).union(pairs.select("home", "b")).distinct()


def in_cells(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs with homes that need about 2 * ``TEXTS`` texts and 2 * ``BYTES`` bytes (more only of
    long texts) at most: the texts of a larger home are parted into blocks, and each two blocks are a
    home. The table of larger homes has at most one row for ``TEXTS`` texts, or ``BYTES`` bytes, that are sent."""
    many = needed_texts(pairs).join(sizes, "k").groupBy("home").agg(F.greatest(F.ceil(F.count("*") / TEXTS), F.ceil(F.sum("size") / BYTES)).alias("blocks")).where("blocks > 1")
    one, two = (F.pmod(F.xxhash64(c), "blocks") for c in PAIR)
    cell = F.when(F.col("blocks").isNull(), F.col("home")).otherwise(F.xxhash64("home", F.least(one, two), F.greatest(one, two)))
    return pairs.join(F.broadcast(many), "home", "left").select(*PAIR, cell.alias("home"))


def similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): id, k (hash of the word sequence, null without words) and t (hash of the
    text) of each row that has an id, and the pairs (a < b, jaccard) of the k of distinct word
    sequences that reach the threshold."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").select("id", F.xxhash64("text").alias("t"), "text")
    signed = checkpointed(texts.mapInArrow(_signed, "id bigint, t bigint, k bigint, sign binary, size bigint"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = candidates(signed, threshold, recall)
    one = signed.where("k is not null").groupBy("k").agg(F.min(F.struct("id", "t", "size")).alias("one")).select("k", "one.id", "one.t", "one.size")
    pairs = in_cells(pairs, one.select("k", "size"))
    needed = needed_texts(pairs).join(one.drop("size"), "k")
    small = texts.where("text is not null").mapInArrow(_sent, "id bigint, t bigint, text binary").dropDuplicates(["id", "t"])
    sent = needed.join(small, ["id", "t"]).select("home", F.lit(0).alias("kind"), F.col("k").alias("a"), F.lit(0).cast("bigint").alias("b"), "text")
    asked = pairs.select("home", F.lit(1).alias("kind"), *PAIR, F.lit(None).cast("binary").alias("text"))
    meet = sent.union(asked).repartition(parts, "home").sortWithinPartitions("home", "kind")
    found = checkpointed(meet.mapInArrow(_verified(threshold), "a bigint, b bigint, jaccard double"))
    return signed.drop("sign", "size"), found


def roots_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """k of each word sequence, the number of its documents, and the least id of its component
    with the k of that: class_id and class_key."""
    sizes = checkpointed(rows.where("k is not null").select("id", "k").distinct().groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    ends = pairs.join(sizes.select(F.col("k").alias("a"), F.struct(F.col("least").alias("id"), F.col("k")).alias("x")), "a").join(sizes.select(F.col("k").alias("b"), F.struct(F.col("least").alias("id"), F.col("k")).alias("y")), "b")
    roots = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id.k").alias("k"), "root")
    return sizes.join(roots, "k", "left").select("k", "n", F.coalesce("root.id", "least").alias("class_id"), F.coalesce("root.k", "k").alias("class_key"))


def classes(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, class_id, class_key and n_links of rows (id, k) under pairs (a < b) of k; see
    ``jaccard_classes``."""
    documents, sizes = rows.select("id", "k").distinct(), checkpointed(roots_of(rows, pairs))
    both = pairs.select(F.col("a").alias("of"), F.col("b").alias("k")).union(pairs.select("b", "a"))
    links = both.join(sizes.select("k", "n"), "k").groupBy(F.col("of").alias("k")).agg(F.sum("n").alias("links"))
    every = sizes.join(links, "k", "left").select("k", "class_id", "class_key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return documents.join(every, "k", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), "class_key", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_key and n_links, one row for each document: an id with one of
    its word sequences.

    n_links counts the other documents whose sets of word 3-grams are similar to the document's
    (``threshold`` at least), copies among them. Documents that are linked, over any number of
    links, are a class; class_id is the least doc_id of it and class_key the hash of that
    document's words, which tells classes apart where an id has several texts. A document without
    links is a class of its own. Texts of one or two words have one n-gram of all their words.
    Texts without words (null and empty ones too) have no links and no class_key; rows without
    an id are left out; repeated rows count once. Other columns are not read; no table is too
    small. Pairs are verified but not put out, so the rows grow as the documents do.
    """
    return classes(*similar(docs, threshold, recall, id_col, text_col)).withColumnRenamed("id", "doc_id")


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id_a, key_a, doc_id_b, key_b and jaccard: the pairs behind ``jaccard_classes``, between
    distinct word sequences, each by its least doc_id and its hash. Rows and columns are
    read as there; as many rows as there are pairs of different similar texts."""
    rows, pairs = similar(docs, threshold, recall, id_col, text_col)
    least = rows.where("k is not null").groupBy("k").agg(F.min("id").alias("id"))
    a, b = (least.select(F.col("k").alias(x), F.col("id").alias(f"doc_id_{x}")) for x in PAIR)
    return pairs.join(a, "a").join(b, "b").select("doc_id_a", F.col("a").alias("key_a"), "doc_id_b", F.col("b").alias("key_b"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """id and root (least id of its component) of the nodes of undirected edges (a, b).

    Each round gives every node the least root among its own, its neighbours' and its root's;
    rounds end when nothing changes.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        new = roots.join(near, "id").select("id", F.least("root", "r").alias("to"), "root")
        above = new.select(F.col("id").alias("to"), F.least("to", "root").alias("top"))
        new = checkpointed(new.join(above, "to", "left").select("id", F.least("to", F.coalesce("top", "to")).alias("root"), F.col("root").alias("old")))
        changed = new.where("root < old").limit(1).count()
        roots = new.select("id", "root")
        if not changed:
            return roots


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates (a component of similar
    documents): that of the least doc_id. An id's texts are judged apart: only what is similar
    to a kept text goes. Of repeated rows, and of texts of an id with the same words, one stays (any
    one, where they differ in other columns). Rows without words or without an id stay. Other
    columns are carried, whatever their names."""
    rows, pairs = similar(docs, threshold, recall)
    texts = rows.where("k is not null").groupBy("k", "id", "t").agg(F.count("*").alias("n"))
    first = texts.groupBy("k", "id").agg(F.min("t").alias("first"))
    judged = texts.join(first, ["k", "id"]).join(roots_of(rows, pairs).drop("n"), "k")
    stays = (F.col("id") == F.col("class_id")) & (F.col("k") == F.col("class_key")) & (F.col("t") == F.col("first"))
    of, at, stay = fresh(docs.columns, "of", "at", "stay")
    marks = checkpointed(judged.select(F.col("id").alias(of), F.col("t").alias(at), stays.alias(stay), "n").where(~F.col(stay) | (F.col("n") > 1)).drop("n"))
    same = (docs["doc_id"].cast("bigint") == marks[of]) & (F.xxhash64(docs["text"].cast("string")) == marks[at])
    again = docs.join(marks.where(stay), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(marks, same, "left_anti").union(again)
