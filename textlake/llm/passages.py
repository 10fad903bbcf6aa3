"""Repeated passages across documents by compact windows.

The tokens of a text are its shingles of ``SHINGLE`` words. Under each of ``HASHES`` hash
functions the Cartesian tree of the tokens' hashes groups all subsequences of at least
``LEAST`` words by the place of their least hash: a compact window (a, c, b) stands for every
subsequence that begins in a..c and ends in c..b, all of which share the min-hash at c. The
windows of equal min-hashes are brought together; each is linked to that of the group's
first document and to that of the document before its own, and likewise within those of the group
that also share the least hash of so many words (``BESIDE``) to the left, or to the right, so a
passage in m documents costs at most 10 m links and not their square, and a text that very many documents share
doesn't hide what only some share beside it. Two documents are compared if linked windows of theirs, laid on each
other at the least places, intersect in a passage of the least length, and these windows agree
in a least hash beside, or there are two of them. A comparison is exact: the
words of shared 5-word sequences form runs, which are reported where they are long and dense.

A min-hash that many documents of one task share is a group of that task first; only the first
documents of it, and of its parts, go on to the group of all tasks. A text goes by its id and
a hash of it, so several texts of one id are told apart.

For the comparison a text is sent once for each of its pairs. Pairs grow faster than texts, so they are
compared in rounds, of which each sends about as many bytes as all texts have.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed, fresh, removed, shared_folder, small_batches, tidy, written
from .textcore import SLICE, buffers, mix, slices, words

#: Words of the shortest passage, of a token of a window and of a token of the comparison.
LEAST, SHINGLE, EXACT = 50, 5, 5
HASHES = 4
#: Tokens to each side of a window's least place whose least hashes part large groups.
BESIDE = (16, 40)
#: Bits of a side's hash; of a window's reach to either side, which need not be known beyond ``LEAST``.
SIDE, REACH = 12, 7
#: Windows that a task holds before it sends them, and of how many a group of its own is made.
HELD, HOT = 400_000, 32
#: Rows that are linked at a time; a larger group goes on from what its earlier rows leave behind.
BLOCK = 200_000
#: Words without a match that a run may hold at a stretch, and its least share of matched words.
GAP, DENSE = 10, 0.8
_U = np.uint64


def shingles(value: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences of each document (none of one of fewer words) and where
    each document's begin."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    start = np.repeat(bounds[:-1] - at[:-1], counts) + np.arange(at[-1])
    out = np.zeros(at[-1], np.uint64)
    for j in range(n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + value[start + j] + _U(1))
    return out, at


def compact_windows(h: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the Cartesian trees of documents' hashes that span ``least`` tokens: first,
    least and last place of each. Of equal hashes the first counts as the least."""
    n = len(h)
    sizes = np.diff(at)
    first, last = np.repeat(at[:-1], sizes), np.repeat(at[1:] - 1, sizes)
    # Only least places of a stretch of ``least`` tokens can be such nodes, and all that bounds them.
    best, reach = np.arange(n), 1
    while reach < least:
        step = min(reach, least - reach)
        other = best[np.minimum(np.arange(n) + step, n - 1)]
        best = np.where((h[other] < h[best]) & (np.arange(n) + step < n), other, best)
        reach += step
    nodes = np.unique(best[np.arange(n) + least - 1 <= last])
    if len(nodes) == 0:
        return nodes, nodes, nodes
    x = h[nodes]
    m = len(nodes)
    fence = first[nodes]
    left, right = np.arange(m) - 1, np.arange(m) + 1
    inside = np.append(False, fence[1:] == fence[:-1])
    left[~inside] = -1
    right[~np.append(inside[1:], False)] = m
    for side, below in ((left, lambda p, i: x[p] > x[i]), (right, lambda p, i: x[p] >= x[i])):
        i = np.arange(m)
        while True:  # each round follows the bound of the bound while it isn't less
            i = i[(side[i] >= 0) & (side[i] < m)]
            i = i[below(side[i], i)]
            if len(i) == 0:
                break
            side[i] = side[side[i]]
    a = np.where(left >= 0, nodes[np.maximum(left, 0)] + 1, fence)
    b = np.where(right < m, nodes[np.minimum(right, m - 1)] - 1, last[nodes])
    wide = b - a + 1 >= least
    return a[wide], nodes[wide], b[wide]


def least_after(h: np.ndarray, last: np.ndarray, far: int) -> np.ndarray:
    """The least hash of the ``far`` tokens after each one, within its document."""
    n = len(h)
    place = np.arange(n)
    best = np.full(n, ~_U(0))
    best[:-1] = np.where(place[:-1] < last[:-1], h[1:], best[:-1])
    reach = 1
    while reach < far:
        step = min(reach, far - reach)
        other = best[np.minimum(place + step, n - 1)]
        best = np.where(place + step <= last, np.minimum(best, other), best)
        reach += step
    return best


def packed(left: np.ndarray, right: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
    """How far windows reach from their least place and the hashes of what is beside it, in 64 bits."""
    most = (1 << REACH) - 1
    out = np.minimum(left, most).astype(np.uint64) << _U(REACH) | np.minimum(right, most).astype(np.uint64)
    for side in sides:
        out = out << _U(SIDE) | side >> _U(64 - SIDE)
    return out.view(np.int64)


def side_of(s: np.ndarray, i: int) -> np.ndarray:
    return s >> (SIDE * i) & ((1 << SIDE) - 1)


def reaches(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = (1 << REACH) - 1
    return s >> (SIDE * 2 * len(BESIDE) + REACH) & most, s >> (SIDE * 2 * len(BESIDE)) & most


def heads(group: np.ndarray, s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of rows in an order, the places (in the order) of the first of each group and of each of
    its parts of one side."""
    group, s = group[order], s[order]
    first = [np.unique(group, return_index=True)[1]]
    for i in range(2 * len(BESIDE)):
        first.append(np.unique(group << SIDE | side_of(s, i), return_index=True)[1])
    return np.unique(np.concatenate(first))


def parted(columns: list[np.ndarray], salt: int) -> list[np.ndarray]:
    """Rows (v, id, t, s) in which a v that ``HOT`` rows share is replaced by one of their own;
    the heads of such a group have a row with the v as it was besides."""
    v, ids, t, s = columns
    _, group, many = np.unique(v, return_inverse=True, return_counts=True)
    hot = np.flatnonzero(many[group] >= HOT)
    if len(hot) == 0:
        return columns
    order = np.lexsort((t[hot], ids[hot]))
    top = hot[order[heads(group[hot], s[hot], order)]]
    own = v.copy()
    own[hot] = mix(v[hot].view(np.uint64) ^ mix(np.array([salt], np.uint64))).view(np.int64)
    return [np.concatenate([own, v[top]]), *(np.concatenate([x, x[top]]) for x in (ids, t, s))]


@tidy
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context, sent = TaskContext.get(), 0
    task = (context.partitionId() if context else 0) << 32
    least = LEAST - SHINGLE + 1
    held: list[list[np.ndarray]] = []

    def flushed() -> pa.RecordBatch:
        rows = parted([np.concatenate(c) for c in zip(*held, strict=True)], task + sent)
        held.clear()
        return pa.record_batch([pa.array(c) for c in rows], ["v", "id", "t", "s"])

    for batch in batches:
        data, offsets = buffers(batch.column(2))
        every, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, j in slices(offsets):
            _, _, value, bounds = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            token, at = shingles(value, bounds, SHINGLE)
            sizes = np.diff(at)
            last, turned = np.repeat(at[1:] - 1, sizes), np.repeat(at[-1] - 1 - at[:-1], sizes)[::-1]
            beside = [x for far in BESIDE for x in (least_after(token[::-1], turned, far)[::-1], least_after(token, last, far))]
            for f in range(HASHES):
                h = mix(token + _U(0x632BE59BD9B4E019 * (f + 1) & 0xFFFFFFFFFFFFFFFF))
                a, c, b = compact_windows(h, at, least)
                doc = i + np.searchsorted(at, c, "right") - 1
                held.append([mix(h[c] + _U(f)).view(np.int64), every[doc], texts[doc], packed(c - a, b - c, [mix(x[c]) for x in beside])])
            if sum(len(x[0]) for x in held) >= HELD:
                yield flushed()
                sent += 1
    if held:
        yield flushed()


def links(v: np.ndarray, ids: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by v and id: pairs of places (x, y) of which y is the first row, or the last
    of a lesser id, of x's group or of a part of it with a side in common, and whose windows
    intersect in a passage; and the places that later rows of the last group can be linked to."""
    run = np.cumsum(np.append(True, v[1:] != v[:-1])) - 1 if len(v) else np.zeros(0, np.int64)
    some = np.flatnonzero(np.bincount(run)[run] > 1) if len(v) else run
    xs, ys, left = [], [], [np.zeros(0, np.int64)]
    tail = len(v) and run[-1]
    for i in range(-1, 2 * len(BESIDE)):
        key = run[some] if i < 0 else run[some] << SIDE | side_of(s[some], i)
        order = some if i < 0 else some[np.argsort(key, kind="stable")]
        key = key if i < 0 else np.sort(key, kind="stable")
        n = len(order)
        place = np.arange(n)
        new = np.append(True, key[1:] != key[:-1])[:n]
        new_id = new | np.append(True, ids[order][1:] != ids[order][:-1])[:n]
        start = np.maximum.accumulate(np.where(new, place, 0))
        before = np.maximum.accumulate(np.where(new_id, place, 0)) - 1
        ok = before >= start
        for other in (start, before):
            xs.append(order[ok])
            ys.append(order[other[ok]])
        end = np.append(new[1:], True)[:n]
        keep = np.concatenate([place[new], place[end], before[end & ok]])
        left.append(order[keep])
    x, y = np.concatenate(xs), np.concatenate(ys)
    (xl, xr), (yl, yr) = reaches(s[x]), reaches(s[y])
    meet = np.minimum(xl, yl) + np.minimum(xr, yr) + 1 >= LEAST - 2 * SHINGLE
    left = np.unique(np.concatenate(left))
    left = left[run[left] == tail]
    if len(left) == 0 and len(v):
        left = np.flatnonzero(run == tail)
    return x[meet], y[meet], left


@tidy
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked documents and how much speaks for them (1 for a link, 2 for one that agrees in a
    side), from rows sorted by v and id, in blocks; of a group that goes on in the next block
    only the rows that can still be linked to are kept."""
    old = [np.zeros(0, np.int64)] * 4
    held: list[list[np.ndarray]] = []

    def block() -> pa.RecordBatch:
        nonlocal old
        v, ids, t, s = (np.concatenate([o, *c]) for o, c in zip(old, zip(*held, strict=True), strict=True))
        x, y, left = links(v, ids, s)
        x, y = x[x >= len(old[0])], y[x >= len(old[0])]
        pair = mix(mix(ids[x].view(np.uint64) + mix(t[x].view(np.uint64))) + mix(mix(ids[y].view(np.uint64)) + t[y].view(np.uint64)))
        _, once = np.unique(mix(pair + mix(v[x].view(np.uint64))), return_index=True)
        x, y, pair = x[once], y[once], pair[once]
        beside = np.zeros(len(x), bool)
        for i in range(2 * len(BESIDE)):
            beside |= side_of(s[x], i) == side_of(s[y], i)
        _, once, which = np.unique(pair, return_index=True, return_inverse=True)
        votes = np.bincount(which, 1 + beside, len(once)).astype(np.int64)
        x, y = x[once], y[once]
        old = [c[left] for c in (v, ids, t, s)]
        held.clear()
        return pa.record_batch([pa.array(c) for c in (ids[x], t[x], ids[y], t[y], votes)], ["x", "xt", "y", "yt", "votes"])

    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in range(4)])
        if sum(len(c[0]) for c in held) >= BLOCK:
            yield block()
    if held:
        yield block()


def _cut(value: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return np.split(value, bounds[1:-1])


def shared_runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of words of ``x`` (first, after the last, matched words, first place in ``y``) of
    ``LEAST`` words at least that are made of word sequences that ``y`` has."""
    (p, _), (q, _) = (shingles(z, np.array([0, len(z)]), EXACT) for z in (x, y))
    order = np.argsort(q, kind="stable")
    return _runs(p, q[order], order)


def _runs(p: np.ndarray, q: np.ndarray, order: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The shared runs, from the sequences of one text and the sorted ones of another with their places."""
    if len(p) + EXACT - 1 < LEAST or len(q) + EXACT - 1 < LEAST:
        return []
    spot = np.minimum(np.searchsorted(q, p), len(q) - 1)
    hit = np.flatnonzero(q[spot] == p)
    if len(hit) == 0:
        return []
    cover = np.zeros(len(p) + EXACT, np.int64)
    cover[hit] += 1
    cover[hit + EXACT] -= 1
    covered = np.cumsum(cover)[:-1] > 0
    place = np.flatnonzero(covered)
    cut = np.flatnonzero(np.diff(place) > GAP + 1)
    starts, ends = place[np.append(0, cut + 1)], place[np.append(cut, len(place) - 1)] + 1
    long = np.flatnonzero(ends - starts >= LEAST)
    out = []
    if len(long):
        total = np.concatenate([[0], np.cumsum(covered)])
    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        matched = int(total[e] - total[s])
        if matched >= DENSE * (e - s):
            at = hit[np.searchsorted(hit, s)]
            out.append((s, e, matched, int(order[spot[at]])))
    return out


def _characters(data: bytes, places: list[int]) -> list[int]:
    """Byte places as character places."""
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return before[places].tolist()


SPANS = "doc_id bigint, t bigint, begin_char int, end_char int, n_words int, matched_words int, source_doc_id bigint, source_begin_char int"


class _Texts:
    """The texts of some pairs, each taken apart once."""

    def __init__(self, packed: list[bytes]) -> None:
        self.raw = [zlib.decompress(x) for x in packed]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.raw])]).astype(np.int64)
        begins, ends, bounds, self.parts = [], [], [np.zeros(1, np.int64)], []
        for i, j in slices(self.offsets):
            at = self.offsets[i]
            begin, end, value, own = words(np.frombuffer(b"".join(self.raw[i:j]), np.uint8), self.offsets[i : j + 1] - at)
            begins.append(begin + at)
            ends.append(end + at)
            self.parts += _cut(*shingles(value, own, EXACT))
            bounds.append(own[1:] + bounds[-1][-1])
        self.begin, self.end, self.bounds = np.concatenate(begins), np.concatenate(ends), np.concatenate(bounds)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ordered(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        if r not in self.sorted:
            order = np.argsort(self.parts[r], kind="stable")
            self.sorted[r] = self.parts[r][order], order
        return self.sorted[r]

    def characters(self, r: int, first: list[int], last: list[int] = ()) -> tuple[list[int], list[int]]:
        """The places of words' first characters, and after words' last ones, in a text."""
        base, at = self.bounds[r], self.offsets[r]
        found = _characters(self.raw[r], [int(self.begin[base + w] - at) for w in first] + [int(self.end[base + w] - at) for w in last])
        return found[: len(first)], found[len(first) :]


@tidy
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [s.split()[0] for s in SPANS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    numbers: dict[tuple[int, int], int] = {}
    packed: list[bytes] = []
    pairs: list[tuple[int, int]] = []

    def judged() -> pa.RecordBatch:
        texts, keys, out = _Texts(packed), list(numbers), []
        for x, y in pairs:
            runs = _runs(texts.parts[x], *texts.ordered(y))
            if runs:
                begin, end = texts.characters(x, [s for s, *_ in runs], [e - 1 for _, e, *_ in runs])
                source, _ = texts.characters(y, [p for *_, p in runs])
                out += [(*keys[x], b, e, run[1] - run[0], run[2], keys[y][0], s) for run, b, e, s in zip(runs, begin, end, source, strict=True)]
        for held in (numbers, packed, pairs):
            held.clear()
        return pa.record_batch([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names)

    def number(key: tuple[int, int], text: pa.Scalar) -> int:
        if key not in numbers:
            numbers[key] = len(packed)
            packed.append(text.as_buffer().to_pybytes())
        return numbers[key]

    size = 0
    for batch in batches:
        x, xt, y, yt = (batch.column(c).to_pylist() for c in ("x", "xt", "y", "yt"))
        xs, ys = batch.column("x_text"), batch.column("y_text")
        for r in range(batch.num_rows):
            before = len(packed)
            pairs.append((number((x[r], xt[r]), xs[r]), number((y[r], yt[r]), ys[r])))
            size += sum(map(len, packed[before:]))
            if size >= SLICE // 2:
                yield judged()
                size = 0
    if pairs:
        yield judged()


@tidy
def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they are shuffled: once for all pairs of a document."""
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        raw = [zlib.compress(data[offsets[r] : offsets[r + 1]], 1) for r in range(batch.num_rows)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["id", "t", "text"])


def rounds_of(pairs: DataFrame, small: DataFrame) -> int:
    """Rounds in which pairs (x, xt) send about as many bytes each as the texts (id, t, size) have."""
    every = small.agg(F.sum("size")).first()[0] or 1
    sent = pairs.groupBy(F.col("x").alias("id"), F.col("xt").alias("t")).count().join(small.select("id", "t", "size"), ["id", "t"]).agg(F.sum(F.col("count") * F.col("size"))).first()[0] or 0
    return max(1, math.ceil(sent / every))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``SPANS`` of the texts of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).where("id is not null and text is not null")
    windows = texts.mapInArrow(_windows, "v bigint, id bigint, t bigint, s bigint").repartition(parts, "v").sortWithinPartitions("v", "id", "t")
    pairs = windows.mapInArrow(_linked, "x bigint, xt bigint, y bigint, yt bigint, votes bigint")
    pairs = checkpointed(pairs.groupBy("x", "xt", "y", "yt").agg(F.sum("votes").alias("votes")).where("votes > 1").drop("votes"))
    asked = pairs.select(F.col("x").alias("id"), F.col("xt").alias("t")).union(pairs.select("y", "yt")).distinct()
    small = texts.mapInArrow(_compressed, "id bigint, t bigint, text binary").join(asked, ["id", "t"], "left_semi").dropDuplicates(["id", "t"])
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    written(small.withColumn("size", F.octet_length("text")), folder)
    try:
        small = spark.read.parquet(folder)
        every, found = rounds_of(pairs, small), None
        for r in range(every):
            own = pairs.where(F.pmod(F.xxhash64("x", "xt"), F.lit(every)) == r)
            met = own.join(small.select(F.col("id").alias("x"), F.col("t").alias("xt"), F.col("text").alias("x_text")), ["x", "xt"])
            met = met.join(small.select(F.col("id").alias("y"), F.col("t").alias("yt"), F.col("text").alias("y_text")), ["y", "yt"])
            spans = checkpointed(met.mapInArrow(_compared, SPANS))
            found = spans if found is None else found.union(spans)
        return found
    finally:
        removed(spark, folder)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin_char, end_char, n_words, matched_words, source_doc_id and
    source_begin_char: the characters begin_char to end_char (exclusive, from 0) of a document
    repeat a passage of an earlier one (of lesser id), where it begins at source_begin_char.

    A passage has ``LEAST`` words at least, of which ``DENSE`` are in shared 5-word sequences.
    A document of the same words as an earlier one is one passage (if it has so many words). Texts that are null, empty or short and rows
    without an id have no passages; repeated rows of an id count once. Several texts of one id
    are told apart: each is searched, none for what another one of its id has. Repeats within a document are
    not reported; other columns are not read. A passage may be reported with several sources.
    """
    return _spans(docs, id_col, text_col).drop("t").distinct()


def passages_removed(docs: DataFrame) -> DataFrame:
    """``docs``, with their columns, whatever their names, without the repeated passages: the earliest document of a
    passage keeps it. A text loses its own passages only, not those of another text of its id. Rows
    of which nothing but blanks and signs is left go; other rows stay, repeated ones too.
    n_chars, if there is such a column, is brought up to date."""
    of, own, cuts = fresh(docs.columns, "of", "own", "cuts")
    spans = _spans(docs, "doc_id", "text").groupBy(F.col("doc_id").alias(of), F.col("t").alias(own)).agg(F.sort_array(F.collect_set(F.struct("begin_char", "end_char"))).alias(cuts))
    same = (docs["doc_id"].cast("bigint") == spans[of]) & (F.xxhash64(docs["text"].cast("string")) == spans[own])
    joined = docs.join(spans, same, "left").drop(of, own)
    names = docs.columns
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = np.flatnonzero(batch.column(cuts).is_valid().to_numpy(zero_copy_only=False))
            columns = batch.columns[:-1]
            if len(cut) == 0:
                yield pa.record_batch(columns, names)
                continue
            texts, keep = columns[at].to_pylist(), np.ones(batch.num_rows, bool)
            sizes = columns[names.index("n_chars")].to_pylist() if "n_chars" in names else None
            for r in cut.tolist():
                text, left, done = texts[r], [], 0
                if text is None:
                    continue
                for span in batch.column(cuts)[r].as_py():
                    left.append(text[done : max(done, span["begin_char"])])
                    done = max(done, span["end_char"])
                texts[r] = "".join([*left, text[done:]]).strip()
                keep[r] = any(c.isalnum() for c in texts[r])
                if sizes is not None:
                    sizes[r] = len(texts[r])
            columns[at] = pa.array(texts, columns[at].type)
            if sizes is not None:
                columns[names.index("n_chars")] = pa.array(sizes, columns[names.index("n_chars")].type)
            yield pa.record_batch(columns, names).filter(pa.array(keep))

    return joined.select(*names, cuts).mapInArrow(work, docs.schema)
