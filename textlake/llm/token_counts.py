"""Token counts from a compiled tokenizer: a deterministic transducer over bytes.

Byte-pair merging is compiled into a transducer that is determinised as it is used. The
tokens of a prefix are a shorter prefix's tokens and one last token, and two tokens can stand
side by side exactly if merging their joined bytes gives these two. So it is enough that a
state holds, for each recent position from which a vocabulary entry can still grow, the
grown bytes, the last token there and the count of tokens there relative to now. Each
transition is annotated with the change in the count of emitted tokens (a merge may take
back tokens). Pre-tokens are cut by a second transducer, an explicit table over character
classes, which says for each transition whether a pre-token begins.

Texts of more than ``CHUNK`` characters are cut into chunks, which are counted wherever there is room. A
chunk's map from the states it may be entered in to the states it may be left in, with the
tokens emitted on the way, is kept in closed form (``ChunkMap``): between its first and last
certain boundary the map is a constant count, before and after it the bytes decide. Maps
compose associatively, so a text's maps come together in a balanced prefix scan, in any grouping.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, read_ranks
from .cluster import whole_groups
from .pretokens import cuts, distinct
from .textcore import SLICE, buffers, slices

#: Characters of a chunk.
CHUNK = 1 << 16
#: States and composed transitions a worker keeps; when there are more, it starts anew.
STATES, LEAPS = 180_000, 500_000
#: Bytes whose composed transitions are kept as one.
LEAP = 3


class Transducer:
    """Byte-pair merging, compiled."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.growing = {token[:i] for token in ranks for i in range(1, len(token))}
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        self.clear()

    def clear(self) -> None:
        """Forgets the states made so far; results don't depend on it."""
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        start = ((b"", None, 0),)
        self.states, self.numbers = [start], {start: 0}
        self.next: dict[int, tuple[int, int]] = {}
        self.leaps: dict[tuple[int, bytes], tuple[int, int]] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """The tokens of a short text, by merging: the definition."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1))
            if best == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens that the last merge within a token joins; a byte twice itself."""
        if (known := self.split.get(token)) is None:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.split[token] = (parts[0], parts[-1])
        return known

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether merging the joined bytes gives these two tokens: no merge across the seam
        may come before the merges that made its two sides, which are undone latest first."""
        key = (left, right)
        if (known := self.beside.get(key)) is not None:
            return known
        ranks, limit = self.ranks, len(self.ranks)
        while True:
            if ranks.get(left + right, limit) < limit:
                fits = False
                break
            a, b = ranks[left], ranks[right]
            if len(left) > 1 and (a > b or len(right) == 1):
                limit, left = a, self.halves(left)[1]
            elif len(right) > 1:
                limit, right = b + 1, self.halves(right)[0]
            else:
                fits = True
                break
        self.beside[key] = fits
        return fits

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte and the change in the count of tokens."""
        add, found, grown_now = bytes((byte,)), None, []
        ranks, growing = self.ranks, self.growing
        for grown, last, count in self.states[state]:  # longest first
            token = grown + add
            if found is None and token in ranks and (last is None or self.fits(last, token)):
                found, delta = token, count + 1
            if token in growing:
                grown_now.append((token, last, count))
        if found is None:
            raise ValueError("a byte is missing from the vocabulary")
        new = (*((token, last, count - delta) for token, last, count in grown_now), (b"", found, 0))
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
        self.next[state << 8 | byte] = out = number, delta
        return out

    def leap(self, state: int, text: bytes) -> tuple[int, int]:
        """The transitions of a few bytes, composed."""
        key, total, get = (state, text), 0, self.next.get
        for byte in text:
            state, delta = get(state << 8 | byte) or self.step(state, byte)
            total += delta
        self.leaps[key] = out = state, total
        return out

    def count(self, text: bytes) -> int:
        state, total, get = 0, 0, self.leaps.get
        for i in range(0, len(text), LEAP):
            part = text[i : i + LEAP]
            state, delta = get((state, part)) or self.leap(state, part)
            total += delta
        if len(self.states) > STATES or len(self.leaps) > LEAPS:
            self.clear()
        return total


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does, whatever state it is entered in. ``tail`` is None for a chunk
    without a certain boundary; then ``head`` is its whole text."""

    head: str
    count: int = 0
    tail: str | None = None


class Counter:
    """Counts tokens of texts with the vocabulary's transducer."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        self.transducer = Transducer(ranks)
        boundary = r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?= [\p{L}\p{N}])"
        self.first, self.last = regex.compile(boundary), regex.compile("(?r)" + boundary)

    def each(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each of the texts laid end to end. Both ends of a text are boundaries."""
        cut = cuts(data, offsets)
        if len(cut) == 0:
            return np.zeros(len(offsets) - 1, np.int64)
        first, which = distinct(data, cut)
        raw, count = data.tobytes(), self.transducer.count
        begin, end = cut[first].tolist(), np.append(cut, len(data))[first + 1].tolist()
        counts = np.fromiter((count(raw[i:j]) for i, j in zip(begin, end, strict=True)), np.int64, len(begin))[which]
        return np.diff(np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(cut, offsets)])

    def of(self, text: str) -> int:
        data = np.frombuffer(text.encode(), np.uint8)
        return int(self.each(data, np.array([0, len(data)]))[0])

    def chunk(self, text: str) -> ChunkMap:
        """A letter, digit or sign before a blank and a letter or digit after it: there a
        pre-token ends, whatever comes before and after."""
        first = self.first.search(text)
        if first is None:
            return ChunkMap(text)
        i, j = first.start(), self.last.search(text).start()
        return ChunkMap(text[:i], self.of(text[i:j]), text[j:])

    def joined(self, left: ChunkMap, right: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks; associative."""
        if left.tail is None:
            seam = self.chunk(left.head + right.head)
        else:
            seam = self.chunk(left.tail + right.head)
        if seam.tail is None:  # still no boundary between them
            if left.tail is None:
                return ChunkMap(seam.head, right.count, right.tail)
            if right.tail is None:
                return ChunkMap(left.head, left.count, seam.head)
            return ChunkMap(left.head, left.count + self.of(seam.head) + right.count, right.tail)
        head, count = seam.head, seam.count
        if left.tail is not None:
            head, count = left.head, left.count + self.of(seam.head) + seam.count
        if right.tail is None:
            return ChunkMap(head, count, seam.tail)
        return ChunkMap(head, count + self.of(seam.tail) + right.count, right.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """All maps composed, pair by pair in a balanced tree."""
        while len(maps) > 1:
            pairs = [self.joined(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0] if maps else ChunkMap("")

    def total(self, whole: ChunkMap) -> int:
        return self.of(whole.head) + whole.count + (self.of(whole.tail) if whole.tail else 0)

    def count(self, text: str, size: int = CHUNK) -> int:
        return self.total(self.scan([self.chunk(text[i : i + size]) for i in range(0, len(text), size)]))


_MADE: dict[str, Counter] = {}


def counter(path: str = VOCABULARY) -> Counter:
    if path not in _MADE:
        _MADE[path] = Counter(read_ranks(path))
    return _MADE[path]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            text = batch.column(2)[r].as_py()
            parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
            n = len(parts)
            yield pa.record_batch([batch.column(0).take(pa.array([r] * n)), batch.column(1).take(pa.array([r] * n)), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], ["id", "t", "no", "piece"])


def _long_counts(texts: DataFrame, vocabulary: str) -> DataFrame:
    """id, t and n_tokens of texts (id, t, text), chunk by chunk."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = texts.mapInArrow(_pieces, "id bigint, t bigint, no int, piece string").repartition(parts, "id", "t", "no")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            maps = [tokens.chunk(x) for x in batch.column(3).to_pylist()]
            columns = [pa.array([getattr(m, c) for m in maps], kind) for c, kind in (("head", pa.string()), ("count", pa.int64()), ("tail", pa.string()))]
            yield pa.record_batch([*batch.columns[:3], *columns], ["id", "t", "no", "head", "count", "tail"])

    def scanned(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        of: dict[tuple, list[ChunkMap]] = {}
        for row in table.to_pylist():
            of.setdefault((row["id"], row["t"]), []).append(ChunkMap(row["head"], row["count"], row["tail"]))
        counts = [tokens.total(tokens.scan(maps)) for maps in of.values()]
        yield pa.record_batch([pa.array([k[0] for k in of], pa.int64()), pa.array([k[1] for k in of], pa.int64()), pa.array(counts, pa.int64())], ["id", "t", "n"])

    maps = pieces.mapInArrow(mapped, "id bigint, t bigint, no int, head string, count bigint, tail string")
    return maps.repartition(parts, "id", "t").sortWithinPartitions("id", "t", "no").mapInArrow(lambda batches: whole_groups(batches, ["id", "t"], scanned), "id bigint, t bigint, n bigint")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens, exactly as many as the vocabulary's encoder gives, one row for
    each row of ``docs``. Only texts of more than ``CHUNK`` characters are shuffled, in chunks.

    A null text has a null count, an empty one 0. Repeated rows give repeated rows; null ids
    stay; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            counts = np.zeros(batch.num_rows, np.int64)
            for i, j in slices(offsets, 4 * SLICE):
                counts[i:j] = tokens.each(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.record_batch([batch.column(0), pa.array(counts, mask=null)], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    short = rows.where((F.length("text") <= CHUNK) | F.col("text").isNull()).mapInArrow(work, "doc_id bigint, n_tokens bigint")
    long = rows.where(F.length("text") > CHUNK).withColumn("of", F.xxhash64("text"))
    counted = _long_counts(long.select(F.col("doc_id").alias("id"), F.col("of").alias("t"), "text").dropDuplicates(["id", "t"]), vocabulary)
    return short.union(long.select("doc_id", "of").join(counted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("of") == F.col("t"))).select("doc_id", F.col("n").alias("n_tokens")))
