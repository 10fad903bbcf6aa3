"""Byte-level BPE encoding and decoding through a sentencepiece model built from a vocabulary.

No tokenizer is trained: the model file is serialised here field by field. Each entry of
the vocabulary becomes a piece spelled in the usual printable stand-ins for bytes, with the
negative of its rank as score, so that the best-scored merge is the earliest one. The
normaliser is the identity. A blank, which no piece contains, is a piece of its own: a
text's pre-tokens joined by blanks are encoded in one call and no merge crosses a blank.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import small_batches, tidy
from .pretokens import cuts, distinct
from .textcore import buffers, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """The model file: ids are ranks; then come the blank and the unknown piece."""
    letters = byte_alphabet()
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    normal, unknown, own = 1, 2, 4
    pieces = [("".join(letters[b] for b in token), -float(rank), normal) for rank, token in enumerate(ordered)]
    pieces += [(" ", 0.0, own), ("<unk>", 0.0, unknown)]
    body = b"".join(_field(1, _field(1, text) + _field(2, score) + _field(3, kind)) for text, score, kind in pieces)
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + b"".join(_field(i, (1 << 64) - 1) for i in (41, 42, 43))
    identity = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, identity)


class ByteBPE:
    """Encodes texts to the ids of a vocabulary, and back."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(ranks))
        self.letters = np.array([ord(c) for c in byte_alphabet()], np.uint16)
        self.blank = len(ranks)
        self.spelled = sorted(ranks, key=ranks.__getitem__)

    def _ids(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, laid end to end, and where each one's begin."""
        size = end - begin + 1
        at = np.concatenate([[0], np.cumsum(size)])
        spelled = np.full(at[-1], 32, np.uint16)
        body = np.repeat(begin - at[:-1], size - 1) + np.delete(np.arange(at[-1]), at[1:] - 1)
        spelled[np.delete(np.arange(at[-1]), at[1:] - 1)] = self.letters[data[body]]
        every = []
        step = 2048
        for i in range(0, len(begin), step):
            text = spelled[at[i] : at[min(i + step, len(begin))]].tobytes().decode("utf-16-le")
            every.append(np.array(self.model.encode(text), np.int32))
        ids = np.concatenate(every)
        blank = ids == self.blank
        ends = np.flatnonzero(blank) - np.arange(len(begin))
        return ids[~blank], np.concatenate([[0], ends])

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts laid end to end, and where each text's begin."""
        cut = cuts(data, offsets)
        if len(cut) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        first, which = distinct(data, cut)
        flat, at = self._ids(data, cut[first], np.append(cut, len(data))[first + 1])
        counts = np.diff(at)[which]
        to = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(at[which] - to[:-1], counts) + np.arange(to[-1])]
        return ids, to[np.searchsorted(cut, offsets)]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


_MADE: dict[str, ByteBPE] = {}


def tokenizer(path: str = VOCABULARY) -> ByteBPE:
    """One per worker process and vocabulary file."""
    if path not in _MADE:
        _MADE[path] = ByteBPE(read_ranks(path))
    return _MADE[path]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids, n_tokens and round_trip (decoding gave the same bytes), one row
    for each row of ``docs``; one pass without a shuffle.

    A null text has null ids and n_tokens and a null round_trip; an empty text has none and
    true. Repeated rows give repeated rows; null ids stay; other columns are not read.
    """

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            missing = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, to = bpe.encode_all(part, at)
                null, each = missing[i:j], ids.tolist()
                same = pa.array([bpe.decode(each[to[r] : to[r + 1]]) == part[at[r] : at[r + 1]].tobytes() for r in range(j - i)], pa.bool_(), mask=null)
                to = to.astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(to, mask=np.append(null, False)) if null.any() else pa.array(to), pa.array(ids))
                yield pa.record_batch([batch.column(0).slice(i, j - i), lists, pa.array(np.diff(to), mask=null), same], ["doc_id", "token_ids", "n_tokens", "round_trip"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id bigint, token_ids array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and text of ``encode``'s rows; null ids give a null text. Ids that don't spell
    UTF-8 give the replacement character, ids outside the vocabulary an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(work, "doc_id bigint, text string")
