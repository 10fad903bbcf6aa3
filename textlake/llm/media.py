"""Media columns: tracks, durations and keyframe byte ranges of ISO media containers.

The boxes of a container are walked and its sample tables decoded; payloads are never
touched. ``written`` builds small containers of every layout for tests, and
``documents_as_media`` a media column from a table that has none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts"}
SCHEMA = "media_id bigint, track_id bigint, handler string, codec string, timescale bigint, duration bigint, n_samples bigint, n_keyframes bigint, keyframes array<struct<byte_offset:bigint,byte_length:bigint>>, error string"
_ARROW = pa.schema([("media_id", pa.int64()), ("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", pa.list_(pa.struct([("byte_offset", pa.int64()), ("byte_length", pa.int64())]))), ("error", pa.string())])


class Malformed(ValueError):
    """A container that contradicts itself."""


def boxes(data: memoryview, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the body, byte after it) of the boxes of a range."""
    at = begin
    while at < end:
        if end - at < 8:
            raise Malformed("bytes after the last box")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Malformed("a long box is cut off")
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        elif size == 0:  # to the end
            size = end - at
        if size < head or at + size > end:
            raise Malformed(f"box {kind.decode('latin-1')} leaves its range")
        yield kind, at + head, at + size
        at += size


def _table(data: memoryview, begin: int, end: int, skip: int, kind: str, columns: int) -> np.ndarray:
    """Rows of a full box that holds a count at ``skip`` and rows after it."""
    if end - begin < skip + 4:
        raise Malformed("a table is cut off")
    (n,) = struct.unpack_from(">I", data, begin + skip)
    width = np.dtype(kind).itemsize * columns
    if begin + skip + 4 + n * width > end:
        raise Malformed("a table is cut off")
    return np.frombuffer(data, kind, n * columns, begin + skip + 4).astype(np.int64).reshape(n, columns)


def _sized(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return table[:, 0], table[:, 1]


def _track(data: memoryview, begin: int, end: int) -> dict:
    found: dict[bytes, tuple[int, int]] = {}

    def walk(lo: int, hi: int, depth: int) -> None:
        for kind, a, b in boxes(data, lo, hi):
            if kind in CONTAINERS and depth < 16:
                walk(a, b, depth + 1)
            else:
                found.setdefault(kind, (a, b))

    walk(begin, end, 0)

    def read(kind: bytes, form: str, skip: int = 0) -> tuple:
        if kind not in found:
            raise Malformed(f"no {kind.decode()} box")
        a, b = found[kind]
        if b - a < skip + struct.calcsize(form):
            raise Malformed(f"box {kind.decode()} is cut off")
        return struct.unpack_from(form, data, a + skip)

    (version,) = read(b"tkhd", ">B")
    (track_id,) = read(b"tkhd", ">I", 20 if version == 1 else 12)
    (version,) = read(b"mdhd", ">B")
    timescale, duration = read(b"mdhd", ">IQ", 20) if version == 1 else read(b"mdhd", ">II", 12)
    (handler,) = read(b"hdlr", ">4s", 8)
    (entries,) = read(b"stsd", ">I", 4)
    codec = read(b"stsd", ">4s", 12)[0].decode("latin-1") if entries else None

    sizes: np.ndarray | None = None  # None where all samples have the same size: then nothing is made for each
    size = 0
    if b"stsz" in found:
        size, n = read(b"stsz", ">II", 4)
        if not size:
            sizes = _table(data, *found[b"stsz"], 8, ">u4", 1)[:, 0]
    elif b"stz2" in found:
        width, n = read(b"stz2", ">BI", 7)
        if width in (8, 16):
            sizes = _table(data, *found[b"stz2"], 8, f">u{width // 8}", 1)[:, 0]
        elif width == 4:
            a, b = found[b"stz2"]
            if b - a - 12 < (n + 1) // 2:
                raise Malformed("a table is cut off")
            pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12).astype(np.int64)
            sizes = np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:n]
        else:
            raise Malformed("sizes of an unknown width")
    else:
        raise Malformed("no sizes")
    if b"co64" in found:
        chunks = _table(data, *found[b"co64"], 4, ">u8", 1)[:, 0]
    elif b"stco" in found:
        chunks = _table(data, *found[b"stco"], 4, ">u4", 1)[:, 0]
    else:
        raise Malformed("no chunk offsets")
    runs = _table(data, *found[b"stsc"], 4, ">u4", 3) if b"stsc" in found else np.zeros((0, 3), np.int64)
    per = np.zeros(len(chunks), np.int64)
    if n:
        if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
            raise Malformed("chunks and their runs differ")
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        if per.sum() != n:
            raise Malformed("chunks and sizes differ")
    count, delta = _sized(_table(data, *found[b"stts"], 4, ">u4", 2)) if b"stts" in found else (np.zeros(0, np.int64),) * 2
    if count.sum() != n:
        raise Malformed("times and sizes differ")
    if not duration or duration in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF):
        duration = int((count * delta).sum())
    total = None if sizes is None else np.concatenate([[0], np.cumsum(sizes)])
    before = lambda i: i * size if total is None else total[i]  # noqa: E731  bytes of the samples before one
    edges = np.concatenate([[0], np.cumsum(per)])
    if b"stss" in found:
        keys = _table(data, *found[b"stss"], 4, ">u4", 1)[:, 0] - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= n or (np.diff(keys) <= 0).any()):
            raise Malformed("keyframes outside the samples")
        chunk = np.searchsorted(edges, keys, "right") - 1
        start, length, follows, n_keys = chunks[chunk] + before(keys) - before(edges[chunk]), before(keys + 1) - before(keys), np.diff(keys) == 1, len(keys)
    else:  # all are keyframes: a chunk is a range
        some = np.flatnonzero(per)
        start, length, n_keys = chunks[some], before(edges[some + 1]) - before(edges[some]), n
        follows = np.ones(max(0, len(some) - 1), bool)
    if len(start):  # keyframes that follow each other in time and in the file are one range
        new = np.append(True, ~follows | (start[1:] != start[:-1] + length[:-1]))
        first = np.flatnonzero(new)
        length, start = np.add.reduceat(length, first), start[first]
    return {"track_id": track_id, "handler": handler.decode("latin-1"), "codec": codec, "timescale": timescale, "duration": duration, "n_samples": n, "n_keyframes": n_keys, "keyframes": [{"byte_offset": a, "byte_length": b} for a, b in zip(start.tolist(), length.tolist(), strict=True)], "error": None}


def tracks(data: bytes | None) -> list[dict]:
    """A row for each track; for a container that can't be read, or has none, one row with
    an error."""
    if data is None:
        return [{"error": "null"}]
    if not data:
        return [{"error": "empty"}]
    view, out = memoryview(data), []
    try:
        for kind, a, b in boxes(view, 0, len(view)):
            if kind == b"moov":
                for inner, c, d in boxes(view, a, b):
                    if inner == b"trak":
                        try:
                            out.append(_track(view, c, d))
                        except Malformed as error:
                            out.append({"error": str(error)})
    except Malformed as error:
        out.append({"error": str(error)})
    return out or [{"error": "no track"}]


def media_columns(media: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """Columns of ``SCHEMA``: a row for each track of each container in the binary column.

    Keyframe ranges that adjoin are one; a track without a sync table has only keyframes. A
    null or empty container, one without tracks and one that contradicts itself give a row
    with ``error`` and nulls, beside the tracks read before it. Repeated rows give repeated
    rows, null ids stay, other columns are not read. Fragments (moof) have no sample tables
    and are not decoded. One pass without a shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for media_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buffer = data.as_buffer() if data.is_valid else None
                rows += [{"media_id": media_id} | row for row in tracks(buffer)]
                held += 1
                if held % 2048 == 0:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return media.select(F.col(id_col).cast("bigint").alias("media_id"), F.col(data_col).alias("data")).mapInArrow(work, SCHEMA)


def box(kind: bytes, *parts: bytes, long: bool = False) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if long else struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24), *parts)


def track_box(track_id: int, handler: bytes, codec: bytes, timescale: int, times: list[tuple[int, int]], sizes: np.ndarray | tuple[int, int], chunks: np.ndarray, runs: list[tuple[int, int]], keys: np.ndarray | None = None, wide: bool = False) -> bytes:
    """A trak box; ``sizes`` is an array, or (size, count) where all are the same."""
    duration = sum(n * d for n, d in times)
    table = lambda rows: struct.pack(">I", len(rows)) + np.asarray(rows, ">u4").tobytes()
    stsz = struct.pack(">II", *sizes) if isinstance(sizes, tuple) else struct.pack(">II", 0, len(sizes)) + sizes.astype(">u4").tobytes()
    stbl = [
        _full(b"stsd", struct.pack(">I", 1), box(codec, bytes(78))),
        _full(b"stts", table(times)),
        _full(b"stsc", table([(first, n, 1) for first, n in runs])),
        _full(b"stsz", stsz),
        _full(b"co64", struct.pack(">I", len(chunks)), chunks.astype(">u8").tobytes()) if wide else _full(b"stco", table(chunks)),
    ]
    if keys is not None:
        stbl.append(_full(b"stss", table(keys + 1)))
    tkhd = _full(b"tkhd", struct.pack(">QQI", 0, 0, track_id) if wide else struct.pack(">III", 0, 0, track_id), bytes(60), version=int(wide))
    mdhd = _full(b"mdhd", struct.pack(">QQIQI", 0, 0, timescale, duration, 0) if wide else struct.pack(">IIIII", 0, 0, timescale, duration, 0), version=int(wide))
    hdlr = _full(b"hdlr", struct.pack(">I4s", 0, handler), bytes(13))
    return box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", *stbl))))


#: Layout of ``written``.
SAMPLE, KEY_EVERY, PER_CHUNK, AUDIO = 512, 5, 4, 16


def written(number: int, payload: bytes) -> bytes:
    """A container with a video track, whose samples are the payload, and an audio track."""
    n = -(-len(payload) // SAMPLE)
    long, wide = number % 5 == 0, number % 7 == 0
    ftyp = box(b"ftyp", b"isom", bytes(4), b"isomiso2")
    first = len(ftyp) + (16 if long else 8)
    sizes = np.full(n, SAMPLE, np.int64)
    if n:
        sizes[-1] = len(payload) - SAMPLE * (n - 1)
    full, rest = divmod(n, PER_CHUNK)
    runs = [(1, PER_CHUNK)] * (full > 0) + [(full + 1, rest)] * (rest > 0)
    codec = (b"avc1", b"hvc1", b"av01")[number % 3]
    video = track_box(1, b"vide", codec, 600, [(n - 1, 20), (1, 25)][n < 2 :] if n else [], sizes, first + SAMPLE * PER_CHUNK * np.arange(full + (rest > 0)), runs, np.arange(0, n, KEY_EVERY), wide)
    m = -(-len(payload) // (2 * SAMPLE))
    audio = track_box(2, b"soun", b"mp4a", 48000, [(m, 1024)] if m else [], (AUDIO, m), first + len(payload) + np.zeros(int(m > 0), np.int64), [(1, m)] if m else [])
    return ftyp + box(b"mdat", payload, bytes(AUDIO * m), long=long) + box(b"moov", _full(b"mvhd", bytes(96)), video, audio)


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_id and data: each text's bytes as the samples of a container; null for null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                ids, texts = batch.column(0).slice(i, 1024), batch.column(1).slice(i, 1024)
                data = [None if text is None else written(number or 0, text) for number, text in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
                yield pa.record_batch([ids, pa.array(data, pa.binary())], ["media_id", "data"])

    return docs.select(F.col(id_col).cast("bigint").alias("media_id"), F.encode(F.col(text_col), "UTF-8").alias("data")).mapInArrow(work, "media_id bigint, data binary")
