import struct

import numpy as np

from textlake.llm import media


def test_written_containers_read_back():
    for number in range(12):
        for size in (0, 1, 511, 512, 513, 5000, 20_000):
            payload = bytes(range(256)) * (size // 256 + 1)
            payload = payload[:size]
            data = media.written(number, payload)
            video, audio = media.tracks(data)
            n = -(-size // media.SAMPLE)
            assert video["error"] is None and video["n_samples"] == n and video["handler"] == "vide" and audio["codec"] == "mp4a"
            assert video["n_keyframes"] == -(-n // media.KEY_EVERY)
            for k, r in enumerate(video["keyframes"]):
                at = k * media.KEY_EVERY * media.SAMPLE
                assert data[r["byte_offset"] : r["byte_offset"] + r["byte_length"]] == payload[at : at + media.SAMPLE]
            assert sum(r["byte_length"] for r in audio["keyframes"]) == media.AUDIO * audio["n_samples"]


def test_sample_tables():
    """Uneven chunks and a nibble size table, offsets worked out by hand."""
    trak = media.track_box(7, b"vide", b"hvc1", 90, [(3, 2), (2, 5)], np.array([5, 6, 7, 8, 9]), np.array([100, 300]), [(1, 3), (2, 2)], np.array([0, 3, 4]), wide=True)
    (row,) = media.tracks(media.box(b"moov", trak))
    assert row["duration"] == 16 and row["track_id"] == 7
    assert [(r["byte_offset"], r["byte_length"]) for r in row["keyframes"]] == [(100, 5), (300, 17)]
    small = trak.replace(media._full(b"stsz", struct.pack(">II", 0, 5), np.array([5, 6, 7, 8, 9], ">u4").tobytes()), b"")
    assert media.tracks(media.box(b"moov", small))[0]["error"]


def test_counts_without_samples_cost_nothing():
    """A common size with a count of 2^32 - 1: alone it contradicts the other tables, with them it is read."""
    many = 0xFFFFFFFF
    make = lambda times, runs: media.box(b"moov", media.track_box(1, b"soun", b"mp4a", 90, times, (2, many), np.array([50]), runs))
    assert media.tracks(make([(3, 1)], [(1, 3)]))[0]["error"] == "chunks and sizes differ"
    assert media.tracks(make([(3, 1)], [(1, many)]))[0]["error"] == "times and sizes differ"
    (row,) = media.tracks(make([(many, 1)], [(1, many)]))
    assert row["error"] is None and row["n_samples"] == row["n_keyframes"] == many
    assert row["keyframes"] == [{"byte_offset": 50, "byte_length": 2 * many}]


def slow_ranges(sizes, chunks, runs, keys):
    """Keyframe ranges sample by sample."""
    per, out = [], []
    for c in range(len(chunks)):
        per.append(next(n for first, n in reversed(runs) if first <= c + 1))
    i = 0
    last = None
    for chunk, n in zip(chunks, per, strict=True):
        at = chunk
        for _ in range(n):
            if keys is None or i in keys:
                if out and last == i - 1 and out[-1][0] + out[-1][1] == at:
                    out[-1][1] += sizes[i]
                else:
                    out.append([at, sizes[i]])
                last = i
            at += sizes[i]
            i += 1
    return out


def test_tables_against_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(200):
        n_chunks = int(rng.integers(1, 6))
        firsts = sorted({1, *rng.integers(1, n_chunks + 1, 2).tolist()})
        runs = [(f, int(rng.integers(0, 4))) for f in firsts]
        per = [next(n for first, n in reversed(runs) if first <= c + 1) for c in range(n_chunks)]
        n = sum(per)
        same = trial % 3 == 0 and n > 0
        sizes = np.full(n, 7) if same else rng.integers(0, 9, n)
        chunks, at = [], 40
        for c in range(n_chunks):
            chunks.append(at)
            first = sum(per[:c])
            at += int(sizes[first : first + per[c]].sum()) + int(rng.integers(0, 2)) * 5
        keys = None if trial % 2 else np.flatnonzero(rng.random(n) < 0.6)
        trak = media.track_box(1, b"vide", b"avc1", 90, [(n, 1)] if n else [], (7, n) if same else sizes, np.array(chunks), runs, keys, wide=bool(trial % 5))
        (row,) = media.tracks(media.box(b"moov", trak))
        if n == 0:
            assert row["n_keyframes"] == 0 and row["keyframes"] == []
            continue
        assert row["error"] is None, row
        assert [[r["byte_offset"], r["byte_length"]] for r in row["keyframes"]] == slow_ranges(sizes.tolist(), chunks, runs, None if keys is None else set(keys.tolist()))
        assert row["n_keyframes"] == (n if keys is None else len(keys))


def test_bad_containers(spark):
    good = media.written(3, b"x" * 3000)
    rows = [(1, None), (2, b""), (3, b"abc"), (4, good[:-40]), (5, good), (5, good), (None, good), (6, media.box(b"free", b"..")), (7, struct.pack(">I4s", 4, b"moov"))]
    df = spark.createDataFrame([(i, d, "codec") for i, d in rows], "media_id bigint, data binary, codec string")
    got = media.media_columns(df).collect()
    assert {r.media_id: r.error for r in got if r.media_id in (1, 2, 6)} == {1: "null", 2: "empty", 6: "no track"}
    assert all(r.error for r in got if r.media_id in (3, 4, 7))
    assert sum(r.media_id == 5 and r.error is None for r in got) == 4 and sum(r.media_id is None for r in got) == 2
    assert media.media_columns(df.where("1 = 0")).count() == 0


def test_query_against_its_texts(spark, odd_docs):
    got = {(r.media_id, r.track_id): r for r in media.media_columns(media.documents_as_media(odd_docs)).collect()}
    assert got[2, None].error == "null" and got[1, 1].n_samples == 0
    assert got[5, 1].n_samples == got[6, 1].n_samples > 100
