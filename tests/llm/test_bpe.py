import json
import os
import random

import pyarrow as pa
import pytest

from textlake.llm import bpe, cluster, token_counts

from .conftest import prose

TEXTS = ["", " ", "Hello  world\n\n 123 it's we'll they'VE", "naïve Ünïcode 漢字 😀😀  x", "a" * 5000, "\t\r\n mixed   white ", "'", "x'", "it's'd 's", "don't  stop\n", "<|endoftext|>", "£$%^ 12ab34 _under_score_"]
FILE = bpe.VOCABULARY
needs_files = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files")


@needs_files
def test_same_ids_as_an_independent_encoder():
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(FILE), special_tokens={})
    own, counter = bpe.tokenizer(FILE), token_counts.counter(FILE)
    for text in TEXTS:
        ids = other.encode_ordinary(text)
        assert own.encode(text) == ids, text
        assert own.decode(ids).decode() == text
        assert counter.of(text) == counter.count(text) == len(ids), text


@needs_files
def test_chunk_maps_compose():
    counter = token_counts.counter(FILE)
    text = "Some words, 12 of them; and 'quotes' too. " * 9 + "zzz" * 40 + " end"
    want = counter.of(text)
    for size in (1, 3, 7, 50, 1000):
        maps = [counter.chunk(text[i : i + size]) for i in range(0, len(text), size)]
        assert counter.total(counter.scan(maps)) == want
        left = maps[0]
        for m in maps[1:]:
            left = counter.joined(left, m)
        assert counter.total(left) == want


def test_model_of_a_small_vocabulary():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    model = bpe.ByteBPE(ranks)
    assert model.encode("abc") == [257] and model.encode("bc") == [258]
    assert model.decode(model.encode("ñabcbc")) == "ñabcbc".encode()
    with pytest.raises(ValueError):
        bpe.serialize_model({b"a": 0, b"b": 2})


@needs_files
def test_odd_rows(odd_docs, no_docs):
    rows = bpe.encode(odd_docs)
    assert rows.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"]
    got = {(r.doc_id, r.n_tokens): r for r in rows.collect()}
    assert got[1, 0].token_ids == [] and got[1, 0].round_trip
    assert got[2, None].token_ids is None and got[2, None].round_trip is None
    assert all(r.round_trip for k, r in got.items() if k != (2, None))
    assert rows.count() == odd_docs.count() and bpe.encode(no_docs).count() == 0
    back = bpe.decode(rows).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in back) == sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
    counts = sorted((r.doc_id or -1, -1 if r.n_tokens is None else r.n_tokens) for r in token_counts.token_counts(odd_docs).collect())
    assert counts == sorted((r.doc_id or -1, -1 if r.n_tokens is None else r.n_tokens) for r in rows.collect())
    assert token_counts.token_counts(no_docs).count() == 0


@needs_files
def test_long_texts_by_chunks(spark):
    rng = random.Random(3)
    texts = [prose(rng, 40_000), "x" * 70_000, "漢字" * 40_000 + " end", "word " * 20_000, "\n" * 70_000, "a, b; " * 15_000 + "'s" * 9_000, "short"]
    assert sum(len(t) > token_counts.CHUNK for t in texts) == len(texts) - 1
    rows = [(i // 2, t, 0) for i, t in enumerate(texts)] + [(None, texts[0], 0), (0, texts[0], 1), (9, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, of int")
    got = token_counts.token_counts(df).collect()
    want = sorted((-1 if i is None else i, -1 if t is None else len(bpe.tokenizer().encode(t))) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.n_tokens is None else r.n_tokens) for r in got) == want


def test_vocabularies_are_not_copied():
    assert json.dumps(FILE).startswith('"/opt/')


def test_kernels_get_batches_of_bounded_bytes(spark):
    """Long texts come in several batches, whatever the number of rows to a batch."""
    docs = spark.range(0, 60, 1, 1).selectExpr("id as doc_id", "repeat('words of a long text ', 20000) as text")
    bpe.encode(docs)  # sets the bound

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    got = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
    assert len(got) > 3 and max(got) <= cluster.BATCH + 2 * 22 * 20_000
