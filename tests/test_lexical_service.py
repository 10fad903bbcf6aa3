import json

from pyspark.sql import functions as F

from textlake.operators import language_model, learning, lexical_database, lexics, ngrams, service
from textlake.plans import physical_plan


def test_lexical_questions(spark):
    parts = spark.createDataFrame([(1, "Red Kite", "T1", 4), (2, "red boat", "T2", 8), (3, "old red red", "T3", 5), (4, None, None, None)], "p_partkey bigint, p_name string, p_type string, p_size int")
    db = lexical_database.from_parts(parts)
    asked = spark.createDataFrame([("red",), ("red",), ("none",), (None,)], "lemma string")
    assert {(r.synsetid, r.pos, r.sensenum, r.name) for r in db.senses_of(asked).collect()} == {(1, "n", 1, "red.n.1"), (2, "n", 2, "red.n.2"), (3, "v", 1, "red.v.1")}
    assert sorted(r.synsetid for r in db.synsets_of(asked, "n").collect()) == [1, 2]
    names = spark.createDataFrame([("red.n.2",), ("red.n.9",), ("red",), (None,)], "name string")
    assert [(r.name, r.definition) for r in db.named(names).collect()] == [("red.n.2", "T2")]
    ids = spark.createDataFrame([(3,), (9,)], "synsetid bigint")
    assert sorted(r.lemma for r in db.lemmas(ids).collect()) == ["old", "red"]
    assert [r["sample"] for r in db.examples(ids).collect()] == ["old red red"]
    assert [(r.synsetid, r.other) for r in db.related(ids, "also").collect()] == [(3, 4)]
    assert [(r.synsetid, r.other) for r in db.related(ids, "hypernym", reverse=True).collect()] == [(3, 2)]
    assert db.words_with_senses().count() == 4


def test_service_answers(spark):
    docs = spark.createDataFrame([(1, "Leaves heeded.\n\nA  boat"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r.doc_id: json.loads(r.json) for r in service.tokenize(docs).collect()}
    assert got == {1: {"result": [["Leaves", "heeded"], ["A", "boat"]]}, 2: {"error": "no text"}, 3: {"result": []}}
    got = {r.doc_id: json.loads(r.json) for r in service.lemmatize(docs, lexics.dictionary(spark)).collect()}
    assert {x["word"]: x["lemma"] for x in got[1]["result"]} == {"leaves": "leaf", "heeded": "heed", "a": "a", "boat": "boat"} and got[2] == {"error": "no text"} and got[3] == {"result": []}
    forms = spark.createDataFrame([("(S x)",), (" 1\tx",), ("root(a)",), ("",), (None,)], "t string").select(service.syntax_format(F.col("t")).alias("f")).collect()
    assert [r.f for r in forms] == ["tree", "table", "dependencies", None, None]


def test_shares_have_no_window(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "b c")], "doc_id bigint, text string")
    for df in (ngrams.contexts(docs), ngrams.transitions(docs), ngrams.collocations(ngrams.gram_freqs(docs, 2))):
        assert "Window" not in physical_plan(df)
    assert {(r.prefix, r.word): r.weight for r in ngrams.transitions(docs).collect()} == {("\u00b6", "a"): 0.5, ("\u00b6", "b"): 0.5, ("a", "b"): 1.0, ("b", "a"): 1 / 3, ("b", "c"): 2 / 3}


def test_backoff_orders(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id bigint, text string")
    sents = spark.createDataFrame([(1, "a b c"), (2, "z"), (3, None)], "item_id bigint, text string")
    got = {r.item_id: (r.n_words, r.n_seen, r.backoff) for r in language_model.backoff_scores(docs, sents, "item_id", 3).collect()}
    assert got[1] == (4, 4, -1.0)  # a, then b are certain, c is one of two, the end certain
    assert set(got) == {1, 2} and got[2][:2] == (2, 0)


def test_feature_ids_are_ranks(spark):
    rows = spark.createDataFrame([(["x", "aaaa1", "aaaa2", "b"],), (["x", "b"],), (["x"],)], "fs array<string>")
    assert {r.feature: r.id for r in learning.feature_ids(rows).collect()} == {"x": 0, "b": 1, "aaaa1": 2, "aaaa2": 3}


def test_neighbours_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), float(10 - i)]) for i in range(10)] + [(99, None)], "id bigint, vec array<float>")
    whole = sorted(map(tuple, lexics.neighbours(vectors, vectors, "id", 3).collect()))
    monkeypatch.setattr(lexics, "ASKED", 3)
    assert sorted(map(tuple, lexics.neighbours(vectors, vectors, "id", 3).collect())) == whole and len(whole) == 30
    assert {o for a, o, *_ in whole if a == 0} == {1, 2, 3}
