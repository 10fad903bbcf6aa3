import random

from textlake.llm import bpe, mixing, queries

from .conftest import prose


def test_stages_and_run(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(150)]
    texts[1] = texts[0]
    texts[2] = " ".join([*texts[0].split()[:-3], "other", "last", "words"])
    passage = prose(rng, 60)
    texts[10], texts[11] = f"{passage} {prose(rng, 30)}", f"{prose(rng, 150)} {passage}"
    junk = {i for i in range(20, 150, 5)}
    rows = [(i, " ".join(w.upper() + "!!" for w in t.split()) if i in junk else t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(150)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not junk & seen[0] and len(seen[0]) >= 0.97 * (150 - len(junk))
    assert seen[0] - seen[1] == {1, 2}
    assert seen[1] == seen[2]
    cut = spark.read.parquet(f"{tmp_path}/2").where("doc_id in (10, 11)").orderBy("doc_id").collect()
    assert cut[0].text == texts[10] and passage not in cut[1].text and cut[1].n_chars == len(cut[1].text)
    before = spark.read.parquet(f"{tmp_path}/2")
    want = {r.doc_id: r.n_copies for r in mixing.sampled(before).collect()}
    assert sum(want.values()) == before.count() and seen[3] == set(want)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(final) == sum(want.values()) and all(r.round_trip for r in final)
    own, kept = bpe.tokenizer(), {r.doc_id: r.text for r in before.collect()}
    assert all(own.decode(r.token_ids).decode() == kept[r.doc_id] for r in final)


def test_every_operator_has_a_query():
    names = [q.split("_")[0] for q in queries.queries()]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{n}" for n in range(1, 11)]
