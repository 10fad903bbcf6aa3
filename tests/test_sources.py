import gzip
import io
import zipfile

import numpy as np
import pytest

from textlake.sources import alignment, pages, readers, sinks


def put(path, name, text):
    (path / name).write_text(text)
    return str(path)


def test_lines_and_dictionaries(spark, tmp_path):
    with gzip.open(tmp_path / "d.txt.gz", "wt") as f:
        f.write("a 1\n\nb\na 2 3\n")
    path = str(tmp_path)
    assert {r.key: r.value for r in readers.dictionary(spark, path).collect()} == {"a": "2 3", "b": None}
    assert readers.pattern_from(spark, path) == "a 1|b|a 2 3"


def test_archives(spark, tmp_path):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.dat", "00012n 3\n00012n 4.5\nheader\n")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("y.dat", "00012n 1\n7v 2\n")
    (tmp_path / "a.zip").write_bytes(outer.getvalue())
    assert {r.member for r in readers.archive_members(spark, str(tmp_path)).collect()} == {"x.dat", "y.dat"}
    assert {(r.synset, r.pos): r.n for r in readers.information_counts(spark, str(tmp_path)).collect()} == {(12, "n"): 8.5, (7, "v"): 2.0}


def test_slash_tagged(spark, tmp_path):
    put(tmp_path, "ca01", "\n\n\tThe/at cat/nn ``/`` 1/2/cd ./.\n\nIt/pps sat/vbd\n\n\nNext/ap\n")
    rows = readers.read_corpus(spark, "slash-tagged", str(tmp_path)).orderBy("parag_ix", "sent_ix", "tok_ix").collect()
    assert [(r.word, r.pos) for r in rows] == [("The", "AT"), ("cat", "NN"), ('"', "``"), ("1/2", "CD"), (".", "."), ("It", "PPS"), ("sat", "VBD"), ("Next", "AP")]
    assert [r.parag_ix for r in rows] == [0] * 7 + [1]  # one empty line parts sentences only
    assert {r.genre for r in rows} == {"press-reportage"} and len({(r.parag_ix, r.sent_ix) for r in rows}) == 3


def test_bracketed(spark, tmp_path):
    put(tmp_path, "t.parse", "( (S (NP-SBJ (N we) (-NONE- *)) (V go)) )\n(S\n (V stop))\n")
    trees = readers.bracketed(spark, str(tmp_path))
    assert trees.count() == 2
    nodes = readers.tree_nodes(trees).where("word is not null").orderBy("tree_ix", "node_id").collect()
    assert [(r.tree_ix, r.label, r.word) for r in nodes] == [(0, "N", "we"), (0, "V", "go"), (1, "V", "stop")]


def test_graphs_and_marks(spark, tmp_path):
    put(tmp_path, "g.txt", "# ::id 1\n# ::snt We go.\n(g / go\n  :arg0 (w / we))\n\n# ::snt Stop.\n(s / stop)\n")
    rows = readers.meaning_graphs(spark, str(tmp_path)).orderBy("ix").collect()
    assert [(r.snt, r.graph.split()[0]) for r in rows] == [("We go.", "(g"), ("Stop.", "(s")]
    (tmp_path / "n").mkdir()
    put(tmp_path / "n", "d1.txt", "Ann Lee met  Bo in Ulm.")
    put(tmp_path / "n", "d1.ann", "T1\tPERS 0 7\tAnn Lee\nT2\tLOC 19 22\tUlm\n")
    texts, marks = readers.offsets_corpus(spark, str(tmp_path / "n"))
    got = alignment.aligned(alignment.placed(texts), marks.select("doc_id", "beg", "end", "cat"), 4)
    assert {(r.word, r["cat"]) for r in got.collect()} == {("Ann", "PERS"), ("Lee", "PERS")}
    assert [(r.word, r.beg, r.end) for r in alignment.placed(texts).collect()][2] == ("met", 8, 11)


def test_xml(spark, tmp_path):
    for d in ("p", "n", "w", "s"):
        (tmp_path / d).mkdir()
    put(tmp_path / "p", "p.xml", '<Session><Posts><Post class="Greet" user="u1">hi all<terminals><t pos="UH" word="hi"/><t pos="DT" word="all"/></terminals></Post></Posts></Session>')
    row = readers.chat_posts(spark, str(tmp_path / "p")).first()
    assert (row["class"], row.user, row.text, [(w.word, w.pos) for w in row.words]) == ("Greet", "u1", "hi all", [("hi", "UH"), ("all", "DT")])
    put(tmp_path / "n", "n.xml", '<newsitem itemid="7" date="1990-01-02"><headline>H</headline><dateline>ULM</dateline><text><p>One.</p><p>Two.</p></text></newsitem>')
    row = readers.newswire(spark, str(tmp_path / "n")).first()
    assert (row.item_id, row.date, row.headline, row.byline, row.paragraphs) == (7, "1990-01-02", "H", None, ["One.", "Two."])
    put(tmp_path / "w", "w.xml", "<mediawiki><page><title>A</title><revision><text>[[b]] &amp;lt; c</text></revision></page><page><title>R</title><revision><text>#REDIRECT [[A]]</text></revision></page></mediawiki>")
    assert [(r.title, r.text) for r in readers.wiki_pages(spark, str(tmp_path / "w")).collect()] == [("A", "b < c")]
    put(tmp_path / "s", "s.xml", "<p><s snum=1><wf cmd=done pos=VB lemma=say wnsn=1 lexsn=2:32>said</wf>\n<punc>.</punc></s></p>")
    rows = readers.sense_tagged(spark, str(tmp_path / "s")).orderBy("ix").collect()
    assert [(r.word, r.lemma, r.wnsn) for r in rows] == [("said", "say", "1"), (".", None, None)]


def test_wiktionary(spark, tmp_path):
    text = "==English==\n===Noun===\n{{plural of|cat}}\n===Verb===\nto go\n==French==\n===Noun===\nx"
    put(tmp_path, "w.xml", f"<m><page><title>cats</title><revision><text>{text}</text></revision></page></m>")
    assert {(r.word, r.tag, r.base) for r in readers.wiktionary(spark, str(tmp_path)).collect()} == {("cats", "noun", "cat"), ("cats", "verb", None)}


def test_chunks_and_lemmas(spark, tmp_path):
    (tmp_path / "c").mkdir()
    put(tmp_path / "c", "c.pos", "*x* head *x*\n" + "=" * 38 + "\n[ The/DT cat/NN ]\nsat/VBD\n[ here/RB ]\n")
    rows = readers.chunked_tags(spark, str(tmp_path / "c")).where("word <> ''").orderBy("sent_ix", "tok_ix").collect()
    assert [(r.word, r.np_ix) for r in rows] == [("The", 0), ("cat", 0), ("sat", None), ("here", 1)]
    (tmp_path / "l").mkdir()
    put(tmp_path / "l", "l.txt", "go VB\n  went VBD\n  gone VBN\ncat NN\n  cats NNS\n")
    rows = readers.lemma_dictionary(spark, str(tmp_path / "l")).collect()
    assert {(r.form, r.lemma) for r in rows} == {("go", "go"), ("went", "go"), ("gone", "go"), ("cat", "cat"), ("cats", "cat")}


def test_vectors(spark, tmp_path):
    (tmp_path / "t").mkdir()
    put(tmp_path / "t", "v.txt", "2 3\na 1 2 3\nb 4 5 6\n")
    assert {r.word: r.vec for r in readers.text_vectors(spark, str(tmp_path / "t"), header=True).collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "v.bin").write_bytes(np.arange(6, dtype="<f4").tobytes())
    assert [r.vec for r in readers.binary_vectors(spark, str(tmp_path / "b"), 3).orderBy("ix").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_pages_and_sinks(spark, tmp_path):
    html = "<p>a&nbsp;<b>b</b></p><script>x<y</script><!-- no -->&lt;c&amp;"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert pages.page_text(df).first().text == "a b <c&"
    sinks.write_dictionary(spark.createDataFrame([("k", "v")], "a string, b string"), f"{tmp_path}/d")
    assert spark.read.text(f"{tmp_path}/d").first()[0] == "k\tv"
    sinks.write_tsv(spark.createDataFrame([("k", 1)], "a string, b int"), f"{tmp_path}/t")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/t").first().b == "1"


def test_unknown_reader(spark):
    with pytest.raises(ValueError, match="no reader"):
        readers.read_corpus(spark, "unheard-of", "x")


def test_streaming(spark, tmp_path):
    from textlake.streaming import windowed_counts

    spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'a b a' as text").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/in")
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert {r.word: r.freq for r in spark.table("counted").collect()} == {"a": 2, "b": 1}
