import re
from collections import Counter

import pytest

from textlake.functions import text as T
from textlake.operators import lexics, ngrams, tables, tokens


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "The old boat sails. It sails well!\nA red boat; the old boat.", "en", "a"), (2, "Él navegó a 3:30 pm. e.g. now.", "es", "b"), (3, "", "en", "a"), (4, None, "en", "b")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


CASES = [
    ("It cost $12,500.75 then.", "It cost $ 12,500.75 then ."),
    ('"Go on," she said, "we\'ll wait."', '" Go on , " she said , " we \'ll wait . "'),
    ("They don't know I'm Ann's friend.", "They do n't know I 'm Ann 's friend ."),
    ("Meet at 5:45, not 6 : 10.", "Meet at 5:45 , not 6 : 10 ."),
    ("See Dr. Brown today.", "See Dr. Brown today ."),
    ("a well-known (short) 25% list: x, y", "a well-known ( short ) 25 % list : x , y"),
    ("Use glue, etc. and tape.", "Use glue , etc. and tape ."),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_merged_words(text, want):
    got = tokens.merged_words(text)
    assert " ".join(w for w, _, _ in got) == want
    assert all(text[b:e] == w for w, b, e in got)


def test_spans_cross_lines():
    assert [(w, b) for w, b, _ in tokens.merged_words("ab\ncan't")] == [("ab", 0), ("ca", 3), ("n't", 5)]


def test_sentences(docs):
    got = [(r.doc_id, r.line_ix, r.sent) for r in tokens.sentences(docs).orderBy("doc_id", "line_ix", "sent_ix").collect()]
    assert got == [(1, 0, "The old boat sails."), (1, 0, "It sails well!"), (1, 1, "A red boat; the old boat."), (2, 0, "Él navegó a 3:30 pm. e.g. now.")]


def test_initials_and_cases(spark):
    df = spark.createDataFrame([(1, "J. Brown came. Then left."), (2, "all lower. again lower."), (3, "ALL CAPS. AGAIN CAPS."), (4, '(Why?) "So."')], "doc_id bigint, text string")
    n = Counter(r.doc_id for r in tokens.sentences(df).collect())
    assert n == {1: 2, 2: 2, 3: 2, 4: 2}


def test_paragraphs_and_join(spark):
    df = spark.createDataFrame([(1, "one two.\n\n  three.\n \n x\n\nfour")], "doc_id bigint, text string")
    assert [r.parag for r in tokens.paragraphs(df).orderBy("parag_ix").collect()] == ["one two.", "three.", "four"]
    assert tokens.joined_text(tokens.full_tokens(df)).first().text == "one two .\nthree .\nfour"


def test_bounded_by_marks(spark):
    """The marked indexes against a walk over the tokens."""
    df = spark.createDataFrame([(1, "A b. C d! e. F"), (2, "g h.")], "doc_id bigint, text string")
    ones, twos = Counter(), Counter()
    for r in df.collect():
        words = ["<S>", *re.findall(r"\w+|[^\w\s]", r.text)]
        for i, w in enumerate(words):
            ones[w] += 1
            after = words[i + 1] if i + 1 < len(words) else None
            if w in ".!" and (after is None or after[0].isupper()):
                ones["<S>"] += 1
        words.append("</S>")
        for a, b in zip(words, words[1:], strict=False):
            if a in ".!" and b[0].isupper():
                twos[a, "</S>"] += 1
                twos["<S>", b] += 1
            else:
                twos[a, b] += 1
    ones["</S>"] = ones["<S>"] - 1
    assert {r.word: r.freq for r in ngrams.marked_unigrams(df).collect()} == ones
    assert {(r.w1, r.w2): r.freq for r in ngrams.marked_bigrams(df).collect()} == twos


def test_llr_of_independent_words_is_zero(spark):
    df = spark.createDataFrame([("a", "x", 10), ("a", "y", 10), ("b", "x", 10), ("b", "y", 10)], "w1 string, w2 string, freq bigint")
    assert all(r.llr == pytest.approx(0) for r in ngrams.collocations(df).collect())


def test_tabulate():
    table = {"north": {"x1": 4, "x": 5, "y": 210}, "s": {"y": 6, "z2": 31}}
    assert tables.rendered(table) == "        x1  x    y  z2\n  north   4  5  210   0\n      s   0  0    6  31\n"
    assert tables.rendered(table, ["x1", "y"], cumulative=True) == "        x1    y\n  north   4  214\n      s   0    6\n"


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("electriciti", "electr"), ("adoption", "adopt"), ("controll", "control"), ("is", "is"), ("sky", "sky")])
def test_stem(word, want):
    assert lexics.stem(word) == want


def test_strict_stem():
    assert lexics.stem("replacement", strict=True) == "replac"


def test_shapes_and_normal_forms(spark):
    df = spark.createDataFrame([("Hat",), ("hat",), ("HAT",), ("a:Bc12",), ("12",), ("1,234",), ("me@x.org",), ("http://x.y",)], "w string")
    got = {r.w: (r.s, r.n) for r in df.select("w", T.word_shape(df.w).alias("s"), T.normalized(df.w).alias("n")).collect()}
    assert got["Hat"] == ("ul", "hat") and got["HAT"][0] == "u" and got["a:Bc12"][0] == "l-uld"
    assert (got["12"][1], got["1,234"][1], got["me@x.org"][1], got["http://x.y"][1]) == ("00", "00k", "@__", "@@@")


def test_lemmas(spark):
    words = spark.createDataFrame([("ties",), ("was",), ("boat",), ("be",)], "word string")
    got = {r.word: (r.lemma, r.lemma_tag) for r in lexics.lemmatized(words, lexics.dictionary(spark)).collect()}
    assert got == {"ties": ("tie", "NN"), "was": ("be", "VB"), "boat": ("boat", None), "be": ("be", "VB")}


def test_markov_walk_has_all_transitions(spark, tmp_path):
    from textlake import queries
    from textlake.operators import language_model, ngrams

    rows = [(1, "the cat saw the dog and the cat ran"), (2, "a dog saw a cat"), (3, "the bird sang " * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.word for r in queries.queries()["markov_generate"](spark, str(tmp_path)).orderBy("pos").collect()]
    every = [tuple(r) for r in ngrams.transitions(df).select("prefix", "word", "weight").collect()]
    assert got == language_model.generated(every, 200, 11) and {"cat", "dog"} <= set(got)


def test_sentences_are_joined_as_tokens_are(spark):
    """Rows that share an id and lines without words among them; no token is shuffled by itself."""
    from textlake.plans import exchanges, physical_plan

    rows = [(1, "one two. Three can't.\n\n(a) b"), (1, "five; six. Seven\nx"), (2, "~~ \u00a7\u00a7\nword"), (3, ""), (4, None), (5, "\u00a7\u00a7 \u00a7")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    joined = tokens.joined_sentences(tokens.sentence_tokens(df))
    plan = physical_plan(joined)
    assert exchanges(joined) == 1 and plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in tokens.joined_text(tokens.full_tokens(df)).collect()}


def test_equal_classes_are_tagged_once():
    """The best path, as by trying all paths of tags."""
    import itertools
    import math

    from textlake.catalog.annotation import tagged_sents
    from textlake.operators import tagging as Y

    model = Y.hmm(tagged_sents(), 2)
    log = lambda p: math.log(p or 1e-6)

    def score(words, tags):
        path, total = ["*", "*", *tags, "STOP"], 0
        for i, w in enumerate([w if w in model["known"] else Y.rare_class(w) for w in words]):
            total += log(model["move"].get(tuple(path[i : i + 3]), 0)) + log(model["emit"].get((tags[i], w), 0))
        return total + log(model["move"].get(tuple(path[-3:]), 0))

    for words in (["the", "boat", "sails"], ["a", "Xyz", "7"], ["Ann"], []):
        got = Y.viterbi(words, model)
        seen = [w if w in model["known"] else Y.rare_class(w) for w in words]
        every = itertools.product(*([t for t in model["tags"] if (t, w) in model["emit"]] or model["tags"] for w in seen))
        assert len(got) == len(words) and score(words, got) == pytest.approx(max(score(words, t) for t in every))
    assert Y.viterbi(["qqq", "boat"], model) == Y.viterbi(["zzz", "boat"], model) and len(Y._memo(model).paths) == 5
