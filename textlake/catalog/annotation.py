"""Learners, taggers, parsers and alignment, with small inline grammars and lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from ..operators import ngrams as N
from ..operators import syntax as S
from ..operators import tagging as Y
from ..operators import tokens as K
from . import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

W = r"'[\p{L}\p{N}_]+'"
COLUMNS = ["lang", "size", "signs"]


def _labelled(spark, d):
    """doc_id, gold (quality) and a few features of all labelled documents."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars"), "doc_id")
    signs = F.floor(20 * F.regexp_count("text", F.lit("[!|$%&*#]")) / F.greatest(F.length("text"), F.lit(1)))
    return rows.select("doc_id", (F.col("quality") == 1).alias("gold"), "lang", F.floor(F.log2(F.col("n_chars") + 1)).cast("double").alias("size"), signs.cast("double").alias("signs"))


@query()
def dtree_train_predict(spark, d):
    rows = _labelled(spark, d)
    tree = L.grown_from(rows, COLUMNS, "gold", "cart", depth=4)
    return rows.select("doc_id", "gold", L.tree_column(tree, COLUMNS).alias("guess"))


@query()
def c45_train_predict(spark, d):
    rows = _labelled(spark, d)
    tree = L.grown_from(rows, COLUMNS, "gold", "c4.5", depth=4)
    return rows.select("doc_id", "gold", L.tree_column(tree, COLUMNS).alias("guess"))


@query()
def dtree_nodes(spark, d):
    tree = L.grown_from(_labelled(spark, d), COLUMNS, "gold", "cart", depth=4)
    return spark.createDataFrame(L.tree_nodes(tree), "node_id int, parent_id int, branch string, feature int, op string, value string, class string, prob double")


@query()
def rf_predict(spark, d):
    rows = _labelled(spark, d).withColumn("y", F.col("gold").cast("double"))
    return L.forest(rows, ["size", "signs"], "y").transform(rows).select("doc_id", "gold", (F.col("prediction") == 1).alias("guess"))


@query()
def softmax_predict(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = _labelled(spark, d).withColumn("y", F.col("gold").cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["size", "signs"], outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=0.001)]).fit(rows)
    return model.transform(rows).select("doc_id", "gold", (F.col("prediction") == 1).alias("guess"))


@query()
def perceptron_predict(spark, d):
    rows = _labelled(spark, d).select(F.col("doc_id").alias("id"), F.col("gold").cast("string").alias("gold"), L.feature_strings(bias=F.lit(1), lang=F.col("lang"), size=F.col("size"), signs=F.col("signs")).alias("fs"))
    examples = [(r["fs"], r["gold"]) for r in rows.orderBy("id").collect()]
    weights = L.weight_table(spark, L.perceptron(examples))
    return L.classified(rows, weights, ["false", "true"]).join(rows.select("id", "gold"), "id")


@query("select doc_id, i from (select doc_id, quality from labels) l, unnest(range(case when quality = 0 then 3 else 1 end)) t(i)")
def oversampled_labels(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality")
    n = F.when(F.col("quality") == 0, 3).otherwise(1)
    return rows.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("i"))


@query("with f as (select 'lang ' || lang as feature from documents union all select 'source ' || source from documents), c as (select feature, count(*) as n from f group by feature) select feature, n, cast(row_number() over (order by n desc, feature) - 1 as int) as id from c")
def feature_ids(spark, d):
    rows = table(spark, d, "documents").select(L.feature_strings(lang=F.col("lang"), source=F.col("source")).alias("fs"))
    return L.feature_ids(rows)


#: A training corpus of invented sentences, word/TAG.
TAGGED = ["the/DT old/JJ boat/NN sails/VBZ ./.", "a/DT red/JJ kite/NN flies/VBZ ./.", "Ann/NNP sees/VBZ the/DT boat/NN ./.", "Ann/NNP flies/VBZ a/DT kite/NN ./.", "the/DT kite/NN sails/VBZ ./.", "Ben/NNP likes/VBZ old/JJ boats/NNS ./.", "the/DT boats/NNS sail/VBP ./.", "a/DT boat/NN is/VBZ old/JJ ./."]
TREES = ["(TOP (S (NP (DT the) (JJ old) (NN boat)) (VP (VBZ sails)) (. .)))", "(TOP (S (NP (NNP Ann)) (VP (VBZ sees) (NP (DT the) (NN boat))) (. .)))", "(TOP (S (NP (DT a) (NN kite)) (VP (VBZ flies)) (. .)))"]


def tagged_sents() -> list[list[tuple[str, str]]]:
    return [[tuple(x.rsplit("/", 1)) for x in s.split(" ")] for s in TAGGED]


def _sents(spark):
    return spark.createDataFrame([(i, [w for w, _ in s], [t for _, t in s]) for i, s in enumerate(tagged_sents())], "sent_id int, words array<string>, gold array<string>")


def _per_word(rows):
    z = F.posexplode(F.arrays_zip("words", "gold", "guess"))
    return rows.select("sent_id", z.alias("tok_ix", "x")).select("sent_id", "tok_ix", F.col("x.words").alias("word"), F.col("x.gold").alias("gold"), F.col("x.guess").alias("guess"))


@query()
def pos_tag(spark, d):
    return _per_word(_sents(spark).withColumn("guess", Y.tagged_column(F.col("words"), Y.train(tagged_sents()))))


@query()
def hmm_viterbi(spark, d):
    return _per_word(_sents(spark).withColumn("guess", Y.tagged_column(F.col("words"), Y.hmm(tagged_sents(), 2), Y.viterbi)))


def _trees(spark):
    return spark.createDataFrame(list(enumerate(TREES)), "tree_id int, tree string")


@query()
def cnf_roundtrip(spark, d):
    cnf = S.tree_column(lambda t: S.write_tree(S.to_cnf(t)), F.col("tree"))
    rows = _trees(spark).withColumn("cnf", cnf)
    return rows.withColumn("back", S.tree_column(lambda t: S.write_tree(S.from_cnf(t)), F.col("cnf")))


@query()
def cky_parse(spark, d):
    rules = S.grammar(S.to_cnf(S.read_tree(t)) for t in TREES)

    def parsed(tree) -> str:
        found = S.cky([w for w, _ in S.leaves(tree)], rules)
        return S.write_tree(found[0][1]) if found else ""

    return _trees(spark).withColumn("parse", S.tree_column(parsed, F.col("tree")))


@query()
def render_tree(spark, d):
    rows = _trees(spark).select("tree_id", F.posexplode(S.lines_column(S.render_tree, F.col("tree"))).alias("line_ix", "line"))
    return rows


@query()
def deps_tree(spark, d):
    lines = spark.createDataFrame([(0, "root(ROOT-0, sees-2)"), (0, "nsubj(sees-2, Ann-1)"), (0, "dobj(sees-2, boat-4)"), (0, "det(boat-4, the-3)")], "sent_id int, value string")
    deps = S.stanford_deps(lines)
    return deps.groupBy("sent_id").applyInPandas(lambda p: p.head(1)[["sent_id"]].assign(tree=S.deps_tree([(r.rel, int(r.head_id), int(r.tail_id), r.tail) for r in p.itertuples()])), "sent_id int, tree string")


_TURNS = """with q as (select conv_id, turn, role, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from conversations), a as (select conv_id, turn, w from q where role = 'user'), b as (select conv_id, turn - 1 as turn, w from q where role = 'assistant'),
e as (select conv_id, turn, unnest(w) as e from a), f as (select conv_id, turn, unnest(range(len(w))) as ix, unnest(w) as f from b), p as (select * from e join f using (conv_id, turn)),
s as (select e, f from (select distinct e, f from p)), t as (select e, f, 1.0 / count(*) over (partition by e) as t from s), r as (select p.e, p.f, t / sum(t) over (partition by conv_id, turn, ix) as c from p join t using (e, f)),
c as (select e, f, sum(c) as c from r group by all)"""


@query(f"{_TURNS} select e, f, round(c / sum(c) over (partition by e), 6) as t from c")
def ibm1_em_round(spark, d):
    """The words of a user's turn beside those of the answer."""
    turns = table(spark, d, "conversations").withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    key = F.struct("conv_id", "turn")
    user = turns.where("role = 'user'").select(key.alias("k"), "words")
    answer = turns.where("role = 'assistant'").withColumn("turn", F.col("turn") - 1).select(F.struct("conv_id", "turn").alias("k"), "words")
    return Y.em_first(user, answer, "k").select("e", "f", F.round("t", 6).alias("t"))


@query(f"with l as (select lower(unnest(regexp_extract_all(text, {W}))) as w from documents), c as (select w, count(*) as n from l group by w) select case when n >= 5 then w when regexp_matches(w, '[0-9]') then '_NUM_' else '_RARE_' end as word, cast(sum(n) as bigint) as freq from c group by all")
def rare_word_replacement(spark, d):
    counts = N.word_freqs(table(spark, d, "documents"), lower=True)
    word = F.when(F.col("freq") >= 5, F.col("word")).when(F.col("word").rlike("[0-9]"), "_NUM_").otherwise("_RARE_")
    return counts.groupBy(word.alias("word")).agg(F.sum("freq").alias("freq"))


@query()
def rule_shares(spark, d):
    rules = S.grammar(S.to_cnf(S.read_tree(t)) for t in TREES)
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, q) for r, q in sorted(rules.items())], "lhs string, rhs1 string, rhs2 string, q double")


@query()
def tagged_corpus(spark, d):
    """All turns of the conversations through the full tokenizer and the tagger."""
    sents = K.sentence_tokens(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text").where("text is not null"))
    own = F.transform("words", lambda w, i: F.struct(i.alias("tok_ix"), w.alias("word")))
    rows = sents.groupBy("doc_id", "parag_ix", "sent_ix").agg(F.transform(F.sort_array(F.flatten(F.collect_list(own))), lambda x: x["word"]).alias("words"))
    model = Y.hmm(tagged_sents(), 2)
    return rows.withColumn("tags", Y.tagged_column(F.col("words"), model, Y.viterbi)).select("doc_id", "parag_ix", "sent_ix", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
