"""Dictionaries, vectors, taxonomies, annotations and other corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical_database as D
from ..operators import lexics as X
from ..operators import service as V
from ..operators import tables as B
from ..operators import taxonomy as G
from ..operators import tokens as K
from ..sources import alignment, languages, pages
from . import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

W = r"'[\p{L}\p{N}_]+'"
_FORMS = "forms(form, tag, lemma, lemma_tag, rank) as (values " + ", ".join(str(f) for f in X.FORMS) + ")"
_VOCAB = f"w as (select distinct unnest(regexp_extract_all(lower(text), {W})) as word from documents)"


def docs(spark, d):
    return table(spark, d, "documents")


def _lemmas(where: str = "") -> str:
    return f"""with {_FORMS}, {_VOCAB}, k as (select distinct form from forms),
r as (select *, row_number() over (partition by form order by case when form <> lemma then 1 else 0 end, rank, length(lemma_tag), length(lemma), lemma, lemma_tag) as i, count(*) over (partition by form) as n from forms {where})
select w.word, case when k.form is null then w.word else r.lemma end as lemma, r.lemma_tag, coalesce(r.n, 0) as n_readings from w left join k on k.form = w.word left join r on r.form = w.word and r.i = 1"""


def _words(spark, d):
    return K.tokens(docs(spark, d), keep=()).select(F.lower("word").alias("word")).distinct()


@query(_lemmas())
def lemma_lookup(spark, d):
    return X.lemmatized(_words(spark, d), X.dictionary(spark))


@query(_lemmas("where tag = 'VBZ'"))
def lemma_lookup_vbz(spark, d):
    return X.lemmatized(_words(spark, d), X.dictionary(spark), F.lit("VBZ"))


@query(f"with {_FORMS}, {_VOCAB}, l as (select distinct lemma, tag from forms) select l.lemma, l.tag, f.form from l left join forms f using (lemma, tag)")
def inflect_lemmas(spark, d):
    forms = X.dictionary(spark)
    return X.inflected(forms.select("lemma", "tag").distinct(), forms)


@query()
def stem_words(spark, d):
    return X.stems(K.tokens(docs(spark, d), keep=()))


@query(f"with l as (select unnest(regexp_extract_all(text, {W})) as word from documents) select word || '/' || lower(substr(word, 1, 1)) as token, word, lower(substr(word, 1, 1)) as pos, count(*) as n from l group by all")
def tagged_tokens(spark, d):
    rows = K.tokens(docs(spark, d), keep=()).groupBy("word").agg(F.count("*").alias("n"))
    rows = rows.select(T.tagged(F.col("word"), F.lower(F.substring("word", 1, 1))).alias("token"), "n")
    return rows.select("token", T.split_tagged(F.col("token")).alias("t"), "n").select("token", "t.word", "t.pos", "n")


@query("select l.iso, l.name, count(*) as n_docs from documents d join (values " + ", ".join(f"('{a}', '{b}')" for a, b in languages.ISO) + ") l(iso, name) on d.lang = l.iso group by all")
def iso_lang_join(spark, d):
    return docs(spark, d).join(F.broadcast(languages.iso_table(spark)), F.col("lang") == F.col("iso")).groupBy("iso", "name").agg(F.count("*").alias("n_docs"))


@query("select vec_id, true as known, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))), 6) as norm2 from embeddings union all select -1 - vec_id, false, 0.0 from embeddings")
def embed_lookup(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    # Every vector, and as many keys that no vector has.
    asked = vectors.select("vec_id", F.lit(True).alias("known")).union(vectors.select(-1 - F.col("vec_id"), F.lit(False)))
    size = vectors.select(F.size("vec")).first()[0]
    found = X.looked_up(asked, vectors, "vec_id", size)
    norm = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return found.select("vec_id", "known", F.round(norm, 6).alias("norm2"))


@query(
    """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), p as (select a.vec_id as asked, b.vec_id as other, round(list_cosine_similarity(a.e, b.e), 6) as cosine from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by asked order by cosine desc, other) as int) as rank from p) select * from r where rank <= 10"""
)
def cosine_neighbours(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return X.neighbours(vectors, vectors.where("vec_id % 50 = 0"), "vec_id")


_EDGES = """e(child, parent) as (select 'nation ' || n_nationkey, 'region ' || n_regionkey from nation union all select 'region ' || r_regionkey, 'world' from region
union all select 'supplier ' || s_suppkey, 'nation ' || s_nationkey from supplier union all select 'customer ' || c_custkey, 'nation ' || c_nationkey from customer)"""
_TREE = f"""with recursive {_EDGES}, nodes as (select child as node from e union select parent from e), r(node, above, dist) as (select node, node, 0 from nodes union all select r.node, e.parent, r.dist + 1 from r join e on e.child = r.above),
c as (select node, above, min(dist) as dist from r group by all), roots as (select parent as x from e except select child from e),
p(node, top, path, n_steps) as (select node, node, node, 0 from nodes union all select p.node, e.parent, e.parent || ' > ' || p.path, p.n_steps + 1 from p join e on e.child = p.top),
q as (select node, n_steps, path from p where top in (select x from roots)), h as (select node, min(n_steps) as min_depth, max(n_steps) as max_depth from q group by node),
pairs as (select 'nation ' || x.n_nationkey as a, 'supplier ' || s_suppkey as b from nation x cross join supplier),
m as (select a, b, ca.above, ca.dist as da, cb.dist as db from pairs join c ca on ca.node = a join c cb on cb.node = b and cb.above = ca.above), t as (select a, b, min(da + db) as d from m group by all),
lc as (select m.* from m join t using (a, b) where da + db = d),
n as (select 'nation ' || n_nationkey as node, 1 as n from nation union all select 'customer ' || c_custkey, 1 from customer union all select 'supplier ' || s_suppkey, 1 from supplier),
ic as (select above as node, -ln(cast(sum(n.n) as double) / (select sum(n) from n)) as ic from c join n on n.node = c.node group by above)"""


def edges(spark, d):
    t = lambda name: table(spark, d, name)
    label = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))
    nation = t("nation").select(label("nation", "n_nationkey").alias("child"), label("region", "n_regionkey").alias("parent"))
    region = t("region").select(label("region", "r_regionkey"), F.lit("world"))
    supplier = t("supplier").select(label("supplier", "s_suppkey"), label("nation", "s_nationkey"))
    return nation.union(region).union(supplier).union(t("customer").select(label("customer", "c_custkey"), label("nation", "c_nationkey")))


def _pairs(spark, d):
    a = table(spark, d, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("a"))
    return a.crossJoin(F.broadcast(table(spark, d, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("b"))))


@query(f"{_TREE} select node, above, dist from c")
def taxonomy_closure(spark, d):
    return G.closure(edges(spark, d))


@query(f"{_TREE} select * from q")
def taxonomy_paths(spark, d):
    return G.paths(edges(spark, d))


@query(f"{_TREE} select * from h")
def taxonomy_depths(spark, d):
    return G.depths(edges(spark, d))


@query(f"{_TREE} select a, b, above, da, db from lc")
def taxonomy_lch(spark, d):
    return G.common(_pairs(spark, d), G.closure(edges(spark, d)))


_DEEP = "(select max(max_depth) + 1 from h)"
_SIMS = f"select a, b, round(max(1.0 / (da + db + 1)), 6) as path, round(max(-ln(cast(da + db + 1 as double) / (2 * {_DEEP}))), 6) as lch, round(max(2.0 * (max_depth + 1) / (da + db + 2 * (max_depth + 1))), 6) as wup from lc join h on h.node = lc.above group by all"


@query(f"{_TREE} {_SIMS}")
def taxonomy_similarities(spark, d):
    return G.similarities(_pairs(spark, d), edges(spark, d))


@query(
    f"""{_TREE}, s as ({_SIMS}), x as (select a, b, max(i.ic) as most, min(i.ic) as least from lc join ic i on i.node = lc.above group by all), y as (select x.*, ia.ic as ia, ib.ic as ib from x join ic ia on ia.node = a join ic ib on ib.node = b)
select s.*, round(most, 6) + 0.0 as res, case when abs(ia + ib - 2 * least) < 1e-12 then null else round(1 / (ia + ib - 2 * least), 6) end as jcn, case when ia + ib = 0 then 1.0 else round(2 * least / (ia + ib), 6) + 0.0 end as lin from s join y using (a, b)"""
)
def ic_similarities(spark, d):
    tree = edges(spark, d)
    counts = tree.select(F.col("child").alias("node")).where("node not like 'region%'").withColumn("n", F.lit(1))
    return G.similarities(_pairs(spark, d), tree, counts)


_NATIONS = "select 'nation ' || n_nationkey as node from nation"


@query(f"with {_EDGES}, n as ({_NATIONS}) select node, parent as other from n join e on e.child = n.node")
def related_forward(spark, d):
    nodes = _pairs(spark, d).select(F.col("a").alias("node")).distinct()
    return G.related(edges(spark, d), nodes)


@query(f"with {_EDGES}, n as ({_NATIONS}) select node, child as other from n join e on e.parent = n.node")
def related_reverse(spark, d):
    nodes = _pairs(spark, d).select(F.col("a").alias("node")).distinct()
    return G.related(edges(spark, d), nodes, reverse=True)


@query(f"with l as (select role as cond, unnest(regexp_extract_all(lower(text), {W})) as word from conversations) select cond, word, count(*) as freq from l group by all")
def chat_by_role(spark, d):
    return B.cfd(table(spark, d, "conversations"), "role")


@query(r"""with p as (select page_id, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g') as h from pages), q as (select page_id, regexp_replace(h, '<[^>]*>', ' ', 'g') as h from p),
r as (select page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as h from q) select page_id, trim(regexp_replace(h, '[ \t\n\r]+', ' ', 'g'), ' ') as text from r""")
def page_text_extract(spark, d):
    return pages.page_text(table(spark, d, "pages"))


_SPANS = r"""with c as (select doc_id, text, regexp_extract_all(text, '[^ \t\n\r\f]+|[ \t\n\r\f]+') as t from documents), i as (select doc_id, unnest(t) as w, unnest(range(len(t))) as i from c),
p as (select doc_id, w, coalesce(sum(length(w)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as beg from i), k as (select doc_id, w as word, cast(beg as int) as beg, cast(beg + length(w) as int) as "end", row_number() over (partition by doc_id order by beg) - 1 as tok_ix from p where regexp_matches(w, '^[^ \t\n\r\f]'))"""


@query(
    rf"""{_SPANS}, n as (select doc_id, beg, "end", case when regexp_matches(word, '^\p{{N}}') then 'NUM' else 'CAP' end as cat from k where regexp_matches(word, '^\p{{N}}') or (regexp_matches(word, '^\p{{Lu}}\p{{Lu}}'))),
b as (select *, unnest(range(beg // 64, (greatest("end", beg + 1) - 1) // 64 + 1)) as bucket from n)
select k.doc_id, cast(k.tok_ix as int) as tok_ix, k.word, b.cat from k join b on k.doc_id = b.doc_id and k.beg // 64 = b.bucket and k.beg >= b.beg and k."end" <= b."end" """
)
def ner_align(spark, d):
    toks = alignment.placed(docs(spark, d))
    cat = F.when(F.col("word").rlike(r"^\p{N}"), "NUM").when(F.col("word").rlike(r"^\p{Lu}\p{Lu}"), "CAP")
    marks = toks.withColumn("cat", cat).where("cat is not null").select("doc_id", "beg", "end", "cat")
    return alignment.aligned(toks, marks).select("doc_id", "tok_ix", "word", "cat")


@query("select event_type as cond, json_extract_string(props, '$.' || k) as word, k as key, count(*) as freq from events, unnest(json_keys(props)) t(k) group by all")
def event_props(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("cond"), F.explode(F.from_json("props", "map<string,string>")).alias("key", "word"))
    return rows.groupBy("cond", "word", "key").agg(F.count("*").alias("freq"))


@query("select doc_id, case when cast(concat('0x', substr(md5(cast(doc_id as varchar)), 1, 4)) as int) < 45875 then 'train' else 'dev' end as part from documents")
def sample_resample(spark, d):
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int")
    return docs(spark, d).select("doc_id", F.when(place < 45875, "train").otherwise("dev").alias("part"))


_DB = """syn as (select p_partkey as synsetid, ['n', 'v', 'a', 'r'][p_size % 4 + 1] as pos, p_type as definition from part),
nam as (select distinct p_partkey as synsetid, unnest(regexp_split_to_array(lower(p_name), '\\s+')) as lemma from part),
sen as (select lemma, synsetid, pos, cast(row_number() over (partition by lemma, pos order by synsetid) as int) as sensenum from nam join syn using (synsetid)),
ask as (select distinct lower(regexp_split_to_array(p_name, '\\s+')[1]) as lemma from part)"""


def _database(spark, d):
    parts = table(spark, d, "part")
    return D.from_parts(parts), parts.select(F.lower(F.split("p_name", r"\s+")[0]).alias("lemma"))


@query(f"with {_DB} select lemma, synsetid, pos, sensenum, lemma || '.' || pos || '.' || sensenum as name from sen where lemma in (select lemma from ask)")
def lexical_senses(spark, d):
    db, asked = _database(spark, d)
    return db.senses_of(asked)


@query(f"with {_DB} select synsetid, pos, definition from syn where synsetid in (select synsetid from sen where pos = 'n' and lemma in (select lemma from ask))")
def lexical_synsets(spark, d):
    db, asked = _database(spark, d)
    return db.synsets_of(asked, "n")


@query(f"with {_DB} select s.lemma || '.' || s.pos || '.' || s.sensenum as name, synsetid, definition from sen s join syn using (synsetid) where s.sensenum = 1")
def lexical_names(spark, d):
    db, _ = _database(spark, d)
    names = db.senses_of(db.words.select("lemma")).where("sensenum = 1").select("name")
    return db.named(names)


@query(f"with {_DB} select synsetid, p_name as sample from syn join part on p_partkey = synsetid where pos = 'v'")
def lexical_examples(spark, d):
    db, _ = _database(spark, d)
    return db.examples(db.synsets.where("pos = 'v'").select("synsetid"))


@query(f"with {_DB} select synsetid, lemma from nam where synsetid in (select synsetid from syn where pos = 'a')")
def lexical_lemmas(spark, d):
    db, _ = _database(spark, d)
    return db.lemmas(db.synsets.where("pos = 'a'").select("synsetid")).select("synsetid", "lemma")


@query("select p_partkey as synsetid, p_partkey + 1 as other from part where p_partkey % 3 <> 0 and p_partkey + 1 in (select p_partkey from part)")
def lexical_links(spark, d):
    db, _ = _database(spark, d)
    return db.related(db.synsets.select("synsetid"), "hypernym")


@query(
    rf"""with c as (select conv_id, turn, list_filter(regexp_split_to_array(text, '[\n\r]\s*[\n\r]'), lambda p: trim(p) <> '') as ps from conversations where length(text) <= 1000000), p as (select conv_id, turn, unnest(ps) as p from c)
select conv_id, turn, cast(count(*) as bigint) as n_parags, cast(sum(len(regexp_extract_all(p, {W}))) as bigint) as n_words from p group by all"""
)
def service_tokenize(spark, d):
    """The answers, read back from JSON and counted."""
    rows = V.tokenize(table(spark, d, "conversations").withColumn("k", F.struct("conv_id", "turn")), "k")
    got = rows.select("k.*", F.from_json("json", "result array<array<string>>, error string").alias("a")).where("a.error is null and size(a.result) > 0")
    return got.select("conv_id", "turn", F.size("a.result").cast("bigint").alias("n_parags"), F.aggregate("a.result", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x)).alias("n_words"))
