"""Segmentation, normalisation, n-grams, contexts and tables over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import language_model as lm
from ..operators import ngrams as N
from ..operators import tables as B
from ..operators import tokens as K
from . import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

W = r"'[\p{L}\p{N}_]+'"
WS = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]'"
LIST = f"l as (select *, regexp_extract_all(text, {W}) as t from documents)"
TOK = f"with {LIST}, tok as (select doc_id, lang, source, unnest(t) as word, unnest(range(len(t))) as pos from l)"
MARKED = f"with l as (select list_concat(['<S>'], regexp_extract_all(text, {WS}), ['</S>']) as t from documents)"


def docs(spark, d):
    return table(spark, d, "documents")


@query(f"{TOK} select doc_id, cast(pos as int) as pos, word from tok")
def tokenize_basic(spark, d):
    return K.tokens(docs(spark, d))


@query(r"with l as (select doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') as t from documents) select doc_id, cast(unnest(range(len(t))) as int) as pos, unnest(t) as word from l")
def tokenize_chunks(spark, d):
    return K.chunks(docs(spark, d))


_PARAGS = """with l as (select doc_id, regexp_split_to_array(text, '{0}') as t from documents), p as (select doc_id, unnest(range(len(t))) as i, unnest(t) as x from l)
select doc_id, cast(i as int) as parag_ix, trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(160)) as parag from p where length(trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(160))) > 1"""


@query(_PARAGS.format(r"[\n\r]\s*[\n\r]"))
def split_paragraphs(spark, d):
    return K.paragraphs(docs(spark, d))


@query(_PARAGS.format(r"\r?\n|\r"))
def split_lines(spark, d):
    return K.paragraphs(docs(spark, d), r"\r?\n|\r")


@query(r"with l as (select doc_id, string_split(text, chr(10)) as t from documents), p as (select doc_id, unnest(range(len(t))) as i, unnest(t) as line from l) select doc_id, cast(i as int) as line_ix, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as beg, cast(length(line) as int) as n_chars from p")
def line_offsets(spark, d):
    return K.lines(docs(spark, d)).select("doc_id", "line_ix", "beg", F.length("line").alias("n_chars"))


_ABBR = ", ".join(f"'{a}'" for a in K.ABBREVIATIONS)
_ENDS = f"""case when nxt is null then true else
 (case when right(w, 1) in ('.', '?', '!', '…', '¶') then w not in ({_ABBR})
       when right(w, 1) in (')', '"', '''', '»', '”') then length(w) > 1 and substr(w, length(w) - 1, 1) in ('.', '?', '!', '…', '¶') else false end)
 and ((not regexp_matches(nxt, '^\\p{{Ll}}') and not regexp_matches(w, '^\\p{{Lu}}\\.$')) or not regexp_matches(line, '\\p{{Lu}}') or not regexp_matches(line, '\\p{{Ll}}')) end"""


@query(
    rf"""with l as (select doc_id, string_split(text, chr(10)) as t from documents), p as (select doc_id, unnest(range(len(t))) as line_ix, unnest(t) as line from l),
c as (select *, regexp_extract_all(line, '[^ \t\n\r\f]+') as ws from p), x as (select doc_id, line_ix, line, unnest(range(len(ws))) as pos, unnest(ws) as w from c),
n as (select *, lead(w) over (partition by doc_id, line_ix order by pos) as nxt from x), e as (select *, {_ENDS} as ends from n),
s as (select *, coalesce(sum(cast(ends as int)) over (partition by doc_id, line_ix order by pos rows between unbounded preceding and 1 preceding), 0) as sent_ix from e)
select doc_id, cast(line_ix as int) as line_ix, cast(sent_ix as int) as sent_ix, cast(count(*) as int) as n_words, string_agg(w, ' ' order by pos) as sent from s group by all"""
)
def split_sentences(spark, d):
    return K.sentences(docs(spark, d))


@query()
def tokenize_full(spark, d):
    return K.full_tokens(docs(spark, d))


@query()
def joined_text(spark, d):
    return K.joined_sentences(K.sentence_tokens(docs(spark, d)))


@query(f"{TOK} select word, count(*) as freq from tok group by word")
def unigram_freqs(spark, d):
    return N.word_freqs(docs(spark, d))


@query(f"{TOK}, f as (select word, count(*) as freq from tok group by word) select count(*) as n_types, cast(sum(freq) as bigint) as total, max(freq) as most, min(freq) as least from f")
def unigram_stats(spark, d):
    return N.stats(N.word_freqs(docs(spark, d)))


@query(f"{TOK}, f as (select word, count(*) as freq from tok group by word) select word, freq, cast(freq as double) / (select sum(freq) from f) as prob, log2(cast(freq as double) / (select sum(freq) from f)) as logprob from f")
def unigram_probs(spark, d):
    return N.probabilities(N.word_freqs(docs(spark, d)))


@query(f"{TOK}, f as (select word, count(*) as freq from tok group by word) select word, freq from f where freq = (select min(freq) from f)")
def hapaxes(spark, d):
    return N.hapaxes(N.word_freqs(docs(spark, d)))


@query(f"{TOK} select word, count(*) as freq from tok group by word order by freq desc, word limit 50")
def top_words(spark, d):
    return N.top(N.word_freqs(docs(spark, d)), 50, "word")


@query(f"{TOK} select distinct lower(word) as word from tok")
def vocabulary(spark, d):
    return K.tokens(docs(spark, d), keep=()).select(F.lower("word").alias("word")).distinct()


def _grams(n: int, stride: int = 1) -> str:
    cols = ", ".join(f"t[i + {j}] as w{j + 1}" for j in range(n))
    return f"with {LIST}, i as (select t, unnest(range(1, len(t) - {n - 2}, {stride})) as i from l where len(t) >= {n}) select {cols}, count(*) as freq from i group by all"


@query(_grams(2))
def bigram_freqs(spark, d):
    return N.gram_freqs(docs(spark, d), 2)


@query(_grams(3))
def trigram_freqs(spark, d):
    return N.gram_freqs(docs(spark, d), 3)


@query(_grams(2, 2))
def tumbling_bigrams(spark, d):
    return N.gram_freqs(docs(spark, d), 2, stride=2)


@query(f"with f as ({_grams(2)}) select w1, w2, freq, cast(freq as double) / sum(freq) over (partition by w1) as prob from f")
def cond_prob_bigrams(spark, d):
    return N.conditional(N.gram_freqs(docs(spark, d), 2), ["w1"])


@query(
    rf"""with l as (select list_concat(['<S>'], regexp_extract_all(text, {WS})) as t from documents), i as (select t, unnest(range(1, len(t) + 1)) as i from l),
m as (select unnest(case when regexp_matches(t[i], '^[.?!]+$') and (t[i + 1] is null or regexp_matches(t[i + 1], '^\p{{Lu}}')) then [t[i], '<S>'] else [t[i]] end) as word from i),
f as (select word, count(*) as freq from m group by word) select * from f union all select '</S>', freq - 1 from f where word = '<S>'"""
)
def marked_unigrams(spark, d):
    return N.marked_unigrams(docs(spark, d))


@query(
    rf"""{MARKED}, i as (select t, unnest(range(1, len(t))) as i from l where len(t) > 2), p as (select t[i] as a, t[i + 1] as b, regexp_matches(t[i], '^[.?!]+$') and regexp_matches(t[i + 1], '^\p{{Lu}}') as cut from i),
r as (select a as w1, case when cut then '</S>' else b end as w2 from p union all select '<S>', b from p where cut) select w1, w2, count(*) as freq from r group by all"""
)
def marked_bigrams(spark, d):
    return N.marked_bigrams(docs(spark, d))


def _transitions(n: int) -> str:
    start = ", ".join(["'¶'"] * n)
    prefix = " || ' ' || ".join(f"t[i - {j}]" for j in range(1, n + 1))
    return f"with l as (select list_concat([{start}], regexp_extract_all(text, {W})) as t from documents), i as (select t, unnest(range({n + 1}, len(t) + 1)) as i from l where len(t) > {n}), f as (select {prefix} as prefix, t[i] as word, count(*) as freq from i group by all) select *, cast(freq as double) / sum(freq) over (partition by prefix) as weight from f"


@query(_transitions(1))
def word_transitions(spark, d):
    return N.transitions(docs(spark, d))


@query(_transitions(2))
def prefix_transitions_2(spark, d):
    return N.transitions(docs(spark, d), 2)


def _contexts(ignore: bool = False) -> str:
    ctx = "least(p, n) || '_' || greatest(p, n)" if ignore else "p || '_' || n"
    return rf"""{MARKED}, i as (select t, unnest(range(2, len(t))) as i from l where len(t) > 2), x as (select t[i - 1] as p0, t[i] as word, t[i + 1] as n0 from i),
y as (select word, case when regexp_matches(word, '^\p{{Lu}}') and (regexp_matches(p0, '^[.?!]+$') or p0 = '¶') then '<S>' else p0 end as p, case when regexp_matches(n0, '^\p{{Lu}}') and (regexp_matches(word, '^[.?!]+$') or word = '¶') then '</S>' else n0 end as n from x),
f as (select word, {ctx} as context, count(*) as freq from y group by all), c as (select *, cast(freq as double) / sum(freq) over (partition by word) as weight from f)"""


@query(f"{_contexts()} select * from c")
def word_contexts(spark, d):
    return N.contexts(docs(spark, d))


@query(f"{_contexts(True)} select * from c")
def word_contexts_unordered(spark, d):
    return N.contexts(docs(spark, d), ignore_order=True)


@query(f"{_contexts()} select b.word as other, round(sum(a.weight * b.weight), 9) as score from c a join c b using (context) where a.word = 'the' and b.word <> 'the' group by b.word order by score desc, other limit 20")
def similar_words(spark, d):
    return N.similar(N.context_freqs(docs(spark, d)), "the")


@query(f"{_contexts()} select context, a.freq as freq_1, b.freq as freq_2 from c a join c b using (context) where a.word = 'the' and b.word = 'that'")
def common_contexts(spark, d):
    return N.common_contexts(N.contexts(docs(spark, d)), "the", "that")


def _h(x: str) -> str:
    return f"case when {x} = 0 then 0 else ({x}) / t * log2(({x}) / t) end"


@query(
    f"""with f as ({_grams(2)}), x as (select w1, w2, freq, cast(freq as double) as a, cast(sum(freq) over (partition by w1) as double) - freq as b, cast(sum(freq) over (partition by w2) as double) - freq as c, cast((select sum(freq) from f) as double) as t from f),
y as (select *, t - a - b - c as e from x)
select w1, w2, freq, round(2 * t * (({_h('a')}) + ({_h('b')}) + ({_h('c')}) + ({_h('e')}) - (({_h('a + b')}) + ({_h('c + e')})) - (({_h('a + c')}) + ({_h('b + e')}))), 6) as llr from y order by llr desc, w1, w2 limit 20"""
)
def collocations_llr(spark, d):
    return N.collocations(N.gram_freqs(docs(spark, d), 2))


@query(f"{TOK} select lang as cond, lower(word) as word, count(*) as freq from tok group by all")
def cfd_by_lang(spark, d):
    return B.cfd(docs(spark, d), "lang")


@query(f"{TOK} select source as cond, lower(word) as word, count(*) as freq from tok group by all")
def cfd_by_source(spark, d):
    return B.cfd(docs(spark, d), "source")


MODALS = ["the", "and", "of", "that", "with", "de"]


@query(f"{TOK} select source as cond, " + ", ".join(f"count(*) filter (lower(word) = '{w}') as c_{w}" for w in MODALS) + " from tok where lower(word) in ('" + "', '".join(MODALS) + "') group by source")
def tabulate_modal(spark, d):
    return B.tabulated(B.cfd(docs(spark, d), "source", tuple(MODALS)), MODALS)


@query(f"{TOK} select source as cond, " + ", ".join(f"count(*) filter (lower(word) in ('{chr(39) + ', ' + chr(39)}'))".replace(chr(39) + ", " + chr(39), "', '".join(MODALS[: i + 1])) + f" as c_{w}" for i, w in enumerate(MODALS)) + " from tok where lower(word) in ('" + "', '".join(MODALS) + "') group by source")
def tabulate_cumulative(spark, d):
    return B.tabulated(B.cfd(docs(spark, d), "source", tuple(MODALS)), MODALS, cumulative=True)


@query(f"{TOK} select lang, count(*) as n_tokens, count(distinct lower(word)) as n_types, round(cast(count(*) as double) / count(distinct lower(word)), 6) as diversity from tok group by lang")
def lexical_diversity(spark, d):
    return B.lexical_diversity(docs(spark, d), "lang")


@query(f"{TOK} select lower(word) as word, doc_id, cast(pos as int) as pos from tok where lower(word) in ('this', 'which', 'und', 'les')")
def dispersion(spark, d):
    return B.dispersion(docs(spark, d), ("this", "which", "und", "les"))


@query(f"{TOK} select cast(length(word) as int) as len, count(*) as freq from tok group by all")
def word_length_dist(spark, d):
    return B.length_distribution(docs(spark, d))


@query(f"{TOK} select word, count(*) as freq from tok group by word having length(word) > 7 and count(*) > 7")
def long_frequent_words(spark, d):
    return B.long_words(docs(spark, d))


@query(
    r"""with l as (select doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') as t from documents), i as (select doc_id, text, unnest(t) as m, unnest(range(len(t))) as i from l),
p as (select *, coalesce(sum(length(m)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as beg from i)
select doc_id, cast(beg as int) as beg, substr(text, cast(greatest(beg - 25, 0) + 1 as bigint), cast(least(beg, 25) as bigint)) as "left", m as match, substr(text, cast(beg + length(m) + 1 as bigint), 25) as "right" from p where lower(m) = 'heed'"""
)
def kwic_concordance(spark, d):
    return B.concordance(docs(spark, d), "heed")


@query(r"select doc_id, cast(len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x = 'heed')) as int) as n from documents where len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x = 'heed')) > 0")
def kwic_counts(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0))
    return docs(spark, d).select("doc_id", F.size(F.filter(words, lambda x: x == "heed")).alias("n")).where("n > 0")


_AMB = f"{TOK}, c as (select lower(word) as word, lang as cond, count(*) as n from tok group by all)"


@query(f"{_AMB}, w as (select word, cond, n, sum(n) over (partition by word) as freq, row_number() over (partition by word order by n desc, cond desc) as i from c) select word, cond, cast(freq as bigint) as freq from w where i = 1 and freq > 20 and n > 0.97 * freq")
def dominant_condition(spark, d):
    return B.dominant(docs(spark, d), "lang")


@query(f"{_AMB}, w as (select word, count(*) as n_conds, sum(n) as freq from c group by word) select n_conds, count(*) as n_words, cast(sum(freq) as bigint) as volume from w group by n_conds")
def ambiguity_census(spark, d):
    return B.ambiguity(docs(spark, d), "lang")


@query(f"{TOK}, f as (select source, length(word) as len, count(*) as n from tok group by all) select source, cast(len as int) as len, n, cast(sum(n) over (partition by source order by len rows between unbounded preceding and current row) as bigint) as running from f")
def running_length_counts(spark, d):
    counts = K.tokens(docs(spark, d), keep=("source",)).groupBy("source", F.length("word").alias("len")).agg(F.count("*").alias("n"))
    return B.running_counts(counts, "source", "len", "n")


@query(
    r"""select cast(sum(len(regexp_extract_all(text, '[.?!…]'))) as bigint) as n_period, cast(sum(len(regexp_extract_all(text, '[,;:()\-]'))) as bigint) as n_punct, cast(sum(len(regexp_extract_all(text, '["''‘’«»“”]'))) as bigint) as n_quote,
cast(sum(len(regexp_extract_all(text, '[ \t\n\r\x{A0}]'))) as bigint) as n_white, cast(sum(len(regexp_extract_all(text, '\n'))) as bigint) as n_newline, cast(sum(len(regexp_extract_all(text, '\p{Lu}'))) as bigint) as n_upper, cast(sum(len(regexp_extract_all(text, '\p{N}'))) as bigint) as n_digit from documents"""
)
def char_classes(spark, d):
    return B.sign_counts(docs(spark, d))


_CHUNKS = r"with l as (select regexp_extract_all(text, '[^ \t\n\r\f]+') as t from documents), c as (select distinct unnest(t) as word from l)"


@query(
    rf"""{_CHUNKS}, n as (select word, length(replace(string_split(regexp_replace(word, '^-+', ''), '.')[1], ',', '')) as g from c)
select word, case when regexp_matches(word, '^-*[0-9][0-9,\.]+$') then case when g <= 2 then '00' when g = 3 then '00h' when g = 4 then '00k' when g <= 6 then '0kk' when g <= 9 then '00m' else '00+' end
when regexp_matches(word, '^[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+$') then '@__' when regexp_matches(word, '^[A-Za-z]+://[^ ]+$') then '@@@' else lower(word) end as norm from n"""
)
def normalize_tokens(spark, d):
    return K.chunks(docs(spark, d), keep=()).select("word").distinct().withColumn("norm", T.normalized(F.col("word")))


@query(rf"{_CHUNKS} select word, translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '[^\p{{L}}\p{{N}}]+', '-', 'g'), '\p{{N}}+', chr(1), 'g'), '\p{{Lu}}+', chr(2), 'g'), '\p{{L}}+', chr(3), 'g'), chr(1) || chr(2) || chr(3), 'dul') as shape from c")
def word_shapes(spark, d):
    return K.chunks(docs(spark, d), keep=()).select("word").distinct().withColumn("shape", T.word_shape(F.col("word")))


STOPWORDS = ("the", "and", "of", "to", "a", "in", "is", "it", "that", "de", "la", "le", "les", "et", "der", "die", "und", "el", "los", "y")


@query(f"{TOK} select lower(word) as word, count(*) as freq from tok where lower(word) not in ('" + "', '".join(STOPWORDS) + "') group by all")
def stopword_filter(spark, d):
    stop = spark.createDataFrame([(w,) for w in STOPWORDS], "word string")
    return N.word_freqs(docs(spark, d), lower=True).join(F.broadcast(stop), "word", "left_anti")


_PAD = rf"select list_concat(['_s_'], regexp_extract_all(lower(text), {W}), ['_e_']) as t"


@query(
    f"""with f as (select unnest(regexp_extract_all(lower(text), {W})) as w from documents), g as (select w, count(*) as freq from f group by w), t as (select sum(freq) as total from g),
s as (select item_id, unnest(regexp_extract_all(lower(text), {W})) as w from benchmark)
select item_id, count(*) as n_words, case when count(*) = count(freq) then round(sum(log2(cast(freq as double) / total)), 6) end as logprob from s left join g using (w) cross join t group by item_id"""
)
def lm_unigram_logprob(spark, d):
    return lm.unigram_logprob(docs(spark, d), table(spark, d, "benchmark"), "item_id")


_BIGRAM = f"""with l as ({_PAD} from documents), u as (select unnest(t) as w2 from l), o as (select w2, count(*) as f1 from u group by w2), n as (select sum(f1) as total from o),
i as (select t, unnest(range(1, len(t))) as i from l), p as (select t[i] as w1, t[i + 1] as w2, count(*) as freq from i group by all), q as (select w1, w2, cast(freq as double) / sum(freq) over (partition by w1) as p2 from p),
b as ({_PAD}, item_id from benchmark), j as (select item_id, t, unnest(range(1, len(t))) as i from b), a as (select item_id, t[i] as w1, t[i + 1] as w2 from j),
s as (select item_id, count(*) as n_pairs, count(p2) as n_seen, case when count(*) = count(p2) then round(sum(log2(p2)), 6) end as logprob, round(sum(log2(coalesce(p2, 0.4 * f1 / total, 0.16 / total))), 6) as backoff from a left join q using (w1, w2) left join o using (w2) cross join n group by item_id)"""


@query(f"{_BIGRAM} select * from s")
def lm_backoff_score(spark, d):
    return lm.bigram_scores(docs(spark, d), table(spark, d, "benchmark"), "item_id")


@query(f"{_BIGRAM} select round(pow(2.0, -sum(backoff) / sum(n_pairs)), 6) as perplexity from s")
def lm_perplexity(spark, d):
    return lm.perplexity(lm.bigram_scores(docs(spark, d), table(spark, d, "benchmark"), "item_id"), "backoff", "n_pairs")


def _backoff(order: int) -> str:
    starts = ", ".join(["'_s_'"] * (order - 1))
    pad = rf"select list_concat([{starts}], regexp_extract_all(lower(text), {W}), ['_e_']) as t"
    ends = lambda n, i="i": ", ".join(f"t[{i} - {n - j}] as w{order - n + j}" for j in range(1, n + 1))
    cols = lambda n: ", ".join(f"w{order - n + j}" for j in range(1, n + 1))
    out = f"with l as ({pad} from documents), i as (select t, unnest(range({order}, len(t) + 1)) as i from l), b as ({pad}, item_id from benchmark), j as (select item_id, t, unnest(range({order}, len(t) + 1)) as i from b), a as (select item_id, {ends(order)} from j)"
    for n in range(1, order + 1):
        over = f"partition by {', '.join(cols(n).split(', ')[:-1])}" if n > 1 else ""
        out += f", f{n} as (select {ends(n)}, count(*) as f from i group by all), p{n} as (select {cols(n)}, cast(f as double) / sum(f) over ({over}) as p{n} from f{n})"
    joins = " ".join(f"left join p{n} using ({cols(n)})" for n in range(order, 0, -1))
    best = ", ".join(f"{0.4 ** (order - n)!r} * p{n}" for n in range(order, 0, -1))
    return f"{out} select item_id, count(*) as n_words, count(p{order}) as n_seen, round(sum(log2(coalesce({best}, {0.4**order!r} / (select sum(f) from f1)))), 6) as backoff from a {joins} group by item_id"


@query(_backoff(3))
def lm_trigram_backoff(spark, d):
    return lm.backoff_scores(docs(spark, d), table(spark, d, "benchmark"), "item_id", 3)


@query(_backoff(5))
def lm_5gram_backoff(spark, d):
    return lm.backoff_scores(docs(spark, d), table(spark, d, "benchmark"), "item_id", 5)


@query()
def markov_generate(spark, d):
    words = lm.walked(N.transitions(docs(spark, d)), 200, 11)
    return spark.createDataFrame(list(enumerate(words)), "pos int, word string")
