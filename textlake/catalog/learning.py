"""Metrics, split criteria and learners on ``labels`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_ROWS = "with r as (select quality as gold, case when n_chars >= 600 then 1 else 0 end as guess from labels join documents using (doc_id))"


def guessed(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("quality").alias("gold"), F.when(F.col("n_chars") >= 600, 1).otherwise(0).alias("guess"))


@query(f"{_ROWS} select count(*) as n, round(avg(case when gold = guess then 100.0 else 0.0 end), 6) as accuracy from r")
def accuracy(spark, d):
    return M.accuracy(guessed(spark, d))


@query(f"{_ROWS} select gold, guess, count(*) as n from r group by all")
def confusion_matrix(spark, d):
    return M.confusion(guessed(spark, d))


@query(
    f"""{_ROWS}, c as (select gold as class, count(*) as n, count(*) filter (gold = guess) as tp from r group by gold), s as (select c.*, (select count(*) from r where guess = c.class) as said from c),
m as (select cast(class as varchar) as class, n, case when tp > 0 then cast(tp as double) / said else 0.0 end as prec, case when tp > 0 then cast(tp as double) / n else 0.0 end as rec from s), f as (select class, case when prec > 0 then 2 * prec * rec / (prec + rec) else 0.0 end as f, prec, rec, n from m)
select class, round(f, 6) as f, round(prec, 6) as prec, round(rec, 6) as rec, n from f union all select 'avg', round(avg(f), 6), round(avg(prec), 6), round(avg(rec), 6), count(*) from f
union all select 'wavg', round(sum(f * n) / sum(n), 6), round(sum(prec * n) / sum(n), 6), round(sum(rec * n) / sum(n), 6), cast(sum(n) as bigint) from f"""
)
def class_metrics(spark, d):
    return M.class_metrics(guessed(spark, d))


_FEATURES = ["lang", "source", "toxic"]
_P = lambda n, t: f"case when {n} > 0 then -cast({n} as double) / {t} * log2(cast({n} as double) / {t}) else 0.0 end"


@query(
    "with d as (select lang, source, cast(toxic as varchar) as toxic, quality from labels join documents using (doc_id)), p as ("
    + " union all ".join(f"select '{f}' as feature, {f} as value, quality as g from d" for f in _FEATURES)
    + f""" ), c as (select feature, value, count(*) as n, sum(g) as pos, count(*) - sum(g) as neg from p group by all), t as (select feature, sum(n) as tn, sum(pos) as tp, sum(neg) as tq from c group by feature)
select feature, round(sum(cast(n as double) / tn * ({_P('pos', 'n')} + {_P('neg', 'n')})), 6) as entropy, round(any_value({_P('tp', 'tn')} + {_P('tq', 'tn')}) - sum(cast(n as double) / tn * ({_P('pos', 'n')} + {_P('neg', 'n')})), 6) as info_gain,
round(sum({_P('n', 'tn')}), 6) as split_info, round(sum(cast(n as double) / tn * (1 - pow(cast(pos as double) / n, 2) - pow(cast(neg as double) / n, 2))), 6) as gini_split from c join t using (feature) group by feature"""
)
def split_criteria(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return M.split_criteria(rows, _FEATURES, "quality")


@query("select round(sqrt(sum(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))))), 6) as norm from embeddings")
def frobenius_norm(spark, d):
    return M.frobenius(table(spark, d, "embeddings"), "embedding")
