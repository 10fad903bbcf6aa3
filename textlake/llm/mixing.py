"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of copies, shared among its documents in proportion to their
length. A document's whole copies are certain; what remains is its inclusion chance p, and of
each source exactly as many more documents are taken as its remains add up to: those of the
least u (1 - p) / ((1 - u) p), with u a hash of the document's id. The place where a source is
cut is found from counts in buckets of this rank, so no source is sorted as a whole and
documents are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each doubling of the rank.
FINENESS = 256


def uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1 from 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(docs: DataFrame, total: int | None = None, weights: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, n_docs, n_chars and the target number of copies of each source.

    ``weights`` gives the shares (sources that it doesn't name get none); without it shares
    go as the square root of the number of documents. ``total`` is the number of copies, that
    of the documents by default. Whole numbers come by largest remainders, ties by name. A
    source without characters can't be sampled and has no share.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length(text_col).cast("bigint")), F.lit(0)).alias("n_chars"))
    if weights is None:
        share = F.floor(F.sqrt(F.col("n_docs").cast("double")) * 1_000_000)
    elif not weights:
        share = F.lit(0)
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], round(pair[1] * 1_000_000))])
        share = F.coalesce(F.try_element_at(named, F.coalesce(F.col("source"), F.lit(""))), F.lit(0))
    sizes = sizes.withColumn("__share", F.when(F.col("n_chars") > 0, share).otherwise(0).cast("bigint"))
    whole = Window.partitionBy()  # one row for each source
    sizes = sizes.withColumn("__all", F.sum("__share").over(whole)).withColumn("__n", F.lit(total).cast("bigint") if total is not None else F.sum("n_docs").over(whole))
    sizes = sizes.where("__all > 0").withColumn("__floor", F.expr("__n * __share div __all")).withColumn("__rest", F.expr("__n * __share % __all"))
    more = F.col("__n") - F.sum("__floor").over(whole)
    place = F.row_number().over(Window.orderBy(F.desc("__rest"), F.asc_nulls_first("source")))
    return sizes.withColumn("__more", more).select("source", "n_docs", "n_chars", (F.col("__floor") + (place <= F.col("__more")).cast("bigint")).alias("target"))


def sampled(docs: DataFrame, total: int | None = None, weights: dict[str, float] | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with a column n_copies, only rows with one copy at least.

    A null source is a source. Null and empty texts have no chance. Null ids share a hash.
    Ties of rank go by id and then by a hash of the text; rows that agree in all of these at
    the cut stay or go together, which may change the size by their number. Other columns
    are carried, whatever their names (n_copies is replaced). An empty table stays empty.
    """
    names = [c for c in docs.columns if c != "n_copies"]
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column is named as one below
    inner = docs.toDF(*place.values())
    id_col, source_col, text_col = place[id_col], place[source_col], place[text_col]
    goal = targets(inner, total, weights, source_col, text_col).select(F.col("source").alias("__source"), F.col("n_chars").alias("__chars"), F.col("target").alias("__target"))
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")

    def ranked(columns: list[Column]) -> DataFrame:
        x = inner.select(*columns, F.col(source_col).alias("__s"), F.col(id_col).cast("bigint").alias("__id"), size.alias("__size"), F.xxhash64(text_col).alias("__tie")).where("__size > 0")
        x = x.join(goal, F.col("__s").eqNullSafe(F.col("__source")))
        x = x.withColumn("__whole", F.expr("__target * __size div __chars")).withColumn("__part", F.expr("__target * __size % __chars"))
        p, u = F.col("__part").cast("double") / F.col("__chars").cast("double"), uniform(F.col("__id"), seed)
        rank = F.when(F.col("__part") > 0, u * (1 - p) / ((1 - u) * p))
        return x.withColumn("__rank", rank).withColumn("__bucket", F.floor(F.log2("__rank") * FINENESS))

    slim = ranked([])
    counts = slim.groupBy("__s", "__bucket").agg(F.count("*").alias("__n"), F.sum("__whole").alias("__w"), F.first("__target").alias("__t"))
    by = Window.partitionBy("__s")
    counts = counts.withColumn("__need", F.first("__t").over(by) - F.sum("__w").over(by)).where("__bucket is not null")
    counts = counts.withColumn("__below", F.sum("__n").over(by.orderBy("__bucket")) - F.col("__n"))
    cut = counts.where("__below < __need and __need <= __below + __n").select(F.col("__s").alias("__cs"), F.col("__bucket").alias("__cb"), (F.col("__need") - F.col("__below")).alias("__left"))
    edge = slim.join(cut, F.col("__s").eqNullSafe(F.col("__cs")) & (F.col("__bucket") == F.col("__cb")))
    edge = edge.withColumn("__row", F.row_number().over(Window.partitionBy("__s").orderBy("__rank", "__id", "__tie"))).where("__row = __left")
    edge = edge.select(F.col("__s").alias("__es"), F.struct("__rank", "__id", "__tie").alias("__edge"))
    kept = [F.col(place[c]) for c in names]
    full = ranked(kept).join(edge, F.col("__s").eqNullSafe(F.col("__es")), "left")
    taken = F.col("__rank").isNotNull() & F.col("__edge").isNotNull() & (F.struct("__rank", "__id", "__tie") <= F.col("__edge"))
    full = full.withColumn("n_copies", F.col("__whole") + F.coalesce(taken, F.lit(False)).cast("bigint"))
    return full.where("n_copies > 0").select(*kept, "n_copies").toDF(*names, "n_copies")


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` with each row as many times as it has copies, for a corpus on disk; a column
    n_copies of ``docs`` is carried. Else as ``sampled``."""
    rows = sampled(docs.toDF(*(f"x{i}" for i in range(len(docs.columns)))), **{k: f"x{docs.columns.index(options.get(k, c))}" for k, c in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))}, **{k: v for k, v in options.items() if not k.endswith("_col")})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).drop("n_copies", "copy").toDF(*docs.columns)


ORACLE_SQL = """
with sizes as (select source, count(*) as n_docs, sum(length(text)) as n_chars from documents group by source),
shares as (select *, cast(floor(sqrt(cast(n_docs as double)) * 1000000) as hugeint) as share from sizes where n_chars > 0),
whole as (select *, (select sum(n_docs) from sizes) as n, sum(share) over () as every from shares),
floors as (select *, (n * share) // every as low, (n * share) % every as rest from whole),
goal as (select source, n_chars, low + case when row_number() over (order by rest desc, source nulls first) <= n - sum(low) over () then 1 else 0 end as target from floors),
ranked as (
  select d.doc_id, d.source, d.text, (target * length(d.text)) // g.n_chars as whole, target,
    cast((target * length(d.text)) % g.n_chars as double) / cast(g.n_chars as double) as p,
    (cast(cast(concat('0x', substr(md5(concat('7-', coalesce(cast(d.doc_id as varchar), ''))), 1, 13)) as bigint) as double) + 0.5) / 4503599627370496.0 as u
  from documents d join goal g on d.source is not distinct from g.source where length(d.text) > 0),
placed as (
  select *, row_number() over (partition by source order by case when p > 0 then 0 else 1 end, u * (1 - p) / ((1 - u) * p), doc_id) as place,
    target - sum(whole) over (partition by source) as need from ranked)
select doc_id, source, cast(whole + case when p > 0 and place <= need then 1 else 0 end as bigint) as n_copies
from placed where whole + case when p > 0 and place <= need then 1 else 0 end > 0
"""
