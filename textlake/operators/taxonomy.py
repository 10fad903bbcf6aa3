"""An is-a hierarchy as an edge table; closure by a recursive query, similarities by joins.

``edges`` has child and parent. The closure holds (node, above, dist), a node above itself at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import unique_name


def _recursive(edges: DataFrame, base: str, step: str, columns: str) -> DataFrame:
    """Runs a recursive query over the view {e} of the edges."""
    name = unique_name("edges")
    edges.createOrReplaceTempView(name)
    edges.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", -1)  # a closure may have any number of rows
    return edges.sparkSession.sql(f"WITH RECURSIVE r({columns}) AS ({base.format(e=name)} UNION ALL {step.format(e=name)}) SELECT * FROM r")


def closure(edges: DataFrame) -> DataFrame:
    """node, above and the least dist."""
    found = _recursive(edges, "SELECT node, node, 0 FROM (SELECT child AS node FROM {e} UNION SELECT parent FROM {e})", "SELECT r.node, e.parent, r.dist + 1 FROM r JOIN {e} e ON e.child = r.above", "node, above, dist")
    return found.groupBy("node", "above").agg(F.min("dist").alias("dist"))


def paths(edges: DataFrame) -> DataFrame:
    """node, n_steps and path: every way to a root, joined by ' > ' from the root down."""
    found = _recursive(edges, "SELECT node, node, CAST(node AS STRING), 0 FROM (SELECT child AS node FROM {e} UNION SELECT parent FROM {e})", "SELECT r.node, e.parent, concat(e.parent, ' > ', r.path), r.n_steps + 1 FROM r JOIN {e} e ON e.child = r.at", "node, at, path, n_steps")
    roots = edges.select(F.col("parent").alias("at")).distinct().join(edges.select(F.col("child").alias("at")), "at", "left_anti")
    return found.join(F.broadcast(roots), "at", "left_semi").select("node", "n_steps", "path")


def depths(edges: DataFrame) -> DataFrame:
    """node, min_depth and max_depth below a root."""
    return paths(edges).groupBy("node").agg(F.min("n_steps").alias("min_depth"), F.max("n_steps").alias("max_depth"))


def related(edges: DataFrame, nodes: DataFrame, reverse: bool = False) -> DataFrame:
    """node and other: parents of the nodes, or children if reversed."""
    a, b = ("parent", "child") if reverse else ("child", "parent")
    return nodes.join(edges.select(F.col(a).alias("node"), F.col(b).alias("other")), "node")


def common(pairs: DataFrame, above: DataFrame) -> DataFrame:
    """a, b, above, da, db: the common ancestors of least da + db (all of them)."""
    x = above.select(F.col("node").alias("a"), "above", F.col("dist").alias("da"))
    y = above.select(F.col("node").alias("b"), "above", F.col("dist").alias("db"))
    every = pairs.join(x, "a").join(y, ["b", "above"])
    least = every.groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("d"))
    return every.join(least, ["a", "b"]).where(F.col("da") + F.col("db") == F.col("d")).select("a", "b", "above", "da", "db")


def path_similarity(da: Column, db: Column) -> Column:
    return 1 / (da + db + 1)


def lch_similarity(da: Column, db: Column, deepest: Column) -> Column:
    return -F.log((da + db + 1) / (2 * deepest))


def wup_similarity(da: Column, db: Column, depth: Column) -> Column:
    return 2 * depth / (da + db + 2 * depth)


def similarities(pairs: DataFrame, edges: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """a, b, path, lch and wup (depths count a root as 1); with ``counts`` (node, n) also res, jcn
    and lin on information content, the negative log of a node's share of all its
    descendants' counts."""
    above = closure(edges)
    depth = depths(edges).select(F.col("node").alias("above"), (F.col("max_depth") + 1).alias("depth"))
    deepest = depth.agg(F.max("depth").alias("deepest"))
    rows = common(pairs, above).join(depth, "above").crossJoin(F.broadcast(deepest))
    da, db = F.col("da"), F.col("db")
    out = rows.groupBy("a", "b").agg(
        F.round(F.max(path_similarity(da, db)), 6).alias("path"),
        F.round(F.max(lch_similarity(da, db, F.col("deepest"))), 6).alias("lch"),
        F.round(F.max(wup_similarity(da, db, F.col("depth"))), 6).alias("wup"),
    )
    if counts is None:
        return out
    content = information(edges, counts)
    ic = lambda c: content.select(F.col("node").alias(c), F.col("ic").alias(f"ic_{c}"))
    shared = rows.join(ic("above"), "above").groupBy("a", "b").agg(F.max("ic_above").alias("most"), F.min("ic_above").alias("least"))
    shared = shared.join(ic("a"), "a").join(ic("b"), "b")
    apart = F.col("ic_a") + F.col("ic_b") - 2 * F.col("least")
    shared = shared.select("a", "b", (F.round("most", 6) + 0.0).alias("res"), F.when(F.abs(apart) < 1e-12, F.lit(None)).otherwise(F.round(1 / apart, 6)).alias("jcn"), F.when(F.col("ic_a") + F.col("ic_b") == 0, 1.0).otherwise(F.round(2 * F.col("least") / (F.col("ic_a") + F.col("ic_b")), 6) + 0.0).alias("lin"))
    return out.join(shared, ["a", "b"])


def information(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """node and ic."""
    under = closure(edges).join(counts.withColumnRenamed("node", "leaf"), F.col("node") == F.col("leaf")).groupBy(F.col("above").alias("node")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return under.crossJoin(F.broadcast(total)).select("node", (-F.log(F.col("n") / F.col("total"))).alias("ic"))
