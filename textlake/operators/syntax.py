"""Trees and dependencies: reading, normal forms, parsing, rendering.

A tree is a tuple (label, child, ...) with strings as leaves. Trees are recursive, which
column types are not, so these are kernels that run inside pandas functions; tables hold
bracketed strings or node rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

Tree = tuple


class Improper(ValueError):
    """A tree with a label that isn't a label or words beside subtrees."""


def read_tree(text: str) -> Tree | None:
    """The bracketed tree of a text; an extra outer pair of brackets is dropped."""
    stack: list[list] = [[]]
    for part in re.findall(r"[()]|[^\s()]+", text):
        if part == "(":
            stack.append([])
        elif part == ")":
            if len(stack) < 2:
                raise Improper("a bracket closes nothing")
            done = tuple(stack.pop())
            stack[-1].append(done)
        else:
            stack[-1].append(part)
    if len(stack) > 1:
        raise Improper("a bracket stays open")
    if not stack[0]:
        return None
    tree = stack[0][0]
    while isinstance(tree, tuple) and len(tree) == 1 and isinstance(tree[0], tuple):
        tree = tree[0]
    return tree


def write_tree(tree: Tree | str | None) -> str:
    if tree is None:
        return ""
    return tree if isinstance(tree, str) else "(" + " ".join(map(write_tree, tree)) + ")"


def leaves(tree: Tree) -> list[tuple[str, str]]:
    """(word, tag) of the leaves."""
    if len(tree) == 2 and isinstance(tree[1], str):
        return [(tree[1], tree[0])]
    return [x for child in tree[1:] for x in leaves(child)]


def cleaned(tree: Tree) -> Tree | None:
    """Without -NONE- subtrees and what is empty then; labels without what follows a dash."""
    if tree[0] == "-NONE-":
        return None
    label = re.sub(r"(?<=.)-.*$", "", tree[0])
    if len(tree) == 2 and isinstance(tree[1], str):
        return (label, tree[1])
    rest = [c for c in (cleaned(child) for child in tree[1:]) if c is not None]
    return (label, *rest) if rest else None


def node_rows(tree: Tree) -> list[dict]:
    """node_id, parent_id, child_ix, label, word, lo and hi (leaf range) of every node."""
    rows: list[dict] = []
    at = 0

    def walk(node: Tree, parent: int, ix: int) -> None:
        nonlocal at
        row = {"node_id": len(rows), "parent_id": parent, "child_ix": ix, "label": node[0], "word": None, "lo": at, "hi": at}
        rows.append(row)
        if len(node) == 2 and isinstance(node[1], str):
            row["word"] = node[1]
            at += 1
        else:
            for i, child in enumerate(node[1:]):
                walk(child, row["node_id"], i)
        row["hi"] = at

    walk(tree, -1, 0)
    return rows


def _proper(node: Tree) -> None:
    if not isinstance(node[0], str) or (len(node) > 2 and any(isinstance(c, str) for c in node[1:])) or any(isinstance(c, tuple) and (not c or c[0][:1] == '"') for c in node[1:]):
        raise Improper(f"{write_tree(node)} is improper")


def to_cnf(tree: Tree | None) -> Tree | None:
    """Unary chains become one label joined by +; more than two children pair up from the left
    under labels joined by _."""
    if not tree:
        return None
    _proper(tree)
    if len(tree) == 2:
        child = tree[1]
        return tree if isinstance(child, str) else to_cnf((f"{tree[0]}+{child[0]}", *child[1:]))
    parts = [to_cnf(c) for c in tree[1:]]
    names = [c[0] for c in tree[1:]]
    left = parts[0]
    for i in range(1, len(parts) - 1):
        left = ("_".join(names[: i + 1]), left, parts[i])
    return (tree[0], left, parts[-1])


def from_cnf(tree: Tree | None) -> Tree | None:
    """The inverse of ``to_cnf``."""

    def of(node: Tree | str) -> list:
        if isinstance(node, str):
            return [node]
        _proper(node)
        inner = [x for child in node[1:] for x in of(child)]
        if "+" in node[0]:
            *outer, last = node[0].split("+")
            built: Tree = (last, *inner)
            for label in reversed(outer):
                built = (label, built)
            return [built]
        return inner if "_" in node[0] else [(node[0], *inner)]

    return of(tree)[0] if tree else None


def grammar(trees: Iterable[Tree]) -> dict[tuple, float]:
    """Rules (lhs, word) and (lhs, left, right) of trees in normal form with their shares."""
    counts: dict[tuple, int] = {}
    whole: dict[str, int] = {}

    def walk(node: Tree) -> None:
        rule = (node[0], node[1]) if isinstance(node[1], str) else (node[0], *(c[0] for c in node[1:]))
        counts[rule] = counts.get(rule, 0) + 1
        whole[node[0]] = whole.get(node[0], 0) + 1
        for child in node[1:]:
            if not isinstance(child, str):
                walk(child)

    for tree in trees:
        walk(tree)
    return {rule: n / whole[rule[0]] for rule, n in counts.items()}


def cky(words: list[str], rules: dict[tuple, float], root: str = "TOP", n_best: int = 1, tags: list[str] | None = None) -> list[tuple[float, Tree]]:
    """The ``n_best`` most likely parses (natural log, tree), best first; given ``tags``, words
    have these. Without one from the root, those of any symbol over the whole."""
    lexical: dict[str, list[tuple[str, float]]] = {}
    binary: dict[tuple[str, str], list[tuple[str, float]]] = {}
    for rule, q in sorted(rules.items()):
        if len(rule) == 2:
            lexical.setdefault(rule[1], []).append((rule[0], math.log(q)))
        else:
            binary.setdefault(rule[1:], []).append((rule[0], math.log(q)))
    n = len(words)
    chart: dict[tuple[int, int], dict[str, list[tuple[float, Tree]]]] = {}
    for i, word in enumerate(words):
        own = [(tags[i], 0.0)] if tags else lexical.get(word, [])
        chart[i, i + 1] = {tag: [(p, (tag, word))] for tag, p in own}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cell: dict[str, list[tuple[float, Tree]]] = {}
            for k in range(i + 1, i + size):
                for b, lefts in chart[i, k].items():
                    for c, rights in chart[k, i + size].items():
                        for lhs, p in binary.get((b, c), ()):
                            cell.setdefault(lhs, []).extend((p + x + y, (lhs, s, t)) for x, s in lefts for y, t in rights)
            chart[i, i + size] = {lhs: heapq.nlargest(n_best, found, key=lambda f: f[0]) for lhs, found in cell.items()}
    top = chart.get((0, n), {})
    found = [x for label, rows in top.items() if label.split("+")[0] == root for x in rows] or [x for rows in top.values() for x in rows]
    return [(p, from_cnf(t)) for p, t in heapq.nlargest(n_best, found, key=lambda f: f[0])]


DEP = StructType([StructField(n, t) for n, t in (("rel", StringType()), ("head_id", IntegerType()), ("head", StringType()), ("tail_id", IntegerType()), ("tail", StringType()))])


def stanford_deps(lines: DataFrame, line: str = "value") -> DataFrame:
    """rel, head, head_id, tail, tail_id of lines ``rel(head-i, tail-j)``."""
    pattern = r"^\s*([^\s(]+)\s*\(\s*(.+)-(\d+)\s*,\s*(.+)-(\d+)\s*\)\s*$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    rows = lines.where(F.col(line).rlike(pattern))
    out = rows.select(*[c for c in lines.columns if c != line], part(1).alias("rel"), part(3).cast("int").alias("head_id"), part(2).alias("head"), part(5).cast("int").alias("tail_id"), part(4).alias("tail"))
    return out.withColumn("head_id", F.when(F.col("rel") == "root", 0).otherwise(F.col("head_id")))


def conll_deps(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """sent_id, tail_id, tail, lemma, pos, head_id and rel of 8-column lines; blank lines part
    sentences, whose number is their running count within the file."""
    from pyspark.sql import Window

    blank = (F.trim(line) == "").cast("int")
    rows = lines.withColumn("sent_id", F.sum(blank).over(Window.partitionBy("file").orderBy(order))).where(F.trim(line) != "")
    c = lambda i: F.nullif(F.split(line, "\t")[i], F.lit("_"))
    return rows.select("file", "sent_id", c(0).cast("int").alias("tail_id"), c(1).alias("tail"), c(2).alias("lemma"), c(3).alias("pos"), c(6).cast("int").alias("head_id"), c(7).alias("rel"))


def deps_text(deps: DataFrame) -> DataFrame:
    return deps.withColumn("line", F.format_string("%s(%s-%d, %s-%d)", "rel", "head", "head_id", "tail", "tail_id"))


def conll_text(deps: DataFrame) -> DataFrame:
    return deps.withColumn("line", F.concat_ws("\t", F.col("tail_id"), "tail", F.coalesce("lemma", F.lit("_")), F.coalesce("pos", F.lit("_")), F.lit("_"), F.lit("_"), F.col("head_id"), "rel"))


def deps_tree(deps: list[tuple[str, int, int, str]]) -> str:
    """(rel, head_id, tail_id, tail) rows of a sentence as nested brackets, in word order."""
    under: dict[int, list] = {}
    for rel, head, tail, word in deps:
        under.setdefault(head, []).append((tail, rel, word))

    def of(tail: int, rel: str, word: str) -> str:
        parts = [(tail, word)] + [(t, of(t, r, w)) for t, r, w in under.get(tail, ())]
        return f"({rel} " + " ".join(x for _, x in sorted(parts)) + ")"

    return " ".join(of(*row) for row in sorted(under.get(0, ())))


def render_tree(tree: Tree) -> list[str]:
    """The tree as lines of text, the root above and the words below."""

    def built(node: Tree | str) -> dict:
        if isinstance(node, str):
            return {"label": node, "children": [], "width": len(node), "level": 0}
        children = [built(c) for c in node[1:]]
        width = sum(c["width"] for c in children) + len(children) - 1
        lack = len(node[0]) - width
        for i in range(max(lack, 0)):
            widen(children[i % len(children)], 1)
        return {"label": node[0], "children": children, "width": max(width, len(node[0])), "level": 1 + max(c["level"] for c in children)}

    def widen(node: dict, by: int) -> None:
        node["width"] += by
        if node["children"]:
            widen(node["children"][-1], by)

    top = built(tree)
    size = top["width"] + 1
    rows = {y: [" "] * size for y in range(2 * top["level"] + 1)}

    def put(y: int, x: int, text: str) -> None:
        rows[y][x : x + len(text)] = text

    def draw(node: dict, x: int) -> int:
        y = 2 * node["level"]
        put(y, x + math.ceil((node["width"] - len(node["label"])) / 2), node["label"])
        centers, at = [], x
        for child in node["children"]:
            center = draw(child, at)
            for z in range(2 * child["level"] + 1, y - 1):
                put(z, center, ":")
            centers.append(center)
            at += child["width"] + 1
        if len(centers) == 1:
            put(y - 1, centers[0], ":")
        elif centers:
            put(y - 1, centers[0], "-" * (centers[-1] - centers[0]))
            for c in centers[1:-1]:
                put(y - 1, c, ":")
            put(y - 1, centers[0], ".")
            put(y - 1, centers[-1], ".")
        return x + math.ceil((node["width"] - 1) / 2)

    draw(top, 0)
    return ["".join(rows[y]) for y in sorted(rows, reverse=True)]


def render_tags(pairs: list[tuple[str, str]]) -> list[str]:
    """Tags above words, centred in columns."""
    widths = [max(len(w), len(t)) for w, t in pairs]

    def line(texts: list[str]) -> str:
        out = ""
        for text, width in zip(texts, widths, strict=True):
            left = math.ceil((width - len(text)) / 2)
            out += " " * left + text + " " * (width - len(text) - left) + " "
        return out

    return [line([t for _, t in pairs]), line([w for w, _ in pairs])]


def render_deps(deps: list[tuple[str, int, int, str]]) -> list[str]:
    """One arc a line under the words, shortest first: > marks the dependent's end."""
    words = sorted({(tail, word) for _, _, tail, word in deps})
    at, x = {}, 0
    for tail, word in words:
        at[tail] = x + len(word) // 2
        x += len(word) + 1
    out = [" ".join(w for _, w in words)]
    for rel, head, tail, _ in sorted(deps, key=lambda d: (abs(d[1] - d[2]) if d[1] else 10**9, d[2])):
        if head == 0:
            out.append(" " * at[tail] + "^ " + rel)
            continue
        lo, hi = sorted((at[head], at[tail]))
        body = f" {rel} ".center(max(hi - lo - 1, len(rel) + 2), ".")
        out.append(" " * lo + ("<" if at[tail] == lo else "`") + body + (">" if at[tail] == hi else "´"))
    return out


def tree_column(kernel, text: Column) -> Column:
    """A string column of a kernel over bracketed trees, Arrow batch by batch."""

    def of(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else kernel(read_tree(t)))

    return F.pandas_udf(of, "string")(text)


def lines_column(kernel, text: Column) -> Column:
    def of(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else kernel(read_tree(t)))

    return F.pandas_udf(of, ArrayType(StringType()))(text)
