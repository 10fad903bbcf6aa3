"""Readers of corpus formats into tables. ``read_corpus`` picks one by name.

Files are read as whole texts where a format's units span lines, and split inside the row, so
a directory is read in parallel by file. gz files are read like others.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import split_tagged
from ..operators import syntax
from .pages import ENTITIES

def _file():
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def whole(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file and text of every file below a path."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(_file().alias("file"), F.col("value").alias("text"))


def file_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, line_no and value (trimmed)."""
    rows = whole(spark, path, glob).select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "value"))
    return rows.withColumn("value", F.trim("value"))


def dictionary(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """key and value around a line's first separator (no separator: null value); blank lines are
    skipped and the last of repeated keys wins."""
    rows = file_lines(spark, path).where("value <> ''")
    parts = F.split("value", separator, 2)
    rows = rows.select("line_no", parts[0].alias("key"), F.try_element_at(parts, F.lit(2)).alias("value"))
    return rows.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def pattern_from(spark: SparkSession, path: str) -> str:
    """The lines of a small file as one alternation."""
    return "|".join(r["value"] for r in file_lines(spark, path).orderBy("line_no").collect() if r["value"])


_MEMBER = "archive string, member string, data binary"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def walk(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
        if name.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for m in z.namelist():
                    if not m.endswith("/"):
                        yield from walk(m, z.read(m))
        elif name.endswith((".tar.gz", ".tgz", ".tar")):
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile():
                        yield from walk(m.name, t.extractfile(m).read())
        else:
            yield name, data

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = list(walk(path, bytes(content)))
            yield pd.DataFrame({"archive": [path] * len(rows), "member": [n for n, _ in rows], "data": [d for _, d in rows]})


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member and data of zip and tar files, also nested ones."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_members, _MEMBER)


GENRES = dict(zip("abcdefghjklmnpr", ["press-reportage", "press-editorial", "press-reviews", "religion", "skills", "lore", "letters", "miscellaneous", "learned", "fiction", "mystery", "science-fiction", "adventure", "romance", "humor"], strict=True))


def slash_tagged(spark: SparkSession, path: str) -> DataFrame:
    """file, genre (by the name's second letter), parag_ix, sent_ix, tok_ix, word and pos.
    Paragraphs are parted by two empty lines, sentences are lines."""
    rows = whole(spark, path).select("file", F.posexplode(F.split("text", r"\n\n\n")).alias("parag_ix", "parag"))
    rows = rows.select("file", "parag_ix", F.posexplode(F.filter(F.split("parag", r"\n"), lambda x: x.rlike(r"\S"))).alias("sent_ix", "sent"))
    rows = rows.select("file", "parag_ix", "sent_ix", F.posexplode(F.split(F.regexp_replace("sent", r"^\s+|\s+$", ""), r"\s+")).alias("tok_ix", "tok"))
    genre = F.element_at(F.create_map(*(F.lit(x) for kv in GENRES.items() for x in kv)), F.substring("file", 2, 1))
    rows = rows.select("file", genre.alias("genre"), "parag_ix", "sent_ix", "tok_ix", split_tagged(F.col("tok")).alias("t"))
    return rows.select("file", "genre", "parag_ix", "sent_ix", "tok_ix", F.when(F.col("t.word").isin("``", "''"), '"').otherwise(F.col("t.word")).alias("word"), F.upper("t.pos").alias("pos"))


_NODE = StructType([StructField(n, IntegerType()) for n in ("node_id", "parent_id", "child_ix")] + [StructField(n, StringType()) for n in ("label", "word")] + [StructField(n, IntegerType()) for n in ("lo", "hi")])


def bracketed(spark: SparkSession, path: str) -> DataFrame:
    """file, tree_ix and tree: each outermost pair of brackets."""

    def of(texts: pd.Series) -> pd.Series:
        def parts(text: str) -> list[str]:
            out, depth, first = [], 0, 0
            for i, c in enumerate(text):
                if c == "(":
                    first = i if depth == 0 else first
                    depth += 1
                elif c == ")":
                    depth -= 1
                    if depth == 0:
                        out.append(text[first : i + 1])
            return out

        return texts.map(parts)

    return whole(spark, path).select("file", F.posexplode(F.pandas_udf(of, ArrayType(StringType()))("text")).alias("tree_ix", "tree"))


def tree_nodes(trees: DataFrame, clean: bool = True) -> DataFrame:
    """The node table of bracketed trees; without dummies if ``clean``."""

    def of(texts: pd.Series) -> pd.Series:
        def rows(text: str) -> list[dict]:
            tree = syntax.read_tree(text)
            tree = syntax.cleaned(tree) if tree and clean else tree
            return syntax.node_rows(tree) if tree else []

        return texts.map(rows)

    keep = [c for c in trees.columns if c != "tree"]
    return trees.select(*keep, F.explode(F.pandas_udf(of, ArrayType(_NODE))("tree")).alias("n")).select(*keep, "n.*")


def meaning_graphs(spark: SparkSession, path: str) -> DataFrame:
    """file, ix, snt and graph of blocks parted by empty lines."""
    rows = whole(spark, path).select("file", F.posexplode(F.split("text", r"\n\s*\n")).alias("ix", "block"))
    return rows.select("file", "ix", F.regexp_extract("block", r"# ::snt ([^\n]*)", 1).alias("snt"), F.trim(F.regexp_replace("block", r"(?m)^#[^\n]*\n?", "")).alias("graph")).where("graph <> ''")


def offsets_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(texts, marks): .txt files and their .ann files (id, cat, beg, end, text)."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    texts = whole(spark, path, "*.txt").select(stem.alias("doc_id"), "text")
    lines = file_lines(spark, path, "*.ann").where("value <> ''")
    part = lambda i: F.regexp_extract("value", r"^(\S+)\t(\S+) (\d+) (\d+)\t(.*)$", i)
    return texts, lines.select(stem.alias("doc_id"), part(2).alias("cat"), part(3).cast("int").alias("beg"), part(4).cast("int").alias("end"), part(5).alias("text"))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """A row for each element ``tag``."""
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


def chat_posts(spark: SparkSession, path: str) -> DataFrame:
    """class, user, text and the tagged words (word, pos) of posts."""
    rows = xml_rows(spark, path, "Post", "_class string, _user string, _VALUE string, terminals struct<t:array<struct<_pos:string,_word:string>>>")
    return rows.select(F.col("_class").alias("class"), F.col("_user").alias("user"), F.trim("_VALUE").alias("text"), F.transform("terminals.t", lambda t: F.struct(t["_word"].alias("word"), t["_pos"].alias("pos"))).alias("words"))


def newswire(spark: SparkSession, path: str) -> DataFrame:
    """item_id, date, headline, byline, dateline and paragraphs."""
    rows = xml_rows(spark, path, "newsitem", "_itemid int, _date string, headline string, byline string, dateline string, text struct<p:array<string>>")
    return rows.select(F.col("_itemid").alias("item_id"), F.col("_date").alias("date"), "headline", "byline", "dateline", F.col("text.p").alias("paragraphs"))


def sense_tagged(spark: SparkSession, path: str) -> DataFrame:
    """file, ix, cmd, word, lemma, pos, wnsn and lexsn of wf elements with unquoted attributes."""
    rows = whole(spark, path).select("file", F.posexplode(F.regexp_extract_all("text", F.lit(r"<(?:wf|punc)[^>]*>[^<]*<"), F.lit(0))).alias("ix", "e"))
    attr = lambda name: F.nullif(F.regexp_extract("e", rf"[ ]{name}=([^ >]+)", 1), F.lit(""))
    return rows.select("file", "ix", *(attr(a).alias(a) for a in ("cmd", "lemma", "pos", "wnsn", "lexsn")), F.regexp_extract("e", ">([^<]*)<", 1).alias("word"))


def wiki_pages(spark: SparkSession, path: str, keep_markup: bool = False) -> DataFrame:
    """title and text; redirects are skipped, links lose their brackets."""
    rows = xml_rows(spark, path, "page", "title string, revision struct<text:string>").select("title", F.col("revision.text").alias("text"))
    rows = rows.where(~F.lower("text").startswith("#redirect"))
    text = F.col("text")
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return rows.select("title", (text if keep_markup else F.regexp_replace(text, r"[\[\]]", "")).alias("text"))


def chunked_tags(spark: SparkSession, path: str) -> DataFrame:
    """file, sent_ix, tok_ix, word, pos and np_ix (running number of the noun chunk, null
    outside); parts are parted by rules of =, header lines *x* are dropped."""
    parts = whole(spark, path).select("file", F.posexplode(F.split("text", "={38}")).alias("sent_ix", "part"))
    marks = F.regexp_extract_all(F.regexp_replace("part", r"(?m)^\*x\*.*$", ""), F.lit(r"\[|\]|\S+/\S+"), F.lit(0))
    rows = parts.select("file", "sent_ix", F.posexplode(marks).alias("i", "m"))
    order = Window.partitionBy("file", "sent_ix").orderBy("i")
    opened, closed = F.sum((F.col("m") == "[").cast("int")).over(order), F.sum((F.col("m") == "]").cast("int")).over(order)
    rows = rows.withColumn("np_ix", F.when(opened > closed, opened - 1)).where(~F.col("m").isin("[", "]"))
    rows = rows.withColumn("tok_ix", F.row_number().over(order) - 1).select("file", "sent_ix", "tok_ix", "np_ix", split_tagged(F.col("m")).alias("t"))
    return rows.select("file", "sent_ix", "tok_ix", "t.word", "t.pos", "np_ix")


def lemma_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """lemma, lemma_tag, form and tag: lines ``word TAG``; indented ones are forms of the last
    lemma before them."""
    rows = whole(spark, path).select("file", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line")).where(F.trim("line") != "")
    order = Window.partitionBy("file").orderBy("i")
    part = F.split(F.trim("line"), r"\s+")
    own = ~F.col("line").rlike(r"^\s")
    rows = rows.withColumn("head", F.last(F.when(own, F.trim("line")), ignorenulls=True).over(order))
    head = F.split("head", r"\s+")
    return rows.select(head[0].alias("lemma"), head[1].alias("lemma_tag"), part[0].alias("form"), part[1].alias("tag"))


def wiktionary(spark: SparkSession, path: str, language: str = "English") -> DataFrame:
    """word, tag (part of speech) and base (what a form template names, else null) of the
    sections of one language in ``title``/``text`` pages."""
    rows = wiki_pages(spark, path, keep_markup=True)
    section = F.regexp_extract("text", rf"(?s)(?:^|\n)==\s*{language}\s*==\n(.*?)(?:\n==[^=]|$)", 1)
    rows = rows.select(F.col("title").alias("word"), F.explode(F.regexp_extract_all(section, F.lit(r"(?s)===+\s*(?:Noun|Verb|Adjective|Adverb)\s*===+.*?(?=\n===|$)"), F.lit(0))).alias("s"))
    base = F.nullif(F.regexp_extract("s", r"\{\{[a-z ]+ of\|([^}|]+)", 1), F.lit(""))
    return rows.select("word", F.lower(F.regexp_extract("s", r"===+\s*(\w+)", 1)).alias("tag"), base.alias("base"))


def text_vectors(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """word and vec of lines ``word x1 x2 ...``."""
    rows = file_lines(spark, path).where("value <> ''")
    rows = rows.where("line_no > 0") if header else rows
    parts = F.split("value", r"\s+")
    return rows.select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("vec"))


def binary_vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    """file, ix and vec of files of float32 numbers, ``size`` a vector."""
    import numpy as np

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = np.frombuffer(bytes(content), "<f4").reshape(-1, size)
                yield pd.DataFrame({"file": [name.rsplit("/", 1)[-1]] * len(rows), "ix": range(len(rows)), "vec": list(rows)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(of, "file string, ix int, vec array<float>")


def information_counts(spark: SparkSession, path: str) -> DataFrame:
    """synset, pos and n summed over archive members of lines ``<offset><pos> count``."""
    rows = archive_members(spark, path).select(F.explode(F.split(F.decode("data", "UTF-8"), r"\n")).alias("line"))
    part = lambda i: F.regexp_extract("line", r"^(\d+)([a-z]) ([\d.]+)", i)
    return rows.where(F.col("line").rlike(r"^\d+[a-z] ")).groupBy(part(1).cast("int").alias("synset"), part(2).alias("pos")).agg(F.sum(part(3).cast("double")).alias("n"))


READERS: dict[str, Callable[..., DataFrame]] = {"text": whole, "lines": file_lines, "slash-tagged": slash_tagged, "bracketed": bracketed, "graphs": meaning_graphs, "chat": chat_posts, "newswire": newswire, "senses": sense_tagged, "wiki": wiki_pages, "chunked": chunked_tags, "lemmas": lemma_dictionary, "vectors": text_vectors, "archive": archive_members}


def read_corpus(spark: SparkSession, kind: str, path: str, **options: object) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader {kind}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)
