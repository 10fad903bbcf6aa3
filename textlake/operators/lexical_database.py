"""A lexical database as tables: words, senses, synsets, samples and link types, asked by joins.

words(wordid, lemma), synsets(synsetid, pos, definition), senses(wordid, synsetid, sensenum),
samples(synsetid, sample), linktypes(linkid, link, recurses) and semlinks(synset1id, synset2id,
linkid). Every question takes a table of what is asked and gives a table, so any number of
questions are one plan; a question without an answer has no rows. Nulls match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def synset_name(lemma: Column, pos: Column, number: Column) -> Column:
    """word.pos.n, blanks of the word as underscores."""
    return F.concat_ws(".", F.replace(lemma, F.lit(" "), F.lit("_")), pos, number.cast("string"))


def sense_name(word: Column, lemma: Column, pos: Column, number: Column) -> Column:
    """word~lemma.pos.n"""
    return F.concat_ws("~", word, synset_name(lemma, pos, number))


@dataclass
class LexicalDatabase:
    words: DataFrame
    senses: DataFrame
    synsets: DataFrame
    samples: DataFrame
    linktypes: DataFrame
    semlinks: DataFrame

    def lemmas(self, synsetids: DataFrame) -> DataFrame:
        """synsetid, wordid and lemma: the words of synsets."""
        return synsetids.select("synsetid").distinct().join(self.senses, "synsetid").join(self.words, "wordid").select("synsetid", "wordid", "lemma")

    def words_with_senses(self) -> DataFrame:
        """wordid and lemma of the words that have a sense."""
        return self.words.join(self.senses, "wordid", "left_semi").select("wordid", "lemma")

    def senses_of(self, lemmas: DataFrame, pos: str | None = None) -> DataFrame:
        """lemma, synsetid, pos, sensenum and name of the senses of words, of one part of speech if given."""
        rows = lemmas.select("lemma").distinct().join(self.words, "lemma").join(self.senses, "wordid").join(self.synsets, "synsetid")
        rows = rows if pos is None else rows.where(F.col("pos") == pos)
        return rows.select("lemma", "synsetid", "pos", "sensenum", synset_name(F.col("lemma"), F.col("pos"), F.col("sensenum")).alias("name"))

    def synsets_of(self, lemmas: DataFrame, pos: str | None = None) -> DataFrame:
        """synsetid, pos and definition of the synsets that words are in, each once."""
        found = self.senses_of(lemmas, pos)
        return self.synsets.join(found, "synsetid", "left_semi").select("synsetid", "pos", "definition")

    def named(self, names: DataFrame) -> DataFrame:
        """name, synsetid and definition of synsets by names word.pos.n."""
        parts = F.split("name", r"\.")
        asked = names.select("name", F.replace(F.array_join(F.slice(parts, 1, F.size(parts) - 2), "."), F.lit("_"), F.lit(" ")).alias("lemma"), F.try_element_at(parts, F.lit(-2)).alias("pos"), F.try_element_at(parts, F.lit(-1)).cast("int").alias("sensenum")).where(F.size(parts) > 2)
        rows = asked.join(self.words, "lemma").join(self.senses, ["wordid", "sensenum"]).join(self.synsets, ["synsetid", "pos"])
        return rows.select("name", "synsetid", "definition")

    def examples(self, synsetids: DataFrame) -> DataFrame:
        """synsetid and sample."""
        return self.samples.join(synsetids, "synsetid", "left_semi").select("synsetid", "sample")

    def related(self, synsetids: DataFrame, link: str, reverse: bool = False) -> DataFrame:
        """synsetid and other: synsets that a kind of link leads to, or comes from."""
        a, b = ("synset2id", "synset1id") if reverse else ("synset1id", "synset2id")
        kinds = self.linktypes.where(F.col("link") == link)
        rows = self.semlinks.join(kinds, "linkid", "left_semi").select(F.col(a).alias("synsetid"), F.col(b).alias("other"))
        return rows.join(synsetids, "synsetid", "left_semi")


def from_parts(part: DataFrame) -> LexicalDatabase:
    """A lexical database over a parts table: a part is a synset (its brand's part of speech, its
    type the definition, its name the sample) of the words of its name, and links to
    the part of the next key."""
    pos = F.element_at(F.array(*map(F.lit, "nvar")), (F.col("p_size") % 4 + 1).cast("int"))
    synsets = part.select(F.col("p_partkey").alias("synsetid"), pos.alias("pos"), F.col("p_type").alias("definition"))
    named = part.select(F.col("p_partkey").alias("synsetid"), F.explode(F.array_distinct(F.split(F.lower("p_name"), r"\s+"))).alias("lemma"))
    lemmas = named.select("lemma").distinct()
    words = lemmas.select(F.xxhash64("lemma").alias("wordid"), "lemma")
    senses = named.join(words, "lemma").join(synsets.select("synsetid", "pos"), "synsetid")
    # A word's senses are numbered by the synsets' order within their part of speech.
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("wordid", "pos").orderBy("synsetid"))
    senses = senses.withColumn("sensenum", number).select("wordid", "synsetid", "sensenum")
    samples = part.select(F.col("p_partkey").alias("synsetid"), F.col("p_name").alias("sample"))
    spark = part.sparkSession
    linktypes = spark.createDataFrame([(1, "hypernym", True), (2, "also", False)], "linkid int, link string, recurses boolean")
    keys = part.select("p_partkey")
    semlinks = keys.select(F.col("p_partkey").alias("synset1id"), (F.col("p_partkey") + 1).alias("synset2id")).join(keys.select(F.col("p_partkey").alias("synset2id")), "synset2id")
    return LexicalDatabase(words, senses, synsets, samples, linktypes, semlinks.select("synset1id", "synset2id", F.when(F.col("synset1id") % 3 == 0, 2).otherwise(1).alias("linkid")))
