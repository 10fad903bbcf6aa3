"""Texts are read, and taken apart, once for an index and all that is made of it."""

import os

import pytest

from textlake import queries
from textlake.plans import physical_plan

DATA = "/root/testdata/sf0.001"
ONE_PASS = ("collocations_llr", "marked_unigrams", "marked_bigrams", "prefix_transitions_2", "similar_words", "trigram_freqs", "word_contexts", "word_contexts_unordered", "word_transitions")


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ONE_PASS)
def test_texts_are_taken_apart_once(spark, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = physical_plan(queries.queries()[name](spark, DATA))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("FileScan") == 1 and plan.count("regexp_extract_all") == 1, plan
