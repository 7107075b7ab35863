"""Ids that different texts share, and rows without an id."""

import random

import corpus_pipeline
from gleaner.llm import simhash
from gleaner.llm.queries import table
from tests.llm.cases import documents, sentence


def _texts(n):
    rng = random.Random(11)
    return [sentence(rng, 300) for _ in range(n)]


def kept(spark, rows, **kw):
    got = simhash.one_of_each_class(documents(spark, rows), **kw).collect()
    return sorted(((r.doc_id, r.text) for r in got), key=str)


def test_unlike_texts_of_one_id_both_stay(spark):
    a, b, c = _texts(3)
    assert kept(spark, [(5, a), (5, b), (6, a), (6, c)]) == sorted([(5, a), (5, b), (6, c)], key=str)


def test_a_copy_of_one_text_of_an_id_goes_without_the_other(spark):
    a, b, _ = _texts(3)
    rows = [(3, b), (5, a), (5, b), (5, a)]
    assert kept(spark, rows) == sorted([(3, b), (5, a)], key=str)
    found = simhash.near_duplicate_classes(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (5, 3), (5, 5), (5, 5)]


def test_rows_without_id_are_deduplicated(spark):
    a, b, c = _texts(3)
    rows = [(None, a), (4, a), (None, b), (None, b), (None, c), (None, None), (7, None)]
    got = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(4, a), (None, b), (None, c), (7, None)], key=str)


def test_leaks_without_id_go(spark):
    data = "/root/testdata/sf0.001"
    item = table(spark, data, "benchmark").where("text is not null").first().text
    clean = "Nothing of the sort stands here."
    rows = [(None, "Before it. " + item), (None, clean), (5, item), (5, clean)]
    got = corpus_pipeline.decontaminated(spark, documents(spark, rows), data)
    assert got.columns == documents(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, clean), (5, clean)], key=str)
