"""One row that makes up most of a table, and columns that have no hash of their own."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gleaner.llm import sharding, simhash
from tests.llm.cases import documents, sentence

COPIES = 100_000


def _hot(spark):
    hot = spark.range(COPIES).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("one text that stands everywhere").alias("text"))
    return hot.union(documents(spark, [(i, sentence(random.Random(i), 50)) for i in range(20, 40)]).select("doc_id", "text"))


def test_slots_of_one_row_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPREAD", 1000)
    got = sharding.shard_documents(_hot(spark)).toPandas()
    assert len(got) == COPIES + 20 and got[got.doc_id == 7].shard.nunique() == 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))


def test_one_of_all_copies_stays(spark):
    kept = simhash.one_of_each_class(_hot(spark), unnamed=True).collect()
    assert Counter(r.doc_id for r in kept) == Counter([7, *range(20, 40)])


def test_maps_and_names_with_backticks(spark):
    rows = [(1, "the very same text", {"a": 1}), (1, "the very same text", {"a": 2}), (1, "the very same text", {"a": 2})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, m map<string, int>").withColumnRenamed("m", "o`d")
    kept = simhash.one_of_each_class(docs, unnamed=True)
    assert kept.columns == docs.columns and kept.count() == 1
