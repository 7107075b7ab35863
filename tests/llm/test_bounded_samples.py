"""A sampled id that many rows share counts once."""

from pyspark.sql import functions as F

from gleaner.llm import linear, mixing


def _docs(spark):
    rows = [(i, f"text {i}", "en") for i in range(20)] + [(3, f"other {i}", "de") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_rows_of_the_classifiers_sample(spark):
    ids = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"))
    got = linear.sample(_docs(spark), ids, 10).collect()
    assert sorted((r.doc_id, r.y) for r in got) == [(i, i % 2) for i in range(20)]
    assert {r.text for r in got} <= {r.text for r in _docs(spark).collect()}


def test_rows_of_the_mixing_sample(spark):
    ids = spark.range(20).select(F.col("id").alias("doc_id"))
    got = mixing.sample_labelled(_docs(spark), ids, "lang")
    assert got.columns == ["text", "domain"] and got.count() == 20
