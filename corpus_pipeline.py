"""A training corpus in five stages: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes what the one before it kept, written as Parquet and read again; all but the last return the
columns of documents, extra ones of any name among them. In every stage null texts are empty, rows without doc_id
are rows like others, very long texts are read whole, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, linear, mixing, sharding, simhash
from gleaner.llm.common import use_shared_checkpoints, wide_key
from gleaner.llm.queries import LANGUAGE_WEIGHTS, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; equal texts share a fate, repeated rows stay repeated."""
    model = linear.quality_model(docs, table(spark, sf_dir, "labels"))
    return linear.accepted(docs, model, linear.word_ngrams)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: a row of the smallest doc_id, or of no id where no row has one.

    Rows without words are one class. Different texts of one doc_id are different documents.
    """
    return simhash.one_of_each_class(docs, unnamed=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item; of rows that share a doc_id only those whose text leaks go, repeated ones all."""
    items = decontaminate.split_items(table(spark, sf_dir, "benchmark"))
    keyed = docs.select(wide_key().alias("doc_id"), "text")  # a null id never equals another
    leaks = decontaminate.contaminated(keyed, items, whole=decontaminate.WHOLE).select(F.col("doc_id").alias("leak")).distinct()
    rows = docs.select(F.struct("*").alias("row"), wide_key().alias("key"))
    return rows.join(leaks, F.col("key") == F.col("leak"), "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their rate says; the language with the most tokens for its weight has rate one, so none is lost."""
    labelled = mixing.sample_labelled(docs, table(spark, sf_dir, "labels"), "lang")
    rates, _ = mixing.mix(docs, labelled, LANGUAGE_WEIGHTS, keep_all=True)
    return mixing.realise(docs, rates)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, repeated ones in slots of their own."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("sharded", sharded),
]

#: A fitted classifier and a sketch can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; stages are written under the shared checkpoint folder."""
    use_shared_checkpoints(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
