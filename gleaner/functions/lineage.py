"""Cutting the lineage of tables that are used again, in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The largest measured side of a join that is broadcast; runs have some hundred joins.
MEASURED = "1m"
#: What a task after a shuffle reads: rows laid out from templates take many times as much in memory as in a shuffle.
READ = "16m"


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder to the one that spark.checkpoint.dir names.

    Where none is named, a fresh local folder serves if master and executors share this machine; on a cluster
    nothing does, since executors don't see each other's folders.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage in the shared checkpoint folder."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def join_by_measure(spark: SparkSession) -> None:
    """Sides of joins are broadcast by their measured size alone, where not asked for by hand.

    What is laid out from a few bytes of a table is estimated as these bytes, and would go to the driver whole.
    Tasks after a shuffle read at most about READ, where there are partitions enough.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", MEASURED)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", READ)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    use_shared_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
