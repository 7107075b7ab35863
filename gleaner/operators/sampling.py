"""Numbering and systematic samples of rows in the order of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.lineage import cut

RANGE = 1 << 16


def numbered(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """Adds gapless numbers from 0 in the order of an integer key.

    Rows are numbered within ranges of the key; only the ranges' counts are summed up in one task.
    """
    rows = rows.withColumn("__range", F.floor(F.col(key) / RANGE))
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))
    at = F.row_number().over(W.partitionBy("__range").orderBy(key)) - 1
    return rows.withColumn("__at", at).join(before, "__range").withColumn(name, (F.col("__before") + F.col("__at")).cast("bigint")).drop("__range", "__before", "__at")


def stride_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """`limit` rows at even distances in the order of key; all rows if there are no more. The input is worked out once."""
    rows = cut(rows)
    n = rows.count()
    step = max(n // limit, 1)
    if n <= limit:
        return rows
    return numbered(rows, key, "__number").where((F.col("__number") % step == 0) & (F.col("__number") < limit * step)).drop("__number")
