"""Values that are worked out once although several expressions use them.

The optimizer puts a column's expression in place of its name wherever a filter is moved below a projection,
so a chain of regular expressions that feeds several others would be run again for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_known: dict = {}


def once(name: str, make: Callable[[], object]) -> object:
    """What make() gives, made once for a JVM: large expressions on columns of fixed names take thousands of calls to build."""
    key = (id(SparkContext._gateway), name)
    if key not in _known:
        _known[key] = make()
    return _known[key]


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once: for use within expressions on array elements."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def held(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds (or replaces) columns that filters and projections above don't work out again."""
    one = F.struct(*[c.alias(name) for name, c in columns.items()])
    with_it = rows.withColumn("__held", F.explode(F.array(one)))
    return with_it.select(*[F.col(f"`{c}`") for c in rows.columns if c not in columns], *[F.col(f"__held.`{c}`").alias(c) for c in columns])
