"""Which vendor a URL belongs to: a CASE made from the rule table, hosts of all rules before paths of any."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.functions.binding import held, once
from gleaner.functions.fixed import GENERIC, PLATFORMS, RULES, UNKNOWN


def by_path(path: Column, rules: list[tuple] = RULES) -> Column:
    """The first rule with a part that path and query contain; null if none has."""
    out = F.lit(None).cast("string")
    for name, _, parts in reversed(rules):
        if parts:
            out = F.when(reduce(or_, [path.contains(p) for p in parts]), name).otherwise(out)
    return out


def with_platform(rows: DataFrame, url: str, name: str = "platform", rules: list[tuple] = RULES) -> DataFrame:
    """Adds the platform of a raw URL column; Unknown for what isn't an http(s) URL with a host.

    Hosts are looked up by their suffixes, one map access for each of their labels, so the cost doesn't grow
    with the rules; only rows without a vendor host test the path parts.
    """
    clean = held(rows, {"__url": urls.normalised(F.col(url))})
    parts = held(clean, {"__host": urls.site_host(F.col("__url")), "__path": urls.site_path(F.col("__url"))})
    found = once("the platform of __host and __path", lambda: _found(rules)) if rules is RULES else _found(rules)
    return held(parts, {name: found}).drop("__url", "__host", "__path")


def _found(rules: list[tuple]) -> Column:
    ranks = {d: (i, n) for i, (n, hosts, _) in reversed(list(enumerate(rules))) for d in hosts}
    table = F.create_map(*[x for d, (i, n) in ranks.items() for x in (F.lit(d), F.struct(F.lit(i).alias("rank"), F.lit(n).alias("name")))])
    labels = F.split("__host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = F.filter(F.transform(suffixes, lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())
    return F.when(F.col("__host").isNull(), UNKNOWN).otherwise(F.coalesce(F.array_min(hits)["name"], by_path(F.col("__path"), rules), F.lit(GENERIC)))


def platform_table(spark: SparkSession) -> DataFrame:
    """(platform, rank, has_adapter): every platform; all vendors have one, and the generic page too."""
    rows = [(n, i + 1, True) for i, n in enumerate(PLATFORMS)] + [(GENERIC, len(PLATFORMS) + 1, True), (UNKNOWN, None, False)]
    return spark.createDataFrame(rows, "platform string, rank int, has_adapter boolean")
