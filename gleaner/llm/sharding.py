"""Sharding by a hierarchical weighted hash tree, in DataFrame operations only.

Shards are the leaves of a tree of regions and racks. From the root a row goes down by weighted draws: at
each node, the child with the least -ln(u) / weight, u a hash of the row's id and the child's name. A
child's draw doesn't depend on its siblings, so a change of weights moves rows only into the subtrees that
gained or out of those that lost. Shard s is number s % RACK of a rack, racks fill regions in order; weights
are the numbers of shards below. A shard that opens a new region takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import cut

#: Shards in a rack and racks in a region.
RACK, REGION = 4, 2
#: Hash groups of a shard in which slots are counted, and copies of a row that one task lays out.
GROUPS, SPREAD = 1024, 1 << 16
_SPAN = float(1 << 52)


def tree(shards: int) -> dict[int, dict[int, list[int]]]:
    """region -> rack -> shards"""
    out: dict[int, dict[int, list[int]]] = {}
    for s in range(shards):
        rack = s // RACK
        out.setdefault(rack // REGION, {}).setdefault(rack, []).append(s)
    return out


def _pick(key: Column, level: str, children: Column) -> Column:
    """The id of the child with the least draw, -ln(u) / weight with u in (0, 1) from 52 bits of an MD5."""

    def draw(child: Column) -> Column:
        name = F.concat(key, F.lit(f"/{level}"), child["id"].cast("string"))
        bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / _SPAN) / child["weight"]).alias("draw"), child["id"].alias("id"))

    return F.array_min(F.transform(children, draw))["id"]


def _children(found: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in found.items()])


def place(rows: DataFrame, shards: int, name: str, key: str = "doc_id") -> DataFrame:
    """Adds column `name`: the shard of each row by its key alone (null counts as the empty string)."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    top = tree(shards)
    regions = _children({r: sum(map(len, racks.values())) for r, racks in top.items()})
    racks = F.array(*[_children({x: len(s) for x, s in racks.items()}) for racks in top.values()])
    leaves = F.array(*[_children(dict.fromkeys(s, 1)) for racks in top.values() for s in racks.values()])
    rack = _pick(k, "rack", F.get(racks, _pick(k, "region", regions)))
    return rows.withColumn(name, _pick(k, "shard", F.get(leaves, rack)))


def slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds `slot`: gapless numbers from 0 within each shard.

    rows are distinct and have a count `n`; each gives n rows. A shard is cut into GROUPS by a hash of the order
    columns, which tell rows apart: a group is numbered by itself, by running sums of the counts, and groups begin
    after those before them, by running sums over at most shards x GROUPS counts. So no shard is sorted in one task,
    and a row that is repeated very often is one row until it is laid out: beyond SPREAD, in parts dealt over all tasks.
    """
    rows = rows.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(GROUPS)).cast("int"))
    sizes = rows.groupBy(shard, "__group").agg(F.sum("n").alias("__n"))
    before = sizes.select(shard, "__group", (F.sum("__n").over(W.partitionBy(shard).orderBy("__group")) - F.col("__n")).alias("__before"))
    at = F.sum("n").over(W.partitionBy(shard, "__group").orderBy(*order)) - F.col("n")
    # shards x GROUPS rows of 16 bytes
    begun = cut(rows.withColumn("__at", at).join(F.broadcast(before), [shard, "__group"]).withColumn("__from", F.col("__before") + F.col("__at")).drop("__group", "__at", "__before"))
    laid = lambda of, n: of.withColumn("slot", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("slot", (F.col("__from") + F.col("slot")).cast("bigint"))
    few = laid(begun.where(F.col("n") <= SPREAD), F.col("n"))
    parts = begun.where(F.col("n") > SPREAD).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SPREAD)))).repartition("__from", "part")
    many = laid(parts.withColumn("__from", F.col("__from") + F.col("part") * SPREAD), F.least(F.lit(SPREAD), F.col("n") - F.col("part") * SPREAD)).drop("part")
    return few.unionByName(many).drop("n", "__from")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs(doc_id, text).

    size is the text's UTF-8 bytes (null: none) plus 8. A null text has the checksum of the empty one, a null
    doc_id the key of an empty string. Repeated rows share a shard and take slots of their own; an empty
    table gives no rows; other columns aren't read. grown_shard is the place with one more shard.

    shards has to fill its regions: only then does one more shard open a region of its own and take rows only
    into itself, as the law says. Other numbers are refused.
    """
    if shards < 1 or shards % (RACK * REGION):
        raise ValueError(f"the number of shards must be a positive multiple of {RACK * REGION}")
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(raw) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(raw, "UTF-8")).cast("bigint").alias("text_crc32"), F.lit("key").alias("law"))
    one = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    placed = place(place(cut(one), shards, "shard"), shards + 1, "grown_shard")
    return slots(placed, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
