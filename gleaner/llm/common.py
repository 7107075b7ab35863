"""Helpers that the corpus operators share: byte views of Arrow text columns, vectorised word hashing and
connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StructField, StructType, VariantType

from gleaner.functions.lineage import cut, use_shared_checkpoints  # noqa: F401

#: Rows in one Arrow batch; texts are long, so batches are kept short.
ARROW_ROWS = 256
#: Bytes of text that the vectorised kernels take at once (a longer text goes alone).
CHUNK_BYTES = 1 << 20


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def wide_key() -> Column:
    """128 bits that part rows: the id, if any, with the text (null: empty). Rows equal in both share them."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col("text").cast("string"), F.lit("")))))


def told(rows: DataFrame) -> list[Column]:
    """The columns of rows, of any names, in forms that can be hashed: maps and variants as JSON."""

    def unhashed(kind: DataType) -> bool:
        if isinstance(kind, StructType):
            return any(unhashed(f.dataType) for f in kind.fields)
        return unhashed(kind.elementType) if isinstance(kind, ArrayType) else isinstance(kind, (MapType, VariantType))

    named = [(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in rows.schema.fields]
    return [F.to_json(F.struct(c.alias("v"))) if unhashed(kind) else c for c, kind in named]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finishes a hash so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same for equal bytes wherever they stand."""
    up, down = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=s[1:])
    return mixed((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the rows' offsets."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut_at = np.zeros(n + 1, bool)
    cut_at[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut_at[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut_at[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges (u, v): component is the smallest node reachable.

    Large-star and small-star rounds: each hooks nodes to the smallest neighbour seen, with minima as
    aggregates, so no neighbour list is gathered; the rounds grow with the logarithm of the diameter.
    Every round is cut in the shared checkpoint folder. No edges: no rows. Loops and nulls are ignored.
    """
    now = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )  # u > v
    mark = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (new["n"], new["s"]) == mark or not new["n"]:
            break
        mark = (new["n"], new["s"])
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = cut(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def split_longs(values: list[int]) -> Column:
    """A literal array of longs of any length; the optimizer folds it into one value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def running(rows: DataFrame, order: list[Column | str], sums: list[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """rows in the order of `order` with n, the place of each from 0, and `<c>_upto`, the sum of c up to and with it.

    The rows are dealt out by ranges of their order and numbered within each range; the totals of the ranges, a row
    for each partition, give what stands before. order must tell all rows apart but equal ones; the columns of
    `sums` are longs without nulls. Also returns the totals, by name (n for the rows).
    """
    sums = sums or []
    spread = cut(rows).repartitionByRange(*order).sortWithinPartitions(*order)  # ranges are sampled, so rows are laid down first
    added = ["__part", "n", *[f"{c}_upto" for c in sums]]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, upto = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for b in batches:
            n = b.num_rows
            out = [pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))]
            at += n
            for c in sums:
                total = np.cumsum(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)) + upto[c]
                upto[c] = int(total[-1]) if n else upto[c]
                out.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *added])

    fixed = cut(spread.mapInArrow(number, StructType([*spread.schema.fields, *[StructField(c, LongType()) for c in added]])))
    parts = fixed.groupBy("__part").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).orderBy("__part").collect()
    before, totals = {}, {}
    for c in ["n", *sums]:
        ends = np.cumsum([0, *[r[c] for r in parts]]).tolist()
        at = dict(zip((r["__part"] for r in parts), ends, strict=False))
        before[c], totals[c] = [at.get(i, 0) for i in range(max(at, default=0) + 1)], ends[-1]
    start = {c: F.element_at(split_longs(before[c]), F.col("__part").cast("int") + 1) for c in before}
    moved = {"n": F.col("n") + start["n"], **{f"{c}_upto": F.col(f"{c}_upto") + start[c] for c in sums}}
    return fixed.withColumns(moved).drop("__part"), totals
