"""MinHash near-duplicate classes by an LSH forest.

A document is the set of its distinct word shingles; documents of one set are one node. A node's signature is
TREES x DEPTH least hashes; a tree sorts the nodes by their DEPTH least hashes in it, so nodes with a long common
prefix stand together. All nodes that share a prefix of LEAST hashes in a tree are a region.

1. In each region, nodes are compared by whole signatures: first neighbours in the tree's order, which have the
   longest common prefixes, then what is still apart, down to the least prefix. Edges span what comes near the
   threshold; what they connect is a group. A region may be of any size: see `_tiled`.
2. In each group, full sets are compared, and links span the classes. Each set is shuffled once for each tile of its
   group, as many as the group needs, and nodes that are linked already aren't compared again.

Where a region or a group needs several tiles, neighbours in the trees' orders are linked first, so that one class
holds most of it and needn't be compared with itself; the rest is compared with that class and with each other.
Nothing is capped, so only a pair without a common region in any tree is missed: one in four million at the threshold
itself, fewer above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower, byte_view, chunks, connected_components, cut, is_space, mixed, short_batches, span_hashes, spans
from gleaner.llm.mixing import row_key

WORDS, PERCENT = 5, 85
TREES, DEPTH, LEAST = 16, 8, 3
#: Share of equal hashes from which on sets are compared: six deviations under the threshold.
NEAR = 0.66
#: Nodes, and shingles, that are compared with each other in one tile.
TILE, TILE_SHINGLES = 4096, 1 << 19

_K = TREES * DEPTH
_RNG = np.random.default_rng(20240713)
_MASKS, _FACTORS = _RNG.integers(0, 2**63, _K, dtype=np.uint64), _RNG.integers(0, 2**63, _K, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _shingles(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each row's text, repeats included, and the offsets of the rows in them."""
    starts, ends = spans(~is_space(data), offs)
    w = span_hashes(ascii_lower(data), starts, ends)
    row = np.searchsorted(offs, starts, "right") - 1
    count = np.bincount(row, minlength=len(offs) - 1)
    at = np.r_[0, np.cumsum(count)]
    n = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    upto = np.r_[0, np.cumsum(n)]
    owner = np.repeat(np.arange(len(n)), n)
    first = at[owner] + np.arange(upto[-1]) - upto[owner]
    h = np.zeros(upto[-1], np.uint64)
    for j in range(words):
        here = j < count[owner]  # a text of fewer words is one sequence of all of them
        part = np.zeros(len(h), np.uint64)
        part[here] = w[first[here] + j] + np.uint64(j + 1)
        h = h * _STEP + part
    return mixed(h), upto


def _sketch(h: np.ndarray, upto: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The least hashes of the rows `full`, which have shingles: _K for each."""
    out = np.empty((len(full), _K), np.uint64)
    for k in range(_K):
        out[:, k] = np.minimum.reduceat((h ^ _MASKS[k]) * _FACTORS[k], upto[full])
    return out


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set of hashes."""
    return int(mixed(s).sum(dtype=np.uint64).view(np.int64)), int(mixed(s ^ _STEP).sum(dtype=np.uint64).view(np.int64))


_SKETCH = "doc_id bigint, row bigint, k1 bigint, k2 bigint, n_shingles bigint, sig binary, regions array<bigint>"


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, row, k1, k2, n_shingles, sig, regions) of every row; null and wordless texts have no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                data, offs = byte_view(b.column(2))
                keys, sizes, sigs, regions = [], [], [], []
                for lo, hi in chunks(offs):
                    h, upto = _shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], words)
                    full = np.flatnonzero(np.diff(upto) > 0)
                    least = _sketch(h, upto, full)
                    prefix = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(full), 1))
                    for d in range(LEAST):
                        prefix = mixed(prefix * _STEP + least[:, d::DEPTH])
                    short = (mixed(least) >> np.uint64(48)).astype(">u2")
                    place = dict(zip(full.tolist(), range(len(full)), strict=True))
                    for i in range(hi - lo):
                        s, at = np.unique(h[upto[i] : upto[i + 1]]), place.get(i)
                        keys.append(_set_key(s))
                        sizes.append(len(s))
                        sigs.append(None if at is None else short[at].tobytes())
                        regions.append([] if at is None else prefix[at].view(np.int64))
                k1, k2 = zip(*keys, strict=True) if keys else ((), ())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(regions, pa.list_(pa.int64()))],
                                                 ["doc_id", "row", "k1", "k2", "n_shingles", "sig", "regions"])

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SKETCH)


def _sets(docs: DataFrame, active: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the full set of each node of active(node, row, k1, k2), from a row of docs that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                data, offs = byte_view(b.column(3))
                nodes, sets = [], []
                wanted = list(zip(*(b.column(c).to_pylist() for c in (0, 1, 2)), strict=True))
                for lo, hi in chunks(offs):
                    h, upto = _shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], words)
                    for i in range(lo, hi):
                        s = np.unique(h[upto[i - lo] : upto[i - lo + 1]])
                        if _set_key(s) == wanted[i][1:]:  # else another row with the same row key
                            nodes.append(wanted[i][0])
                            sets.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    texts = docs.select(row_key().alias("row"), F.col("text").cast("string").alias("text")).join(active, "row")
    found = texts.select("node", "k1", "k2", "text").mapInArrow(run, "node bigint, hashes array<bigint>")
    return found.groupBy("node").agg(F.first("hashes").alias("hashes"))  # repeated rows have one set


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, tail, node, class) in order, as pairs of neighbours of one region and two classes, with their common prefix."""
    last = None
    for b in batches:
        u, v, cu, cv, common = [], [], [], [], []
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if last is not None and last[0] == row[0] and last[3] != row[3]:
                low, high = sorted((last, row), key=lambda x: x[3])
                u.append(low[2])
                v.append(high[2])
                cu.append(low[3])
                cv.append(high[3])
                common.append(next((i for i in range(0, len(row[1]), 2) if row[1][i : i + 2] != last[1][i : i + 2]), len(row[1])) // 2)
            last = row
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, cu, cv, common)], ["u", "v", "cu", "cv", "common"])


_PAIRS = "u bigint, v bigint, cu bigint, cv bigint, common bigint"


def _adjacent(places: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v, cu, cv): of each two classes that are neighbours in a tree's order, the nodes with the longest common prefix."""
    order = ["region", "tail", "node"]
    rows = cut(places.select(*order).join(classes, "node").select(*order, "class"))
    pairs = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, _PAIRS)
    return pairs.groupBy("cu", "cv").agg(F.max_by(F.struct("u", "v"), F.struct("common", "u", "v")).alias("x")).select("x.u", "x.v", "cu", "cv")


def _near(pairs: DataFrame, nodes: DataFrame, near: float) -> DataFrame:
    """Edges (u, v) between the classes of those pairs whose signatures come near."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in ("u", "v"))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(_K - 1)), lambda i: F.substring("su", 2 * i + 1, F.lit(2)) == F.substring("sv", 2 * i + 1, F.lit(2))))
    return pairs.join(a, "u").join(b, "v").where(same >= near * _K).select(F.col("cu").alias("u"), F.col("cv").alias("v"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between the classes of those pairs whose full sets are alike."""
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in ("u", "v"))
    both = pairs.join(a, "u").join(b, "v").select("cu", "cv", (F.size("hu") + F.size("hv")).alias("sizes"), F.size(F.array_intersect("hu", "hv")).alias("inter"))
    return both.where(F.lit(100) * F.col("inter") >= F.lit(percent) * (F.col("sizes") - F.col("inter"))).select(F.col("cu").alias("u"), F.col("cv").alias("v"))


def _merged(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes(node, class) after edges(u, v) between classes."""
    found = connected_components(edges)
    joined = classes.join(found.select(F.col("node").alias("class"), "component"), "class", "left")
    return cut(joined.select("node", F.coalesce("component", "class").alias("class")))


def _tiled(rows: DataFrame, tile: int) -> DataFrame:
    """(bucket, node, class): rows(key, node, class, weight) dealt out so that every two of a key and of different classes share a bucket.

    The heaviest class of a key needn't be compared with itself: its nodes are cut into tiles of `tile` weight, and
    the others, cut into tiles too, meet each of these and each other. Keys of one class are done.
    """
    sizes = rows.groupBy("key", "class").agg(F.sum("weight").alias("w"))
    told = sizes.groupBy("key").agg(F.max(F.struct("w", "class")).alias("most"), F.sum("w").alias("all")).where("all > most.w").select(
        "key", F.col("most.class").alias("main"), F.ceil(F.col("most.w") / tile).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most.w")) / tile).cast("int").alias("others"))
    dealt = rows.join(told, "key")
    own = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    is_main = F.col("class") == F.col("main")
    upto = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    # (kind 0, main tile, other tile); of keys with several other tiles also (kind 1, lesser other tile, greater other tile)
    across = F.when(is_main, F.transform(upto("others"), lambda j: F.struct(F.lit(0).alias("k"), own("mains").alias("i"), j.alias("j")))).otherwise(
        F.transform(upto("mains"), lambda i: F.struct(F.lit(0).alias("k"), i.alias("i"), own("others").alias("j"))))
    among = F.when(is_main | (F.col("others") <= 1), F.array().cast("array<struct<k:int,i:int,j:int>>")).otherwise(
        F.transform(upto("others"), lambda j: F.struct(F.lit(1).alias("k"), F.least(j, own("others")).alias("i"), F.greatest(j, own("others")).alias("j"))))
    return dealt.select("key", "node", "class", F.explode(F.concat(across, among)).alias("x")).select(F.xxhash64("key", "x.k", "x.i", "x.j").alias("bucket"), "node", "class")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket at a time, of rows that stand sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        if held and held[0].column(0)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(b.slice(lo, hi - lo))
            if hi < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class _Labels:
    """Classes of a bucket's nodes as they grow together, and the edges that have joined them."""

    def __init__(self, kinds: np.ndarray):
        self.names, self.of = np.unique(kinds, return_inverse=True)
        self.edges: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        for k in np.unique(self.of[others]):
            if k != self.of[i]:
                self.edges.append((int(self.names[self.of[i]]), int(self.names[k])))
                self.of[self.of == k] = self.of[i]

    def batch(self) -> pa.RecordBatch:
        u, v = zip(*self.edges, strict=True) if self.edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _near_edges(near: float):
    """Over rows (bucket, tail, class, sig) in order: edges (u, v) between classes that span what is near in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_bucket(batches):
            labels = _Labels(t.column(2).to_numpy())
            sigs = np.frombuffer(b"".join(t.column(3).to_pylist()), ">u2").reshape(t.num_rows, -1).astype(np.uint16)
            enough = near * sigs.shape[1]
            for i in np.flatnonzero((sigs[1:] == sigs[:-1]).sum(1) >= enough):  # longest common prefixes first
                labels.join(i, np.array([i + 1]))
            most = np.bincount(labels.of).argmax()
            for i in np.flatnonzero(labels.of != most):
                apart = np.flatnonzero(labels.of != labels.of[i])
                labels.join(i, apart[(sigs[apart] == sigs[i]).sum(1) >= enough])
            yield labels.batch()

    return run


def _links_of_tiles(percent: int):
    """Over rows (bucket, class, hashes): edges (u, v) between classes that span all links of a bucket's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_bucket(batches):
            labels = _Labels(t.column(1).to_numpy())
            sets = t.column(2).combine_chunks()
            at = sets.offsets.to_numpy().astype(np.int64)
            _, place, count = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
            at, sizes = at - at[0], np.diff(at)
            # shingles that one set alone has are in no intersection
            held = count[place] > 1
            place, starts = place[held], np.r_[0, np.cumsum(held)][at]
            most = np.bincount(labels.of).argmax()
            mark = np.zeros(len(count), bool)
            for i in np.flatnonzero(labels.of != most):
                own = place[starts[i] : starts[i + 1]]
                apart = np.flatnonzero(labels.of != labels.of[i])
                apart = apart[(100 * np.minimum(sizes[apart], sizes[i]) >= percent * np.maximum(sizes[apart], sizes[i])) & (starts[apart + 1] > starts[apart])]
                if not len(own) or not len(apart):
                    continue
                mark[own] = True
                upto = np.r_[0, np.cumsum(mark[place])]
                inter = upto[starts[apart + 1]] - upto[starts[apart]]
                mark[own] = False
                labels.join(i, apart[100 * inter >= percent * (sizes[apart] + sizes[i] - inter)])
            yield labels.batch()

    return run


_EDGES = "u bigint, v bigint"


def _groups(places: DataFrame, nodes: DataFrame, near: float, tile: int) -> DataFrame:
    """(node, class): what the signatures that come near in a region connect."""
    classes = nodes.select("node", F.col("node").alias("class"))
    large = places.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("region")
    large = cut(large)
    if not large.isEmpty():
        classes = _merged(classes, _near(_adjacent(places.join(large, "region", "left_semi"), classes), nodes, near))
    told = places.join(classes, "node").select(F.col("region").alias("key"), "node", "class", F.lit(1).alias("weight"))
    tails = nodes.select("node", "sig")
    rows = _tiled(told, tile).join(tails, "node").select("bucket", F.col("sig").alias("tail"), "class", "sig")
    edges = rows.repartition("bucket").sortWithinPartitions("bucket", "tail").mapInArrow(_near_edges(near), _EDGES)
    return _merged(classes, edges)


def _classes(places: DataFrame, groups: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """(node, class): what links of full sets connect within the groups."""
    sizes = nodes.select("node", "n_shingles")
    told = groups.withColumnRenamed("class", "key").join(sizes, "node")
    many = told.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).where("n > 1")
    told = cut(told.join(many, "key"))
    classes = told.select("node", F.col("node").alias("class"))
    large = told.where(F.col("size") > tile)
    if not large.isEmpty():
        near = places.join(large.select("node"), "node", "left_semi")
        for some in (near.where("tree = 0"), near):
            classes = _merged(classes, _linked(_adjacent(some, classes), sets, percent))
    rows = told.join(classes, "node").select("key", "node", "class", F.col("n_shingles").alias("weight"))
    whole = _tiled(rows, tile).join(sets, "node").select("bucket", "class", "hashes")
    return _merged(classes, whole.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links_of_tiles(percent), _EDGES))


def near_duplicate_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, near: float = NEAR, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text).

    A-Z are lower-cased, words are split at bytes 0x20 and 0x09 to 0x0D; a text of fewer words than a shingle is one
    shingle of all of them, and one without words, or a null, has none and is linked with nothing: its component is its own
    doc_id. component_id is the least doc_id of a class, null where none of its rows has an id; kept tells the rows of
    that id. Classes are of texts, not ids: different texts of one id are linked only if they are alike. Repeated rows
    stay repeated; an empty table gives no rows; other columns aren't read.
    """
    rows = cut(sketches(docs, words))
    full = rows.where("n_shingles > 0")
    grouped = full.groupBy("k1", "k2").agg(F.min("row").alias("row"), F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("regions").alias("regions"))
    nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    every = nodes.select("node", "sig", F.posexplode("regions").alias("tree", "region"))
    width = 2 * DEPTH
    every = every.select("region", "tree", "node", F.substring("sig", F.col("tree") * width + 2 * LEAST + 1, F.lit(width - 2 * LEAST)).alias("tail"))
    shared = every.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    places = cut(every.join(shared, "region"))
    groups = _groups(places, nodes, near, tile)
    of_many = groups.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    groups = cut(groups.join(of_many, "class"))
    sets = cut(_sets(docs, groups.select("node").join(nodes.select("node", "row", "k1", "k2"), "node"), words))
    found = _classes(places, groups, nodes, sets, percent, tile_shingles)
    classes = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("class", "node").alias("class"))

    named = nodes.select("node", "k1", "k2", "first").join(classes, "node")
    names = named.groupBy("class").agg(F.min("first").alias("component_id"))
    of = named.join(names, "class").select("k1", "k2", "component_id")
    linked = full.select("doc_id", "n_shingles", "k1", "k2").join(of, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
