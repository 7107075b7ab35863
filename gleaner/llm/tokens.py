"""Token counts that follow edits: a tree of pre-token counts for each text, re-encoded only where it changed.

A text is cut into pre-tokens by the tokenizer's pattern; its token count is the sum over them. The counts
stand in a segment tree: leaves are runs of pre-tokens, inner nodes hold the characters and tokens below. An
edit finds its leaves by the characters' sums, cuts the changed region anew with some context before it,
until the new cuts meet the old ones again, and renews the sums on the way up. Leaves take up to twice LEAF
pre-tokens before their number changes, so that seldom happens, and only then are all inner sums made again.

Trees are columns beside their texts (`planted`), to be written as a table: each batch of edits takes the trees
that the one before left (`regrown`), so no later batch parses a whole text.

A pre-token depends only on the text from its start, and on few characters past its end, except in runs of
blanks. So the region begins at a cut that lies at least CONTEXT characters, and no blank, before the edit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.lineage import shared_path
from gleaner.llm.common import short_batches

#: How the byte-level vocabulary's tokenizer parts text (a fixed value of that vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf, leaves or nodes in a node, and characters of context before an edit.
LEAF, FANOUT, CONTEXT = 64, 16, 4
#: Pre-tokens whose counts a task remembers, and characters of one at most.
REMEMBERED, SHORT = 1 << 17, 64


class Counter:
    """Token counts of pre-tokens, remembered for the most recent."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.parts = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for p in parts:
            n = known.get(p)
            if n is None:
                n = len(self.encoding.encode_ordinary(p))
                if len(p) <= SHORT:
                    known[p] = n
            out.append(n)
        return out

    def whole(self, text: str) -> int:
        return sum(self.counts(self.parts.findall(text)))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in the fewest bytes each that hold all, after a byte that says how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if not len(numbers) or numbers.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + numbers.astype(f"<u{np.dtype(kind).itemsize}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Tree:
    """Pre-tokens of a text with their sums by region."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        parts = counter.parts.findall(text)
        sizes, counts = [len(p) for p in parts], counter.counts(parts)
        self.leaves = self._leaves(sizes, counts, -(-len(sizes) // LEAF))
        self._sum_up([(sum(s), sum(n)) for s, n in self.leaves])

    @classmethod
    def stored(cls, text: str, sizes: bytes, counts: bytes, widths: bytes, counter: Counter) -> Tree:
        """The tree that `columns` gave, without a look at the text; leaves are read where an edit comes to them."""
        tree = cls.__new__(cls)
        tree.text, tree.counter, tree.encoded = text, counter, 0
        size, count, ends = _unpacked(sizes), _unpacked(counts), np.cumsum(_unpacked(widths))
        tree.leaves = list(zip(np.split(size, ends[:-1]), np.split(count, ends[:-1]), strict=True))
        below = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]).tolist() for x in (size, count)]
        tree._sum_up(list(zip(*below, strict=True)))
        return tree

    def columns(self) -> tuple[bytes, bytes, bytes]:
        """(lengths and token counts of the pre-tokens, pre-tokens of each leaf), packed."""
        sizes, counts = (np.concatenate([np.asarray(x[i], np.int64) for x in self.leaves]) for i in range(2))
        return _packed(sizes), _packed(counts), _packed(np.array([len(s) for s, _ in self.leaves], np.int64))

    @staticmethod
    def _leaves(sizes: list[int], counts: list[int], n: int) -> list[tuple[list[int], list[int]]]:
        """n leaves, or one, of the lengths and the token counts of pre-tokens, as even as can be."""
        n = max(n, 1)
        cuts = [len(sizes) * i // n for i in range(n + 1)]
        return [(sizes[i:j], counts[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def _leaf(self, i: int) -> tuple[list[int], list[int]]:
        sizes, counts = self.leaves[i]
        return (sizes, counts) if isinstance(sizes, list) else (sizes.tolist(), counts.tolist())

    def _sum_up(self, base: list[tuple[int, int]]) -> None:
        self.levels = [base]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([self._sum(below, i) for i in range(-(-len(below) // FANOUT))])

    @staticmethod
    def _sum(below: list[tuple[int, int]], i: int) -> tuple[int, int]:
        """Sums of the i-th node above `below`."""
        x = below[i * FANOUT : (i + 1) * FANOUT]
        return sum(c for c, _ in x), sum(t for _, t in x)

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf that holds character `at`, or the last; its first character), down from the root by sums."""
        node, start = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= FANOUT
            last = min(node + FANOUT, len(level)) - 1
            while node < last and start + level[node][0] <= at:
                start += level[node][0]
                node += 1
        return node, start

    def edit(self, at: int, removed: int, added: str) -> None:
        """Replaces `removed` characters from `at` by `added`; places beyond the text count as its end."""
        n = len(self.text)
        at = min(max(at, 0), n)
        end = min(at + max(removed, 0), n)
        if at == end and not added:
            return
        old, shift = self.text, len(added) - (end - at)
        self.text = old[:at] + added + old[end:]
        # first cut that no edit can move
        safe = at - CONTEXT
        while safe > 0 and old[safe - 1].isspace():
            safe -= 1
        first, begin = self.find(max(safe, 0))
        cut, k = begin, 0
        sizes = self._leaf(first)[0]
        while k < len(sizes) and cut + sizes[k] <= safe:
            cut += sizes[k]
            k += 1
        while k and old[cut - 1].isspace():
            k -= 1
            cut -= sizes[k]
        if not k:
            cut = begin
            while cut and old[cut - 1].isspace():  # a run of blanks before the leaf: take the leaf before too
                first -= 1
                cut -= self.levels[0][first][0]
        # old cuts after the edit, leaf by leaf, at their new places
        last, pos = self.find(end)
        parts, at_new, old_cuts, resumed = [], cut, set(), False
        loaded, reach = last, pos
        while True:
            if at_new >= at + len(added):
                while loaded < len(self.leaves) and reach + shift <= at_new:
                    x = reach
                    for s in self._leaf(loaded)[0]:
                        x += s
                        old_cuts.add(x + shift)
                    reach = x
                    loaded += 1
                if at_new in old_cuts and at_new > at + len(added):
                    resumed = True
                    break
            m = self.counter.parts.match(self.text, at_new)
            if not m or not m.group():
                break
            parts.append(m.group())
            at_new = m.end()
        sizes, counts = [len(p) for p in parts], self.counter.counts(parts)
        self.encoded += len(parts)
        tail_leaf = len(self.leaves)
        if resumed:
            tail_leaf, x = self.find(at_new - shift)
            old_sizes, old_counts = self._leaf(tail_leaf)
            k_tail = 0
            while x < at_new - shift:
                x += old_sizes[k_tail]
                k_tail += 1
            sizes += old_sizes[k_tail:]
            counts += old_counts[k_tail:]
            tail_leaf += 1
        if k:
            begun = self._leaf(first)
            sizes, counts = begun[0][:k] + sizes, begun[1][:k] + counts
        n, whole = tail_leaf - first, first == 0 and tail_leaf == len(self.leaves)
        if not n * LEAF // 4 <= len(sizes) <= n * LEAF * 2:
            n = -(-len(sizes) // LEAF)
        self.leaves[first:tail_leaf] = self._leaves(sizes, counts, n) if sizes or whole else []
        self._renew(first, tail_leaf)

    def _renew(self, first: int, tail_leaf: int) -> None:
        """Sums on the way up from the changed leaves; all inner ones where the number of leaves changed."""
        base = self.levels[0]
        more = len(self.leaves) - len(base)
        base[first:tail_leaf] = [(sum(s), sum(n)) for s, n in self.leaves[first : tail_leaf + more]]
        if more:
            self._sum_up(base)
            return
        lo, hi = first, tail_leaf
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            lo, hi = lo // FANOUT, -(-hi // FANOUT)
            above[lo:hi] = [self._sum(below, i) for i in range(lo, hi)]


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file (a base64 token and its rank on each line) by the driver; a vocabulary is of fixed size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def planted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, sizes, counts, widths, n_tokens): every row of docs(doc_id, text) with the tree of its text.

    A null text is empty; rows without a doc_id and repeated rows have trees like others; other columns aren't
    read; an empty table gives no rows. The tree takes some two bytes a pre-token, and little once compressed.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(read_ranks(spark, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(held.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            trees = (Tree(t, counter) for t in texts)  # one at a time
            rows = [(*t.columns(), t.tokens) for t in trees]
            yield _batch(b.column(0), texts, rows, _PLANTED)

    short_batches(spark)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _types(_PLANTED))


def stored(trees: DataFrame) -> DataFrame:
    """Trees written in the shared folder, and read from there."""
    path = shared_path(trees.sparkSession, "trees")
    trees.write.option("compression", "zstd").parquet(path)
    return trees.sparkSession.read.schema(trees.schema).parquet(path)


def regrown(rows: DataFrame, vocabulary: str = VOCABULARY, trees: bool = True) -> DataFrame:
    """Trees of rows(doc_id, text, sizes, counts, widths, edits array of (at, removed, added)) after their edits.

    Gives the new text and tree (unless `trees` is false) with n_tokens, n_tokens_after, n_pretokens_encoded and n_edits.
    Edits hold in the order of the array, each on the text that the one before left; null means none.
    No text is parsed but near its edits.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(read_ranks(spark, vocabulary))
    names = _REGROWN if trees else [c for c in _REGROWN if c.startswith(("doc_id", "n_"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(held.value)
        for b in batches:
            texts, out = [], []
            for text, sizes, counts, widths, edits in zip(*(b.column(c).to_pylist() for c in range(1, 6)), strict=True):
                tree = Tree.stored(text, sizes, counts, widths, counter)
                before = tree.tokens
                for e in edits or []:
                    tree.edit(e["at"], e["removed"], e["added"])
                figures = (before, tree.tokens, tree.encoded, len(edits or []))
                texts.append(tree.text)
                out.append((*tree.columns(), *figures) if trees else figures)
            yield _batch(b.column(0), texts if trees else None, out, names)

    short_batches(spark)
    return rows.select("doc_id", "text", "sizes", "counts", "widths", "edits").mapInArrow(run, _types(names))


_PLANTED = ["doc_id", "text", "sizes", "counts", "widths", "n_tokens"]
_REGROWN = [*_PLANTED, "n_tokens_after", "n_pretokens_encoded", "n_edits"]
_KINDS = {"doc_id": "bigint", "text": "string", "sizes": "binary", "counts": "binary", "widths": "binary"}


def _types(names: list[str]) -> str:
    return ", ".join(f"{c} {_KINDS.get(c, 'bigint')}" for c in names)


def _batch(ids: pa.Array, texts: list[str] | None, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    rest = [c for c in names if c not in ("doc_id", "text")]
    kinds = [pa.binary() if _KINDS.get(c) == "binary" else pa.int64() for c in rest]
    columns = list(zip(*rows, strict=True)) or [()] * len(rest)
    own = [] if texts is None else [pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays([ids, *own, *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names)


def with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows with column `edits`: those of edits(doc_id, seq, at, removed, added) for their doc_id, in the order of seq, ties by the rest.

    Null places and lengths are 0, a null addition is empty; rows without a doc_id have no edits.
    """
    one = F.struct(F.col("seq").cast("bigint").alias("seq"), F.coalesce(F.col("at").cast("bigint"), F.lit(0)).alias("at"), F.coalesce(F.col("removed").cast("bigint"), F.lit(0)).alias("removed"), F.coalesce("added", F.lit("")).alias("added"))
    listed = edits.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.sort_array(F.collect_list(one)).alias("edits"))
    return rows.join(listed, "doc_id", "left")


def edited_counts(docs: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_pretokens_encoded, n_edits) of every row of docs(doc_id, text).

    edits(doc_id, seq, at, removed, added): in the order of seq (ties by the other columns), each on the text
    that the one before left; a row's edits hold for every row of its doc_id. A null text is empty; null
    places and lengths are 0, a null addition is empty; places beyond the text are its end. Rows without a
    doc_id have no edits. Other columns aren't read. An empty table gives no rows.
    """
    return regrown(with_edits(stored(planted(docs, vocabulary)), edits), vocabulary, trees=False)
