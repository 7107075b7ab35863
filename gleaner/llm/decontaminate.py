"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of the test items.

Every passage of every document is a query. Passages are windows of words, each overlapping the next by
half, and long enough that any item stands whole in one. An item's weights are divided by the score that it
gives its own words, so one threshold serves items of any length.

A passage is left when the essential terms that it shares with each item, which make up all but SLACK of the
item's weight, can't lift any item to the threshold. For the rest cursors go through the posting lists in the
order of items: the pivot is the first item that the cursors' largest weights can lift to the threshold, blocks
of items whose maxima can't are skipped, and every item at the threshold or above is retrieved. Those count as
leaks if both the question and the answer are covered by word triples that they share with the passage. Items
that weren't divided by their makers also count if enough of the whole is covered, wherever the cut between
question and answer fell.

Frequencies, the mean length and the length of passages are those of all items, so scores don't depend on how
many indexes the items are dealt to.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from gleaner.llm.common import ascii_lower, byte_view, chunks, cut, mixed, short_batches, span_hashes, spans

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage has to reach.
THRESHOLD = 0.55
#: Share of the words of question and answer that shared word triples have to cover.
OVERLAP = 0.7
#: Share of the words of a whole undivided item that shared word triples have to cover: less than its first two thirds.
WHOLE = 0.6
#: Items in a block, bytes of item text in one broadcast index, and indexes that one pass over the documents holds.
BLOCK, INDEX_BYTES, INDEXES = 16, 8 << 20, 8
#: Share of an item's weight that its terms of least weight make up: they aren't essential.
SLACK = 0.25
#: What rounding may take from a bound.
ROUNDING = 1e-9
#: Words in a passage at least.
PASSAGE = 64
GRAM = 3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) runs of letters, digits and bytes over 127, and each row's first word."""
    s, e = spans(_LETTER[data], offs)
    return span_hashes(ascii_lower(data), s, e), np.searchsorted(s, offs)


def words_in(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]))[0] if len(data) else np.zeros(0, np.uint64)


def grams_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of word n-grams; none of fewer words."""
    if not n or len(words) < n:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        h = mixed(h * np.uint64(31) + words[i : len(words) - n + 1 + i])
    return h


def covered(part: np.ndarray, passage: dict[int, np.ndarray]) -> float:
    """Share of a part's words that n-grams of a passage cover; a part of fewer words is one n-gram of them all.

    passage holds the passage's n-grams by their length.
    """
    n = min(GRAM, len(part))
    if not n:
        return 1.0
    grams = grams_of(part, n)
    hit = np.isin(grams, passage[n])
    mask = np.zeros(len(part), bool)
    for i in range(n):
        mask[i : i + len(grams)] |= hit
    return float(mask.mean())


def aligned(part: np.ndarray, passage: np.ndarray, least: float) -> bool:
    """Whether at least that share of a part's words stands in its order within one word more than it has.

    Only windows that hold so many words of the part at all are aligned; the longest common sequence is counted
    with a bit for each word of the part.
    """
    n, size = len(part), min(len(part) + 1, len(passage))
    need = max(int(np.ceil(least * n - ROUNDING)), 0)
    own = np.concatenate([[0], np.cumsum(np.isin(passage, part))])
    places: dict[int, int] = {}
    for i, w in enumerate(part.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << n) - 1
    for s in np.flatnonzero(own[size:] - own[: len(own) - size] >= need):
        free = full
        for w in passage[s : s + size].tolist():
            met = free & places.get(w, 0)
            free = (free + met | free - met) & full
        if n - free.bit_count() >= need:
            return True
    return False


def whole_held(item: np.ndarray, passage: np.ndarray, shared: dict[int, np.ndarray], whole: float, overlap: float) -> bool:
    """Whether a passage holds enough of an item, whatever its parts are: by triples, or, as changed words break these, in aligned order."""
    return covered(item, shared) >= whole or (len(item) > GRAM and aligned(item, passage, overlap))


@dataclass
class Index:
    ids: list[int]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    vocab: np.ndarray  #: sorted term hashes
    top: np.ndarray  #: largest weight of a term
    start: np.ndarray  #: postings of a term, in the order of items
    item: np.ndarray
    weight: np.ndarray
    block_start: np.ndarray  #: block maxima of a term
    block: np.ndarray
    block_max: np.ndarray
    essential_start: np.ndarray  #: postings of a term in the items for which it is essential
    essential_item: np.ndarray
    essential_weight: np.ndarray
    rest: np.ndarray  #: weight of an item's other terms
    passage: int

    def search(self, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(items, scores) at or above the threshold for the distinct terms of a passage, in order: block-max WAND."""
        bar, n_items = threshold - ROUNDING, len(self.ids)
        cut_out = lambda xs, start: [xs[start[t] : start[t + 1]].tolist() for t in terms]
        items, weights = cut_out(self.item, self.start), cut_out(self.weight, self.start)
        maxima = [dict(zip(*x, strict=True)) for x in zip(cut_out(self.block, self.block_start), cut_out(self.block_max, self.block_start), strict=True)]
        top, place = self.top[terms].tolist(), [0] * len(items)
        cursors = sorted((x[0], k) for k, x in enumerate(items))
        found, scores = [], []

        def moved(those: list[tuple[int, int]], to: int) -> list[tuple[int, int]]:
            """Cursors at the first of their items from `to` on; those at their end go."""
            out = []
            for _, k in those:
                place[k] = i = bisect_left(items[k], to, place[k])
                if i < len(items[k]):
                    out.append((items[k][i], k))
            return out

        while cursors:
            bound = 0.0
            for n, (pivot, k) in enumerate(cursors, 1):
                bound += top[k]
                if bound >= bar:
                    break
            else:
                break
            while n < len(cursors) and cursors[n][0] == pivot:
                n += 1
            block = pivot // BLOCK
            if sum(maxima[k].get(block, 0.0) for _, k in cursors[:n]) < bar:
                after = cursors[n][0] if n < len(cursors) else n_items
                head = moved(cursors[:n], min((block + 1) * BLOCK, after))
            elif cursors[0][0] < pivot:
                head = moved(cursors[:n], pivot)
            else:
                # summed in the order of terms, so that equal passages have equal scores
                score = sum(weights[k][place[k]] for k in sorted(k for _, k in cursors[:n]))
                if score >= threshold:
                    found.append(pivot)
                    scores.append(score)
                head = moved(cursors[:n], pivot + 1)
            cursors = sorted(head + cursors[n:])
        return np.array(found, np.int64), np.array(scores)


def _ranges(start: np.ndarray, terms: np.ndarray) -> np.ndarray:
    lo, n = start[terms], start[terms + 1] - start[terms]
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


@dataclass
class Overall:
    """Figures of all items, wherever they are indexed."""

    n_items: int
    mean_words: float
    longest: int
    frequency: dict[int, int]


def _parts(items: list[tuple[int, str, str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(item_id, question, answer) as word hashes; items without words go."""
    return [(i, q, a) for i, q, a in ((i, words_in(q), words_in(a)) for i, q, a in items) if len(q) + len(a)]


def overall(items: list[tuple[int, str, str]]) -> Overall:
    """The figures of items that all stand in one index."""
    whole = [np.concatenate([q, a]) for _, q, a in _parts(items)]
    terms, df = np.unique(np.concatenate([np.unique(x) for x in whole] or [np.zeros(0, np.uint64)]), return_counts=True)
    return Overall(len(whole), float(np.mean([len(x) for x in whole] or [1])), max(map(len, whole), default=0), dict(zip(terms.tolist(), df.tolist(), strict=True)))


def build(items: list[tuple[int, str, str]], figures: Overall | None = None) -> Index | None:
    """Index of (item_id, question, answer); figures are those of these items, unless given for all."""
    figures = figures or overall(items)
    items = _parts(items)
    if not items:
        return None
    # items of like length share a block, so its maxima are tight
    items.sort(key=lambda x: (len(x[1]) + len(x[2]), x[0] is not None, x[0]))
    whole = [np.concatenate([q, a]) for _, q, a in items]
    rows = [np.unique(x, return_counts=True) for x in whole]
    terms = np.concatenate([t for t, _ in rows])
    item = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    tf = np.concatenate([c for _, c in rows]).astype(float)
    vocab, code = np.unique(terms, return_inverse=True)
    df = np.array([figures.frequency[int(t)] for t in vocab])
    idf = np.log(1 + (figures.n_items - df + 0.5) / (df + 0.5))
    size = np.array([len(x) for x in whole], float)[item]
    w = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / figures.mean_words))
    w /= np.bincount(item, w, len(rows))[item]
    # the lightest terms of an item, up to SLACK of its weight, aren't essential
    light = np.lexsort((w, item))
    first_of_item = np.searchsorted(item, np.arange(len(rows)))
    upto = np.cumsum(w[light])
    upto -= (upto - w[light])[first_of_item][item]
    essential = np.zeros(len(w), bool)
    essential[light] = upto > SLACK
    rest = np.bincount(item, np.where(essential, 0.0, w), len(rows))
    order = np.lexsort((item, code))
    code, item, w, essential = code[order], item[order], w[order], essential[order]
    starts = lambda codes: np.searchsorted(codes, np.arange(len(vocab) + 1))
    start = starts(code)
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)])
    return Index([i for i, _, _ in items], [q for _, q, _ in items], [a for _, _, a in items], vocab, np.maximum.reduceat(w, start[:-1]), start, item, w,
                 starts(code[first]), item[first] // BLOCK, np.maximum.reduceat(w, first), starts(code[essential]), item[essential], w[essential], rest, max(PASSAGE, 2 * figures.longest))


class Lookup:
    """Term numbers of word hashes: a table by the hash's high bits, then the full hash."""

    def __init__(self, vocab: np.ndarray):
        self.vocab, bits = vocab, max(12, int(len(vocab)).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.any = np.zeros(1 << bits, bool)
        self.any[(vocab >> self.shift).astype(np.int64)] = True

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, terms) of the words that the index has."""
        at = np.flatnonzero(self.any[(words >> self.shift).astype(np.int64)])
        code = np.minimum(np.searchsorted(self.vocab, words[at]), len(self.vocab) - 1)
        same = self.vocab[code] == words[at]
        return at[same], code[same]


def passages_above(words: np.ndarray, first: np.ndarray, index: Index, lookup: Lookup, threshold: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, first word, end, distinct terms) of the passages that can lift an item to the threshold.

    A passage is two cells of half its length. What the essential terms of each cell give to each item is summed
    once; a passage gets at most what both cells give, and the item's other terms.
    """
    half, n_items, bar = index.passage // 2, len(index.ids), threshold - ROUNDING
    n_words = np.diff(first)
    cells = np.maximum(-(-n_words // half), 1)
    cell_of_row = np.concatenate([[0], np.cumsum(cells)])
    at, code = lookup(words)
    if not len(at):
        return
    row = np.searchsorted(first, at, "right") - 1
    cell = cell_of_row[row] + (at - first[row]) // half
    keys = np.unique(cell * len(index.vocab) + code)
    cell, code = keys // len(index.vocab), keys % len(index.vocab)
    last = np.zeros(cell_of_row[-1] + 1, bool)
    last[cell_of_row[1:] - 1] = True
    each = _ranges(index.essential_start, code)
    pairs = np.repeat(cell, index.essential_start[code + 1] - index.essential_start[code]) * n_items + index.essential_item[each]
    pairs, inverse = np.unique(pairs, return_inverse=True)
    given = np.bincount(inverse, index.essential_weight[each], len(pairs))
    cell_of, item_of = pairs // n_items, pairs % n_items
    to = np.minimum(np.searchsorted(pairs, pairs + n_items), max(len(pairs) - 1, 0))
    joined = ~last[cell_of] & (pairs[to] == pairs + n_items)
    both = given + np.where(joined, given[to], 0.0)
    fit = np.zeros(cell_of_row[-1] + 1, bool)
    fit[cell_of[both + index.rest[item_of] >= bar]] = True
    # a row's last cell stands whole in the passage before, which may have nothing else of the item
    alone = cell_of[given + index.rest[item_of] >= bar]
    fit[alone[(alone > 0) & ~last[alone - 1]] - 1] = True
    begin = np.searchsorted(cell, np.arange(cell_of_row[-1] + 1))
    for c in np.flatnonzero(fit):
        if last[c] and c and not last[c - 1]:
            continue
        terms = np.unique(code[begin[c] : begin[c + 1 if last[c] else c + 2]])
        if index.top[terms].sum() >= bar:
            r = int(np.searchsorted(cell_of_row, c, "right")) - 1
            lo = first[r] + (c - cell_of_row[r]) * half
            yield r, int(lo), int(min(lo + index.passage, first[r + 1])), terms


_FOUND = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
_FOUND_TYPES = "doc_id {}, item_id bigint, score double, question_overlap double, answer_overlap double"


def leaks(words: np.ndarray, first: np.ndarray, index: Index, lookup: Lookup, threshold: float, overlap: float, whole: float | None) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item) -> best (score, question overlap, answer overlap) of the passages that leak the item."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for r, s, e, terms in passages_above(words, first, index, lookup, threshold):
        found, scores = index.search(terms, threshold)
        shared = {n: grams_of(words[s:e], n) for n in range(1, GRAM + 1)} if len(found) else {}
        for i, score in zip(found.tolist(), scores.tolist(), strict=True):
            q, a = covered(index.questions[i], shared), covered(index.answers[i], shared)
            if min(q, a) >= overlap or (whole is not None and whole_held(np.concatenate([index.questions[i], index.answers[i]]), words[s:e], shared, whole, overlap)):
                best[r, i] = max(best.get((r, i), (0.0, 0.0, 0.0)), (score, q, a))
    return best


def find(docs: DataFrame, indexes: list[Index], threshold: float, overlap: float, whole: float | None = None) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) against some indexes of bounded size, in one pass."""
    held = [docs.sparkSession.sparkContext.broadcast(x) for x in indexes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(h.value, Lookup(h.value.vocab)) for h in held]
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            data, offs = byte_view(b.column(1))
            for lo, hi in chunks(offs):
                if offs[lo] == offs[hi]:
                    continue
                words, first = words_of(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for ix, lookup in ready:
                    out += [(ids[lo + r], ix.ids[i], *x) for (r, i), x in leaks(words, first, ix, lookup, threshold, overlap, whole).items()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (b.column(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _FOUND)

    return docs.mapInArrow(run, _FOUND_TYPES.format(docs.schema["doc_id"].dataType.simpleString()))


def _terms(items: DataFrame) -> DataFrame:
    """(block, t, n): the distinct terms of each item of items(block, question, answer); n is its number of words beside one of them, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, q, a in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                w = np.concatenate([words_in(q), words_in(a)])
                t = np.unique(w).view(np.int64)
                n = np.zeros(len(t), np.int64)
                n[:1] = len(w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), block, np.int64)), pa.array(t), pa.array(n)], ["block", "t", "n"])

    return items.select("block", "question", "answer").mapInArrow(run, "block bigint, t bigint, n bigint")


def _in_blocks(items: DataFrame, size: int) -> DataFrame:
    """items with block, a number for successive items of `size` bytes together; a longer item has one of its own.

    Bytes are summed up in each partition, and partitions by their totals, so no task sees all items.
    """
    octets = F.octet_length(F.concat_ws(" ", "question", "answer")).cast("bigint")
    rows = cut(items.withColumn("at", F.monotonically_increasing_id()).withColumn("octets", octets)).withColumn("part", F.shiftright("at", 33))
    sums = rows.groupBy("part").agg(F.sum("octets").alias("all"))
    before = sums.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("before"))  # a row for each partition
    own = F.sum("octets").over(W.partitionBy("part").orderBy("at")) - F.col("octets")
    block = F.floor((F.col("own") + F.col("before")) / F.lit(size)).cast("bigint")
    return rows.withColumn("own", own).join(before, "part").select("item_id", "question", "answer", block.alias("block"))


def split_items(benchmark: DataFrame, answer_share: float = 1 / 3) -> DataFrame:
    """(item_id, question, answer) of an undivided text: its last third of blank-parted words is the answer."""
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+"), lambda x: x != "")
    n = F.size("w")
    k = n - F.floor(n * answer_share)
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), words.alias("w")).select(
        "item_id", F.array_join(F.slice("w", F.lit(1), k.cast("int")), " ").alias("question"),
        F.array_join(F.slice("w", (k + 1).cast("int"), n), " ").alias("answer"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, whole: float | None = None) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each row of docs and item it leaks.

    docs(doc_id, text), items(item_id, question, answer). score is BM25 over the item's own. The items are
    indexed in blocks of bounded bytes, INDEXES of which are broadcast for one pass over the documents; results
    are the same for any number of blocks. Null and empty texts leak nothing; items without words are never
    found; a part without words counts as covered, one of fewer than three words if it stands whole in the
    passage; an item without an id is found under null; repeated rows and items each count; other columns aren't
    read. With `whole`, for items whose parts are made up, an item also counts if that share of question and
    answer together is covered, or if `overlap` of one of more than three words stands in aligned order.
    doc_id may also be binary, and is given back as it is.
    """
    spark = docs.sparkSession
    short_batches(spark)
    kind = "binary" if isinstance(docs.schema["doc_id"].dataType, BinaryType) else "bigint"
    docs = docs.select(F.col("doc_id").cast(kind), F.col("text").cast("string"))
    items = cut(_in_blocks(items.select(F.col("item_id").cast("bigint"), F.col("question").cast("string"), F.col("answer").cast("string")), INDEX_BYTES))
    terms = cut(_terms(items))
    n_items, mean, longest = terms.where("n > 0").agg(F.count("*"), F.avg("n"), F.max("n")).first()
    counts = terms.groupBy("t").agg(F.count("*").alias("df"))
    numbers = sorted(r["block"] for r in terms.select("block").distinct().collect())  # a number for each INDEX_BYTES of items
    out = []
    for lo in range(0, len(numbers), INDEXES):
        indexes = []
        for k in numbers[lo : lo + INDEXES]:
            own = counts.join(terms.where(F.col("block") == k).select("t").distinct(), "t").collect()  # as many as INDEX_BYTES have
            figures = Overall(n_items, mean, longest, {r["t"] & (2**64 - 1): r["df"] for r in own})
            indexes.append(build([(r["item_id"], r["question"], r["answer"]) for r in items.where(F.col("block") == k).collect()], figures))
        out.append(find(docs, [x for x in indexes if x], threshold, overlap, whole))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], _FOUND_TYPES.format(kind))
