"""Removal of repeated passages: prefix-free parsing of texts into phrases, and the order of the dictionary's suffixes.

A byte string of `length` bytes (100) is removed where it also starts earlier in the corpus. Rolling hashes of
`k` bytes give triggers: the trigger of a string is its least k-byte hash, so equal strings have equal
triggers. The strings of a text that follow each other and share a trigger form a phrase with its overlap.
A phrase therefore begins and ends where the content says so, whatever stands around it.

- The dictionary holds each distinct phrase once, with its first place; the parse is the list of places.
  Every later place of a phrase is removed whole, and nothing in it is looked at again. Phrases are the same if
  their triggers and the 128 bits of their BLAKE2b digests are.
- Only where phrases of one trigger also agree on the bytes beside it, on one side at least, can suffixes of
  different phrases begin with the same string: a string that holds its trigger reaches far on one side or
  the other. The bytes of those phrases meet by trigger. Their suffixes are ranked by doubling depths, each from
  the ranks of its two halves, to `length` bytes: equal ranks are equal bytes. All but the first place of each
  string are removed.

Phrases overlap by `length` - 1 bytes, so a string never goes on from one phrase into the next: the order of
suffixes to this depth needs the dictionary's alone, and the parse only gives each suffix its places.

Triggers that very many phrases share aren't ranked in one task: their strings part by a hash of all their
bytes, after each batch of documents has kept its own first place of each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import _BASE, _TABLE, CHUNK_BYTES, byte_view, chunks, mixed, powers, short_batches, span_hashes, use_shared_checkpoints

LENGTH, K = 100, 16
_SUB = 31  #: a place is the start in the text, with the number of a repeated id's text above these bits
_NO_ID = -(2**63)
_PLACES = "key bigint, phrase bigint, digest bigint, sides bigint, doc bigint, at bigint, meta int"
_FIELDS = ["key", "phrase", "digest", "sides", "doc", "at", "meta"]
#: kind of a place (the two low bits of meta): open, open with its trigger twice, removed, open with a trigger of very many phrases
OPEN, INNER, GONE, HOT = 0, 1, 2, 3
#: meta holds, above the kind, the trigger's offset in the phrase (7 bits) and the number of strings
_OFFSET, _COUNT = 2, 9
#: Setting by which a query's shuffle files are removed at its end
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of places that are taken at once, rows of one trigger that are held to compare their phrases, and bytes of phrases that are ranked at once.
ROWS, HELD, RANKED = 1 << 16, 1 << 14, 1 << 21
#: Places that a task gathers before it keeps the first of each phrase.
GATHERED = 1 << 19
#: Strings of hot triggers that a task holds to find those it has already met.
SPELT = 1 << 18


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from every place, by doubling lengths."""
    parts, size, h, at = [], 1, _TABLE[data], 0
    while size <= k:
        if k & size:
            parts.append((at, size, h))
            at += size
        if 2 * size > k:
            break
        h = h[:-size] * np.uint64(pow(_BASE, size, 2**64)) + h[size:] if len(h) > size else h[:0]
        size *= 2
    n = max(len(data) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for at, size, h in parts:
        out = out * np.uint64(pow(_BASE, size, 2**64)) + h[at : at + n]
    return mixed(out)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def phrases(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(start, number of strings, trigger, two halves of the digest, sides, meta) of each phrase.

    sides are two 32-bit hashes, of the trigger with the bytes before it and after it, to a depth of half of what a
    string leaves; 0 for a side that the phrase doesn't reach.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none, none, none, none.astype(np.int32)
    width = length - k + 1
    h = rolling(data, k)
    least = _sliding(h, width, np.minimum)
    inside = np.zeros(len(least) + 1, np.int64)
    ends = np.maximum(offs[1:] - length + 1, offs[:-1])
    whole = ends > offs[:-1]
    np.add.at(inside, offs[:-1][whole], 1)
    np.add.at(inside, ends[whole], -1)
    inside = np.cumsum(inside[:-1]) > 0
    starts = np.zeros(len(least), bool)
    starts[offs[:-1][whole]] = True
    change = (least[1:] != least[:-1]) | starts[1:]
    first, last = inside.copy(), inside.copy()
    first[1:] &= change | ~inside[:-1]
    last[:-1] &= change | ~inside[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    key = least[lo]
    if not len(lo):
        return lo, lo, key, lo, lo, lo, lo.astype(np.int32)
    # triggers' places, and those that follow an equal trigger closely
    pad = np.zeros(width - 1, np.uint64)
    spots = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    same = np.flatnonzero((h[spots[1:]] == h[spots[:-1]]) & (np.diff(spots) <= width))
    one, two = np.append(spots[same], len(data) + length), np.append(spots[same + 1], 2 * (len(data) + length))
    twice = two[np.searchsorted(one, lo)] < hi + width - 1
    # a phrase that holds its trigger once holds it in all of its strings
    at = np.minimum(np.searchsorted(spots, hi - 1), len(spots) - 1)
    while (wrong := ~twice & (h[spots[at]] != key) & (at < len(spots) - 1)).any():
        at = at + wrong
    x = np.where(twice, lo, spots[at])
    half = (length - k) // 2
    left, right = ~twice & (x - half >= lo), ~twice & (x + length - half <= hi - 1 + length)
    before = span_hashes(data, np.maximum(x - half, 0), x + k)
    after = span_hashes(data, x, np.minimum(x + length - half, len(data)))
    low = np.uint64(0xFFFFFFFF)
    sides = (np.where(left, before | np.uint64(1), np.uint64(0)) << np.uint64(32)) | np.where(right, (after & low) | np.uint64(1), np.uint64(0))
    meta = ((hi - lo) << _COUNT) | (np.clip(x - lo, 0, 127) << _OFFSET) | np.where(twice, INNER, OPEN)
    raw, digest = data.tobytes(), hashlib.blake2b
    told = b"".join([digest(raw[x:y], digest_size=16).digest() for x, y in zip(lo.tolist(), (hi + length - 1).tolist(), strict=True)])
    halves = np.frombuffer(told, np.int64).reshape(-1, 2)
    return lo, hi - lo, key, halves[:, 0], halves[:, 1], sides.view(np.int64), meta.astype(np.int32)


def _pieces(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each part, its start in the row) in parts of bounded size; long rows overlap by length - 1."""
    for lo, hi in chunks(offs):
        if hi - lo > 1 or offs[hi] - offs[lo] <= CHUNK_BYTES:
            yield data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64)
            continue
        for s in range(0, int(offs[hi] - offs[lo]), CHUNK_BYTES):
            part = data[offs[lo] + s : min(offs[lo] + s + CHUNK_BYTES + length - 1, offs[hi])]
            yield part, np.array([0, len(part)]), np.array([lo]), np.array([s])


def _first_kept(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Keeps the first place of each phrase; the others are marked gone and get a key of their place."""
    key, phrase, digest, _, doc, at, _ = cols
    order = np.lexsort((at, doc, digest, phrase, key))
    key, phrase, digest, sides, doc, at, meta = (c[order] for c in cols)
    later = np.zeros(len(key), bool)
    later[1:] = (key[1:] == key[:-1]) & (phrase[1:] == phrase[:-1]) & (digest[1:] == digest[:-1])
    # the same place twice is a repeated row: no place before itself
    fresh = np.flatnonzero(~later)
    leader = fresh[np.cumsum(~later) - 1]
    later &= (doc != doc[leader]) | (at != at[leader])
    meta = np.where(later, (meta >> _OFFSET << _OFFSET) | GONE, meta)
    key = np.where(later, mixed(doc.view(np.uint64) * np.uint64(31) + at.view(np.uint64)).view(np.int64), key)
    return [key, *(np.where(later, 0, c) for c in (phrase, digest, sides)), doc, at, meta]


def _batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (*[np.int64] * 6, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t, copy=False)) for c, t in zip(cols, kinds, strict=True)], _FIELDS)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of many small batches at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            t = pa.Table.from_batches(held)
            yield [c.to_numpy() for c in t.columns]
            held, n = [], 0
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def _parse(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for b in batches:
            doc, sub = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            data, offs = byte_view(b.column(2))
            for part, o, rows, base in _pieces(data, offs, length):
                lo, _, key, phrase, digest, sides, meta = phrases(part, o, length, k)
                j = np.searchsorted(o, lo, "right") - 1
                row = rows[j]
                at = lo - o[j] + base[j] + (sub[row].astype(np.int64) << _SUB)
                out.append([key.view(np.int64), phrase, digest, sides, doc[row], at, meta])
                n += len(lo)
            if n >= GATHERED:
                yield _batch(_first_kept([np.concatenate(c) for c in zip(*out, strict=True)]))
                out, n = [], 0
        if out:
            yield _batch(_first_kept([np.concatenate(c) for c in zip(*out, strict=True)]))

    return run


def _shared(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether a side (not 0) stands in another row of the group too."""
    order = np.lexsort((side, group))
    g, x = group[order], side[order]
    pair = (g[1:] == g[:-1]) & (x[1:] == x[:-1]) & (x[1:] != 0)
    out = np.zeros(len(group), bool)
    out[order[1:][pair]] = out[order[:-1][pair]] = True
    return out


def _told(cols: list[np.ndarray], leader: list[np.ndarray] | None, compare: bool, length: int, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(places that go and strings to order, the last phrase's first place) of places in order.

    leader is the first place of the phrase that the rows before ended with. With compare, only phrases that
    share a side with another of their trigger are told, and of those only the strings that hold that side;
    else all are told, as of a hot trigger.
    """
    key, phrase, digest, sides, doc, at, meta = cols if leader is None else [np.concatenate(c) for c in zip(leader, cols, strict=True)]
    new = np.r_[True, (key[1:] != key[:-1]) | (phrase[1:] != phrase[:-1]) | (digest[1:] != digest[:-1])]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = ~new & ((doc != doc[lead]) | (at != at[lead]))
    n, offset, inner = meta >> _COUNT, (meta >> _OFFSET) & 127, (meta & 3) == INNER
    fresh = new.copy()
    if leader is not None:
        fresh[0] = False
    i = np.flatnonzero(fresh)
    if compare:
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]])[i]
        # strings of a phrase that holds its trigger twice may equal any of its trigger's: all of that trigger are told
        several = np.bincount(group)[group] > 1
        mark = np.zeros(group.max(initial=0) + 1, bool)
        mark[group[inner[i]]] = True
        # such a phrase may also repeat itself
        whole = inner[i] | (several & mark[group])
        left, right = _shared(group, sides[i] >> 32), _shared(group, sides[i] & 0xFFFFFFFF)
        cut = np.clip(offset[i] - (length - k) // 2 + 1, 0, n[i])  # strings that reach far before the trigger
        skip = np.where(whole | left, 0, cut)
        take = np.where(whole, n[i], np.where(left, cut, 0) + np.where(right, n[i] - cut, 0))
    else:
        skip, take = np.zeros(len(i), np.int64), n[i]
    kept = [c[i][take > 0] for c in (key, phrase, digest, sides, doc)] + [(at[i] + skip)[take > 0], ((take << _COUNT) | (OPEN if compare else HOT))[take > 0]]
    left_out = [c[gone] for c in (key, phrase, digest, sides, doc, at)] + [((n << _COUNT) | GONE)[gone]]
    end = int(lead[-1])
    return [np.concatenate(c) for c in zip(kept, left_out, strict=True)], [c[end : end + 1] for c in (key, phrase, digest, sides, doc, at, meta)]


def _dictionary(length: int, k: int):
    """Over places in the order of phrases and documents: the places that go, and the dictionary's strings to order.

    The rows of a trigger are held to be compared; of a trigger with more than HELD rows only the last
    phrase's first place is, and all its phrases are told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        leader, hot = None, None
        for cols in _gathered(batches):
            passed = (cols[6] & 3) == GONE
            if passed.any():
                yield _batch([c[passed] for c in cols])
                cols = [c[~passed] for c in cols]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
                held = None
            if not len(cols[0]):
                continue
            if leader is not None:
                same = int(np.searchsorted(cols[0], hot, "right"))
                out, leader = _told([c[:same] for c in cols], leader, False, length, k) if same else ([c[:0] for c in cols], leader)
                yield _batch(out)
                cols = [c[same:] for c in cols]
                if not len(cols[0]):
                    continue
                leader = hot = None
            start = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if start:
                yield _batch(_told([c[:start] for c in cols], None, True, length, k)[0])
            held = [c[start:] for c in cols]
            if len(held[0]) > HELD:
                hot = held[0][0]
                out, leader = _told(held, None, False, length, k)
                yield _batch(out)
                held = None
        if held is not None:
            yield _batch(_told(held, None, True, length, k)[0])

    return run


_PIECES = "key bigint, doc bigint, at bigint, n int, piece binary"


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "doc", "at", "n", "piece"])


def _spell(length: int):
    """The bytes of the dictionary's phrases listed for a text: (key, place, piece).

    Phrases of hot triggers are spelt string by string, with a hash of the string for a key; of a string that
    SPELT successive ones hold more than once the first place is spelt, and the others go: they have n strings and no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, subs, texts, lists = (b.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            first: dict[bytes, tuple] = {}

            def spelt():
                rows = [(int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True), doc, at, 0, string) for string, (doc, at) in first.items()]
                first.clear()
                return rows

            for doc, sub, z, found in zip(docs, subs, texts, lists, strict=True):
                raw, high = zstandard.decompress(z), sub << _SUB
                for x in found:
                    place, n = x["at"] - high, x["n"]
                    if not x["hot"]:
                        out.append((x["key"], doc, x["at"], 0, raw[place : place + n + length - 1]))
                        continue
                    for i in range(place, place + n):
                        string, here = raw[i : i + length], (doc, i + high)
                        there = first.setdefault(string, here)
                        if there != here:
                            first[string], gone = min(here, there), max(here, there)
                            out.append((hash(gone), *gone, 1, None))
                        if len(first) + len(out) > SPELT:
                            yield _pieces_batch(out + spelt())
                            out = []
            out += spelt()
            if out:
                yield _pieces_batch(out)

    return run


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the `length` bytes (8 or more) from each place, among all places; beyond the end stand zeros.

    Ranks of 8 bytes are those of numbers; ranks of a greater depth follow from those of two halves that meet or
    overlap, so each round sorts numbers, however deep.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    h = np.zeros(len(data), np.uint64)
    for i in range(8):
        h = (h << np.uint64(8)) | padded[i : i + len(data)]
    rank, depth = np.unique(h, return_inverse=True)[1].astype(np.int64), 8
    while depth < length:
        step = min(depth, length - depth)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        rank, depth = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64), depth + step
    return rank


def _repeated(keys: np.ndarray, docs: np.ndarray, ats: np.ndarray, pieces: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, at, n): runs of strings of pieces that also start at an earlier place of a piece of their key."""
    sizes = np.array([len(x) for x in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = sizes - length + 1
    rank = suffix_ranks(np.frombuffer(b"".join(pieces), np.uint8), length)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    rank, group = rank[begin[row] + inside], np.cumsum(np.r_[0, keys[1:] != keys[:-1]])[row]
    doc, at = docs[row], ats[row] + inside
    order = np.lexsort((at, doc, rank, group))
    new = np.r_[True, (group[order][1:] != group[order][:-1]) | (rank[order][1:] != rank[order][:-1])]
    leader = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    gone = np.zeros(len(row), bool)
    gone[order] = (doc[order] != doc[leader]) | (at[order] != at[leader])
    starts = gone & ~np.r_[False, gone[:-1] & (row[1:] == row[:-1])]
    ends = gone & ~np.r_[gone[1:] & (row[1:] == row[:-1]), False]
    lo, hi = np.flatnonzero(starts), np.flatnonzero(ends)
    yield doc[lo], at[lo], hi - lo + 1


_RUNS = "doc bigint, at bigint, n int"


def _ranked(length: int):
    """Over pieces in the order of their keys: the runs of strings that go. Whole keys are ranked together, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, doc, at = (t.column(i).to_numpy() for i in range(3))
            for d, a, n in _repeated(key, doc, at, t.column(4).to_pylist(), length) if len(key) else ():
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(n.astype(np.int32))], ["doc", "at", "n"])

        size = 0
        for b in batches:
            passed = b.filter(pa.compute.is_null(b.column(4)))
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays(passed.columns[1:4], ["doc", "at", "n"])
                b = b.filter(pa.compute.is_valid(b.column(4)))
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size < RANKED:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                yield from told(t.slice(0, last))
                held = t.slice(last).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from told(pa.Table.from_batches(held))

    return run


def _cut_out(length: int):
    """The bytes that stay of each text, and figures of what went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists = b.column(1).to_pylist(), b.column(2).to_pylist()
            rows = []
            for z, found in zip(texts, lists, strict=True):
                raw = zstandard.decompress(z)
                data, spans, removed = np.frombuffer(raw, np.uint8), 0, 0
                if found:
                    lo = np.array([x["at"] for x in found], np.int64) & ((1 << _SUB) - 1)
                    hi = lo + np.array([x["n"] for x in found]) + length - 1
                    steps = np.zeros(len(data) + 1, np.int32)
                    np.add.at(steps, lo, 1)
                    np.add.at(steps, hi, -1)
                    covered = np.cumsum(steps[:-1]) > 0
                    spans, removed = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()), int(covered.sum())
                    raw = data[~covered].tobytes()
                rows.append((len(data), removed, spans, raw))
            n, removed, spans, kept = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = [hashlib.sha256(x).hexdigest() for x in b.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sums, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle that brings their places to them."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in batches:
        z = [squeeze.compress((t or "").encode()) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], ["doc", "sub", "z"])


def _stored(df: DataFrame) -> DataFrame:
    """Writes df once, as Parquet in the shared checkpoint folder; its shuffle files go when that is done."""
    spark = df.sparkSession
    use_shared_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/places-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.parquet(path)


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, sub, text) of every row, and the same with repeated rows once: a null id is the smallest; sub numbers the different texts of a repeated id."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    again = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    if not again.limit(1).count():
        rows = rows.select("doc", F.lit(0).cast("bigint").alias("sub"), "text")
        return rows, rows
    hashed = rows.withColumn("h", F.sha2("text", 256))
    named = hashed.join(again, "doc", "left_semi").select("doc", "h", F.substring("h", 1, 3).alias("range")).distinct()
    # numbered in ranges of the hash, so that an id of very many texts isn't one task's
    sizes = named.groupBy("doc", "range").agg(F.count("*").alias("n"))
    before = sizes.select("doc", "range", (F.sum("n").over(W.partitionBy("doc").orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("doc", "range").orderBy("h")) - 1
    ranked = named.withColumn("own", own).join(before, ["doc", "range"]).select("doc", "h", (F.col("own") + F.col("before")).cast("bigint").alias("sub"))
    each = hashed.join(ranked, ["doc", "h"], "left").select("doc", F.coalesce("sub", F.lit(0)).alias("sub"), "text")
    alone = rows.join(again, "doc", "left_anti").select("doc", F.lit(0).cast("bigint").alias("sub"), "text")
    # only rows of a repeated id can be repeated; equal ones become one where they are read, before any shuffle
    repeated = rows.join(again, "doc", "left_semi").distinct().withColumn("h", F.sha2("text", 256)).join(ranked, ["doc", "h"]).select("doc", "sub", "text")
    return each, alone.union(repeated)


def _in_order(places: DataFrame) -> DataFrame:
    return places.repartition("key").sortWithinPartitions("key", "phrase", "digest", "doc", "at")


def removed_places(rows: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc, at, n): n successive strings from `at` are repeats of earlier ones. rows: (doc, sub, text), each (doc, sub) once."""
    short_batches(rows.sparkSession)
    long_rows = rows.where(F.octet_length("text") >= length)
    places = long_rows.mapInArrow(_parse(length, k), _PLACES)
    count, kind = F.shiftright("meta", _COUNT).alias("n"), F.col("meta").bitwiseAND(F.lit(3))
    told = _stored(_in_order(places).mapInArrow(_dictionary(length, k), _PLACES).select("key", "doc", "at", count, (kind == GONE).alias("gone"), (kind == HOT).alias("hot")))
    listed = told.where("not gone").groupBy("doc", F.shiftright("at", _SUB).alias("sub")).agg(F.collect_list(F.struct("key", "at", "n", "hot")).alias("found"))
    pieces = _packed(long_rows).join(listed, ["doc", "sub"]).select("doc", "sub", "z", "found").mapInArrow(_spell(length), _PIECES)
    more = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_ranked(length), _RUNS)
    return told.where("gone").select("doc", "at", "n").union(_stored(more))


def _packed(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_pack, "doc bigint, sub bigint, z binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row of docs(doc_id, text).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or
    before in the same text. Null texts are empty; a null doc_id stands before all others. Rows equal in
    doc_id and text are one document, and each gets its result; different texts of one doc_id are documents
    in the order of a hash. Texts under `length` bytes stay. Other columns aren't read.
    """
    rows, distinct = _numbered(docs)
    gone = removed_places(distinct, length, k).groupBy("doc", F.shiftright("at", _SUB).alias("sub")).agg(F.collect_list(F.struct("at", "n")).alias("found"))
    joined = _packed(rows).join(gone, ["doc", "sub"], "left")
    named = joined.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "z", "found")
    return named.mapInArrow(_cut_out(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digests(kept: DataFrame) -> DataFrame:
    """The result of without_repeats with a SHA-256 in place of the bytes."""
    return kept.mapInArrow(_digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
