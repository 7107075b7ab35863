"""The trie of conversations' prefixes, numbered in preorder.

A distinct sequence of turns is a string of 128-bit turn codes; sorted, these strings give the sequences the order in
which a walk through the trie, parents first, meets their ends. A node is a prefix of sequences, its members stand
together in that order, and it is met first at the least of them. So nodes sorted by (first sequence, depth) stand in
preorder, and a subtree is an interval: it ends before the first node of the sequence after the node's last one.
Leaves and savings of a subtree are then differences of prefix sums over the preorder, which are summed range by range.

Texts stay where they are read: only a turn's code and its number of words are shuffled, 24 bytes a turn. A row holds
the codes of one conversation; equal conversations are one row from the first aggregate on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, mixed, running

#: Conversations that share the beginning of the first of them, and the number of beginnings there are.
FAMILY, LONGEST_HEAD = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of ids that are laid together before they are hashed.
CHUNK = 1 << 16


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<code binary, words bigint>>) of conversations(conv_id, turn, role, text) by turn.

    A null turn comes first, null roles and texts are empty; equal turns stand by role, then by the code of the text.
    Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), role.alias("role"), code.alias("code"), words.alias("words")).alias("x"))
    sorted_turns = F.array_sort(F.collect_list("x"))
    return rows.groupBy("conv_id").agg(F.transform(sorted_turns, lambda x: F.struct(x["code"].alias("code"), x["words"].alias("words"))).alias("turns"))


def rebuilt(lists: DataFrame, family: int = FAMILY, longest: int = LONGEST_HEAD) -> DataFrame:
    """lists with each conversation's first turns taken from the first conversation of its family.

    Of conversation c the first crc32(c) % longest turns are those of conversation c - c % family (all if it has
    fewer, none if there is none), its own turns follow after as many. The remainder has the sign of c, as in SQL.
    """
    heads = lists.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, longest - 1).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")
    own, head = F.col("turns"), F.coalesce("head", F.array().cast(lists.schema["turns"].dataType))
    tail = F.slice(own, n + 1, F.greatest(F.size(own) - n, F.lit(0)))
    joined = lists.withColumn("first", F.col("conv_id") - F.col("conv_id") % family).join(heads, "first", "left")
    return joined.select("conv_id", F.concat(F.slice(head, F.lit(1), n), tail).alias("turns"))


_SEQUENCES = "conv_id bigint, key binary, a array<bigint>, b array<bigint>, words array<bigint>"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation its codes in one string, and of each of its prefixes, the empty one first, 128 bits (a, b) that tell it."""
    schema = pa.schema([("conv_id", pa.int64()), ("key", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("a", "b", "words")]])
    for batch in batches:
        turns = batch.column(1)
        at = turns.offsets.to_numpy().astype(np.int64)
        flat = turns.values
        codes = b"".join(flat.field(0).to_pylist())
        words = np.asarray(flat.field(1).to_numpy(zero_copy_only=False), np.int64)
        halves = np.frombuffer(codes, np.uint64).reshape(-1, 2)
        keys, columns = [], ([], [], [])
        with np.errstate(over="ignore"):
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                place = np.arange(1, hi - lo + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                keys.append(codes[16 * lo : 16 * hi])
                for j in (0, 1):  # a sum of hashes of (turn, place) is the same for equal prefixes, wherever they stand
                    steps = mixed(mixed(halves[lo:hi, j] ^ place) + halves[lo:hi, 1 - j])
                    columns[j].append(np.r_[np.uint64(0), np.cumsum(steps, dtype=np.uint64)].view(np.int64))
                columns[2].append(np.r_[0, words[lo:hi]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *[pa.array(c, pa.list_(pa.int64())) for c in columns]], schema=schema)


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, conv_id) that stand sorted, as (a, b, first, ids): decimal ids of one node, comma-joined, in pieces."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    node, held, size = None, [], 0
    done: list[tuple] = []

    def table():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else ([],) * 4, schema.types, strict=True)], schema=schema)

    for batch in batches:
        for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and ((a, b) != node or size > CHUNK):
                done.append((*node, held[0], ",".join(map(str, held))))
                held, size = [], 0
            node = (a, b)
            held.append(c)
            size += len(str(c)) + 1
        yield table()
        done = []
    if held:
        done.append((*node, held[0], ",".join(map(str, held))))
        yield table()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that stand sorted by (a, b, first), as (a, b, sha): a piece at a time goes through the hash."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sha", pa.string())])
    node, digest = None, None
    done: list[tuple] = []
    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
            if (a, b) == node:
                digest.update(b"," + ids.encode())
                continue
            if node:
                done.append((*node, digest.hexdigest()))
            node, digest = (a, b), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else ([], [], []), schema.types, strict=True)], schema=schema)
        done = []
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, digest.hexdigest()), schema.types, strict=True)], schema=schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(a, b, sha) of ends(a, b, conv_id): SHA-256 of each node's ids, ascending and comma-joined.

    A hash has to see its bytes in order, so one task has the last word on a node; sorting and printing ids is dealt
    out by ranges, and that task takes the printed pieces one after another.
    """
    order = ["a", "b", "conv_id"]
    pieces = cut(ends).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_laid, "a bigint, b bigint, first bigint, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a bigint, b bigint, sha string")


def prefix_trie(lists: DataFrame) -> DataFrame:
    """The nodes of the trie of lists(conv_id, turns), each conversation once, from the root of no turns on.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), as the README tells.
    Conversations without turns are members of the root alone, and so are its ends. No conversations: no nodes.
    Nodes are told apart by 128 bits of their turns' codes.
    """
    whole = cut(lists.mapInArrow(_prefixes, _SEQUENCES))
    last = lambda c: F.element_at(c, -1)
    ends = whole.select(last("a").alias("a"), last("b").alias("b"), "conv_id")
    alike = ends.groupBy("a", "b").agg(F.count("*").alias("members"), F.min("conv_id").alias("conv_id"))
    distinct = alike.drop("a", "b").join(whole, "conv_id")  # a row of each distinct sequence
    ranked, totals = running(distinct, ["key"])
    n_sequences = totals["n"]

    at = lambda c, i: F.element_at(c, i)
    deep = ranked.select("conv_id", "members", F.col("n").alias("first"), "a", "b", "words", F.explode(F.sequence(F.lit(1), F.size("a"))).alias("i"))
    above = lambda c: F.when(F.col("i") > 1, at(c, F.greatest(F.col("i") - 1, F.lit(1))))
    prefixes = deep.select("conv_id", "members", "first", at("a", F.col("i")).alias("a"), at("b", F.col("i")).alias("b"), above("a").alias("up_a"), above("b").alias("up_b"),
                           (F.col("i") - 1).cast("bigint").alias("depth"), at("words", F.col("i")).alias("words"))
    nodes = cut(prefixes.groupBy("a", "b", "up_a", "up_b", "depth", "words").agg(
        F.sum("members").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("first").alias("first"), F.count("*").alias("sequences")))

    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    leaf = F.col("n_children").isNull().cast("bigint")
    listed = nodes.join(children, ["a", "b"], "left").withColumn("leaf", leaf).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    preorder, sums = running(listed, ["first", "depth"], ["leaf", "saved"])
    before = lambda c: F.col(f"{c}_upto") - F.col(c)
    preorder = preorder.withColumns({f"{c}_before": before(c) for c in ("leaf", "saved")})
    # where a subtree ends, the first node of the next sequence stands; sums only grow, so the least are that node's
    starts = preorder.groupBy(F.col("first").alias("after")).agg(*[F.min(f"{c}_before").alias(f"{c}_end") for c in ("leaf", "saved")])
    inside = lambda c: F.coalesce(f"{c}_end", F.lit(sums[c])) - F.col(f"{c}_before")
    spans = preorder.withColumn("after", F.when(F.col("first") + F.col("sequences") < n_sequences, F.col("first") + F.col("sequences")))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    told = spans.join(starts, "after", "left").join(parents, ["up_a", "up_b"], "left").join(ends_digests(ends), ["a", "b"], "left")
    return told.select(
        "conv_id", "depth", "parent_conv_id", F.col("n_convs").cast("bigint").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        inside("leaf").cast("bigint").alias("n_leaves"), inside("saved").cast("bigint").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = FAMILY, longest: int = LONGEST_HEAD) -> DataFrame:
    """prefix_trie of conversations(conv_id, turn, role, text), each rebuilt (see `rebuilt`); other columns aren't read."""
    return prefix_trie(rebuilt(cut(turn_lists(conversations)), family, longest))
