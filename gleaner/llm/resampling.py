"""Importance resampling towards a target's distribution of hashed word n-grams, without explosion of texts.

Higher-order functions make the array of a document's buckets. Counts of buckets are summed where they arise, so
only totals are shuffled; the gain of each bucket, a logarithm of target over source frequency, goes back as one
literal array of `buckets` longs, and a document's weight is an aggregate over its own array. Documents are then
drawn by weight plus a Gumbel number made of their id, the highest scores first.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.binding import bound
from gleaner.llm.common import cut, running, split_longs

#: Digits, letters a-z and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Words that a document must have to be drawn, and the share of such documents that is.
LEAST_WORDS, PERCENT = 20, 10


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def bucket_array(text: Column, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to `longest` consecutive words of a text, repeats included; of a null, none."""

    def of_length(words: Column, k: int) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))

    def runs(words: Column) -> Column:
        return F.flatten(F.array(words, *[of_length(words, k) for k in range(2, longest + 1)]))

    features = _words(text) if longest == 1 else bound(_words(text), runs)
    return F.transform(features, lambda x: (F.crc32(x) % buckets).cast("int"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """What an occurrence of each bucket adds to a weight, in thousandths: `buckets` numbers, whatever the input.

    Tables without texts count nothing, so all gains are alike then.
    """
    sides = [t.select(F.lit(i).alias("side"), F.explode(bucket_array(F.col("text"), longest, buckets)).alias("bucket")) for i, t in enumerate((docs, target))]
    counts = sides[0].unionByName(sides[1]).groupBy("bucket").agg(F.count_if(F.col("side") == 0).alias("s"), F.count_if(F.col("side") == 1).alias("t"))
    source, aim = [0] * buckets, [0] * buckets
    for r in counts.collect():  # a row for each bucket at most
        source[r["bucket"]], aim[r["bucket"]] = r["s"], r["t"]
    every, wanted = float(sum(source) + buckets), float(sum(aim) + buckets)
    return [math.floor(1000 * math.log((t + 1.0) * every / ((s + 1.0) * wanted))) for s, t in zip(source, aim, strict=True)]


def weighed(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row; a document without features weighs nothing."""
    per = split_longs(gain)
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("w"))
    summed = F.aggregate(bucket_array(F.col("text"), longest, len(gain)), zero, lambda a, b: F.struct((a["n"] + 1).alias("n"), (a["w"] + F.element_at(per, b + 1)).alias("w")))
    n = F.col("x.n")
    words = n if longest == 1 else F.size(_words(F.col("text"))).cast("bigint")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.ln(-F.ln((draw + 0.5) / 4294967296.0))).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", summed.alias("x"))
    return rows.select("doc_id", words.alias("n_words"), n.alias("n_features"), F.col("x.w").alias("weight"), (F.col("x.w") + gumbel).alias("score"))


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs(doc_id, text), by the texts of target(text).

    Of the N rows with at least `least` words, percent * N / 100 are drawn (rounded down): the highest scores, of
    equals the smaller doc_id. rank counts them from 1; rows that aren't drawn have none. A null text is empty, a
    row without doc_id draws by an empty id and stands last among equals, repeated rows are rows like others; an
    empty table gives no rows, an empty target one weight for every feature. Other columns aren't read.
    """
    fields = ["doc_id", "n_features", "weight", "score"]
    scored = cut(weighed(docs, gains(docs, target, longest, buckets), longest, seed).select(*fields, (F.col("n_words") >= least).alias("fit")))
    # rows that are alike are told apart by a number, so that however many of them don't meet in one range
    alike = scored.groupBy(*fields, "fit").agg(F.count("*").alias("rows"))
    each = alike.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("copy")]
    placed, totals = running(each.where("fit").drop("rows", "fit"), order)
    drawn = totals["n"] * percent // 100
    rank = F.when(F.col("n") < drawn, F.col("n") + 1)
    return placed.select(*fields, rank.alias("rank")).unionByName(each.where("not fit").select(*fields, F.lit(None).cast("bigint").alias("rank")))
