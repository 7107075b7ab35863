"""The queries of this subpackage, by name: (spark, sf_dir) -> DataFrame, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, linear, media, minhash, mixing, oracles, prefix_trie, quotes, repeats, resampling, sharding, simhash, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Three edits of every document's stored tree: a cut at a quarter, an insertion in the middle, a change at three quarters."""
    trees = tokens.stored(tokens.planted(table(spark, sf_dir, "documents"), vocabulary))
    n = F.length("text")
    edit = lambda seq, share, removed, added: F.struct(
        F.lit(seq).cast("bigint").alias("seq"), F.floor(n * share).cast("bigint").alias("at"), F.lit(removed).cast("bigint").alias("removed"), F.lit(added).alias("added"))
    edits = F.array(edit(0, 0.25, 5, ""), edit(1, 0.5, 0, " newly written "), edit(2, 0.75, 7, "\n\n  It's 42! "))
    return tokens.regrown(trees.withColumn("edits", edits), vocabulary, trees=False)


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations read as mail threads, in which each turn quotes the two before it."""
    found = quotes.conversations(quotes.as_mail(table(spark, sf_dir, "conversations")))
    return found.select(F.col("thread").alias("conv_id"), F.col("seq").alias("turn"), "tie", "position", "parent", "parent_tie", "root", "root_tie", "depth", "links", "n_quoted", "n_linked", "role", "text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = linear.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return linear.scored(docs, model, linear.char_ngrams, 0, 5)


#: Shares of expected tokens by language.
LANGUAGE_WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = mixing.sample_labelled(docs, table(spark, sf_dir, "labels"), "lang")
    rates, _ = mixing.mix(docs, labelled, LANGUAGE_WEIGHTS)
    posteriors = [F.round(f"q_{k}", 6).alias(f"p_{d}") for k, d in enumerate(sorted(LANGUAGE_WEIGHTS))]
    return rates.select("doc_id", "copies", "n_tokens", *posteriors, F.round("rate", 6).alias("rate"), F.round("missed", 6).alias("missed"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.split_items(table(spark, sf_dir, "benchmark"))
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), items, whole=decontaminate.WHOLE)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = linear.quality_model(docs, table(spark, sf_dir, "labels"))
    return linear.scored(docs, model, linear.word_ngrams, 1, 3)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.read_media(media.with_media(table(spark, sf_dir, "documents"))))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quotes": op2_quotes,
        "op3_simhash": op3_simhash,
        "op4_toxicity": op4_toxicity,
        "op5_mixing": op5_mixing,
        "op6_decontaminate": op6_decontaminate,
        "op7_sharding": op7_sharding,
        "op8_quality": op8_quality,
        "op9_repeats": op9_repeats,
        "op10_media": op10_media,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_resampling": op12_resampling,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quotes": oracles.OP2_QUOTES, "op9_repeats": oracles.OP9_REPEATS, "op11_prefix_trie": oracles.OP11_PREFIX_TRIE, "op12_resampling": oracles.OP12_RESAMPLING, "op13_minhash": oracles.OP13_MINHASH}
