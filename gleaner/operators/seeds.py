"""Which URL of a company is read first, and which attempt counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.fixed import GENERIC, RULES, SEED_FIELDS, UNKNOWN
from gleaner.functions.platforms import with_platform
from gleaner.functions.urls import stripped


def seed_candidates(companies: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(row_id, company, place, seed_url, seed_field, platform): a company's usable URLs, the best first.

    URLs equal up to case and closing slashes count once, in the place of the first. A company has at most
    as many rows as there are seed fields, so its rows meet in a small window.
    """
    listed = companies.select("row_id", "company", F.posexplode(F.array(*[F.struct(F.lit(f).alias("seed_field"), stripped(F.col(f)).alias("seed_url")) for f in SEED_FIELDS])))
    rows = listed.select("row_id", "company", "pos", "col.seed_field", "col.seed_url").where("seed_url <> ''")
    usable = with_platform(rows, "seed_url", rules=rules).where(F.col("platform") != UNKNOWN)
    same = W.partitionBy("row_id", F.lower(F.regexp_replace("seed_url", "/+$", ""))).orderBy("pos")
    first = usable.withColumn("again", F.row_number().over(same)).where("again = 1")
    place = F.row_number().over(W.partitionBy("row_id").orderBy("pos")).cast("bigint")
    return first.select("row_id", "company", place.alias("place"), "seed_url", "seed_field", "platform")


def selected_seeds(companies: DataFrame) -> DataFrame:
    """(row_id, company, seed_url, seed_field, platform) of every company: its first candidate, or nothing and Unknown."""
    first = seed_candidates(companies).where("place = 1").drop("company", "place")
    empty = F.lit("")
    return companies.select("row_id", "company").join(first, "row_id", "left").select(
        "row_id", "company", F.coalesce("seed_url", empty).alias("seed_url"), F.coalesce("seed_field", empty).alias("seed_field"),
        F.coalesce("platform", F.lit(UNKNOWN)).alias("platform"))


def resolved_attempts(attempts: DataFrame, most: int = 2) -> DataFrame:
    """attempts(company, attempt, seed_field, platform, jobs, error, discovered) -> the attempt that counts.

    The first `most` attempts at sheet URLs are tried in order, and one found by discovery after them where
    one of those was a generic page, or where the sheet gave none. The first with postings counts, else the first.
    """
    sheet = attempts.where(~F.col("discovered") & (F.col("attempt") <= most))
    told = sheet.groupBy("company").agg(F.max((F.col("platform") == GENERIC).cast("int")).alias("generic"))
    extra = attempts.where("discovered").join(told, "company", "left").where("generic is null or generic = 1").drop("generic")
    tried = sheet.unionByName(extra)
    rank = F.struct((F.col("jobs") == 0).cast("int").alias("empty"), F.col("discovered").cast("int").alias("late"), F.col("attempt"))
    rest = F.struct("seed_field", "platform", "jobs", "error", "discovered", "attempt")
    best = tried.groupBy("company").agg(F.min_by(rest, rank).alias("x"))
    return best.select("company", "x.attempt", "x.seed_field", "x.platform", "x.jobs", "x.error", "x.discovered")
