"""Postings: projection, the export view, and first-wins removal of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.binding import held, once
from gleaner.functions.fixed import EXPORT_COLUMNS
from gleaner.functions.places import derive_country
from gleaner.functions.urls import stripped

FIELDS = ["company_name", "job_title", "job_url", "location", "country", "career_page_url", "platform"]

#: Parts that the postings of one location are dealt into where countries are joined to them.
PARTS = 32


def stated_jobs(raw: DataFrame, *keep: str) -> DataFrame:
    """raw(company_name, title, url, location, country, career_page_url, platform) as postings, with `keep` beside them.

    Fields are stripped; rows without a title or URL go; country is what was given, often nothing.
    """
    named = held(raw, {
        "company_name": stripped(F.col("company_name")), "job_title": stripped(F.col("title")), "job_url": stripped(F.col("url")),
        "location": stripped(F.col("location")), "country": stripped(F.col("country")), "career_page_url": stripped(F.col("career_page_url")), "platform": stripped(F.col("platform"))})
    return named.where("job_title <> '' and job_url <> ''").select(*keep, *FIELDS)


def with_countries(jobs: DataFrame) -> DataFrame:
    """jobs with a country derived from the location where none was given.

    Countries are derived for each distinct location, since many postings share one, and joined to the postings.
    Postings of one location are dealt into at most PARTS parts, and those that need no country
    apart from each other, so that no task holds all postings of one location or all without one.
    """
    open_place = F.when((F.col("country") == "") & (F.col("location") != ""), F.col("location"))
    dealt = F.xxhash64("job_url", "company_name", "job_title")
    part = F.when(open_place.isNotNull(), F.pmod(dealt, F.lit(PARTS))).otherwise(dealt)
    places = jobs.select(open_place.alias("__place"), part.alias("__some")).where("__place is not null").distinct()
    told = held(places, {"__told": once("the country of __place", lambda: derive_country(F.col("__place")))})
    joined = jobs.withColumn("__open", open_place).withColumn("__part", part).join(told, (F.col("__open") == F.col("__place")) & (F.col("__part") == F.col("__some")), "left")
    country = F.coalesce("__told", "country").alias("country")
    return joined.select(*[country if c == "country" else F.col(f"`{c}`") for c in jobs.columns])


def build_jobs(raw: DataFrame, *keep: str) -> DataFrame:
    """Postings of raw rows (see stated_jobs) with their countries."""
    return with_countries(stated_jobs(raw, *keep))


def export_view(jobs: DataFrame) -> DataFrame:
    """Postings under the headers of the exported sheet."""
    return jobs.select(*[F.col(c).alias(h) for c, h in EXPORT_COLUMNS.items()])


def first_of_each(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in the order of `order`.

    The least number of each key is an aggregate of numbers alone, which is hashed and reduced before it is
    shuffled, so a key with very many rows is no heavier than others. Rows are then kept by a semi join on key
    and numbers; of the few that are equal in these, the least by its other columns stays.
    """
    rest = [c for c in rows.columns if c not in order]
    named = [k.alias(f"__key{i}") for i, k in enumerate(keys)]
    keyed = [f"__key{i}" for i in range(len(keys))]
    least = rows.select(*named, *order).groupBy(*keyed)
    if len(order) == 1:
        least = least.agg(F.min(order[0]).alias(order[0]))
    else:
        least = least.agg(F.min(F.struct(*order)).alias("__least")).select(*keyed, "__least.*")
    first = rows.select("*", *named).join(least, [*keyed, *order], "left_semi")
    one = first.groupBy(*keyed, *order).agg(F.min(F.struct(*rest)).alias("__first"))
    return one.select(*[F.col(c) if c in order else F.col("__first")[c].alias(c) for c in rows.columns])


def dedupe(jobs: DataFrame, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """The first posting of each company and URL (in any case), within `scope` columns or everywhere."""
    keys = [F.col(c) for c in scope or []] + [F.lower("company_name"), F.lower("job_url")]
    return first_of_each(jobs, keys, order)


def first_stated(raw: DataFrame, order: list[str], scope: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """first_jobs with the countries that were given alone."""
    return dedupe(stated_jobs(raw, *(keep or order)), order, scope)


def first_jobs(raw: DataFrame, order: list[str], scope: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The first posting of each company and URL among raw rows (see stated_jobs), with countries only for what stays."""
    return with_countries(first_stated(raw, order, scope, keep))


def column_widths(jobs: DataFrame) -> DataFrame:
    """(header, width): two more than the longest text of an exported column, between 12 and 70."""
    longest = jobs.agg(*[F.max(F.length(c)).alias(c) for c in EXPORT_COLUMNS])
    pairs = F.array(*[F.struct(F.lit(h).alias("header"), F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(h))).alias("n")) for c, h in EXPORT_COLUMNS.items()])
    width = F.least(F.greatest(F.col("x.n") + 2, F.lit(12)), F.lit(70))
    return longest.select(F.explode(pairs).alias("x")).select(F.col("x.header").alias("header"), width.cast("bigint").alias("width"))
