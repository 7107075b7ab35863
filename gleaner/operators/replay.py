"""A whole run over captured tables: from companies to their postings and results, without fetching anything.

Each company's seeds are routed by platform to their readers: a vendor's interface to its payloads, any other board to
a walk over its pages. Errors travel beside postings, so a board that couldn't be read stays apart from an empty one.
The first seed with postings counts, else the first one's outcome; a company that a marketing page led nowhere is
tried once more at the board that its site links to.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.fixed import GENERIC, UNKNOWN
from gleaner.functions.lineage import cut
from gleaner.functions.platforms import with_platform
from gleaner.operators import links, paging, sourcing
from gleaner.operators.jobs import FIELDS, dedupe, with_countries
from gleaner.operators.registry import BUILT_IN, Registry
from gleaner.operators.seeds import seed_candidates

#: Seeds of a company that are tried, and pages of a board that are read.
SEEDS, PAGES = 2, 25
NO_URL = "no usable URL in the input sheet"


class Captures(NamedTuple):
    """pages(url, html), rendered(url, html), responses(page_url, pos, url, content_type, body),
    payloads(board_url, page_no, body, error): what was captured; error tells that a request failed."""

    pages: DataFrame
    rendered: DataFrame
    responses: DataFrame
    payloads: DataFrame


def _missing(url: str = "url"):
    return F.concat(F.lit("AdapterHttpError: nothing captured of "), F.col(url))


def _by_interface(tries: DataFrame, captures: Captures, label: str, registry: Registry) -> tuple[DataFrame, DataFrame]:
    """Postings (id, place, posting fields) and errors (id, error) of tries(id, company_name, url) at one vendor's interface."""
    asked = tries.select("id", "company_name", F.col("url").alias("board_url"))
    bodies = cut(asked.join(captures.payloads, "board_url"))
    postings = registry.api_postings(bodies.where("error is null"), label, ["id"])
    place = F.col("page_no").cast("bigint") * F.lit(1 << 32) + F.col("seq")
    failed = bodies.where("error is not null").select("id", F.col("page_no").alias("at"), "error")
    unread = registry.api_errors(bodies.where("error is null"), label, ["id"]).select("id", F.col("page_no").alias("at"), "error")
    absent = asked.join(bodies.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).alias("at"), _missing("board_url").alias("error"))
    errors = failed.unionByName(unread).unionByName(absent).groupBy("id").agg(F.min_by("error", "at").alias("error"))
    return postings.select("id", place.alias("place"), *FIELDS), errors


def _by_pages(tries: DataFrame, captures: Captures, registry: Registry) -> tuple[DataFrame, DataFrame]:
    """The same by a walk over a board's pages. A board's first page may be told by its other sources alone."""
    starts = tries.withColumn("template", registry.page_template(F.col("platform"))).withColumn("board", F.col("id"))
    steps, ends = paging.walk(starts, captures.pages, PAGES)
    told = starts.select("board", "company_name", "platform", F.col("url").alias("career_page_url"))
    pages = steps.join(told, "board").join(captures.pages.groupBy("url").agg(F.first("html").alias("html")), "url").withColumn("error", F.lit(None).cast("string"))
    lost = starts.join(steps.select("board").distinct(), "board", "left_anti")
    columns = ["board", "step", "url", "html", "error", "company_name", "platform", "career_page_url"]
    lost = lost.select("board", F.lit(1).cast("bigint").alias("step"), "url", F.lit(None).cast("string").alias("html"), _missing().alias("error"), "company_name", "platform", F.col("url").alias("career_page_url"))
    every = pages.select(*columns).unionByName(lost).withColumn("page_id", F.col("board") * (PAGES + 1) + F.col("step"))
    found, status = sourcing.page_postings(every, captures.responses, captures.rendered, registry.pattern(F.col("platform")), registry.layouts())
    board = F.floor((F.col("page_id") - 1) / (PAGES + 1)).cast("bigint")
    found = found.withColumn("board", board).withColumn("step", F.col("page_id") - board * (PAGES + 1))
    read, _ = paging.read_until_dry(found.select("board", "step", F.lower("job_url").alias("key")), steps, ends)
    kept = found.withColumn("key", F.lower("job_url")).join(read, ["board", "key", "step"], "left_semi")
    also = found.join(lost.select("board"), "board", "left_semi")  # told by other sources alone
    place = F.col("step") * F.lit(1 << 48) + F.col("rank") * F.lit(1 << 44) + F.col("pos")
    postings = kept.select("board", place.alias("place"), *FIELDS).unionByName(also.select("board", place.alias("place"), *FIELDS)).distinct().withColumnRenamed("board", "id")
    errors = status.where("error is not null").select(board.alias("id"), "error", "page_id").groupBy("id").agg(F.min_by("error", "page_id").alias("error"))
    return postings, errors


def read_boards(tries: DataFrame, captures: Captures, registry: Registry = BUILT_IN) -> tuple[DataFrame, DataFrame]:
    """Postings (id, place, posting fields) and outcomes (id, jobs, error) of tries(id, company_name, url, platform); id tells tries apart.

    A platform without an adapter is an error; any unreadable answer of an interface is its board's, so a list is whole or
    an error. Only the readers of platforms that are there are planned.
    """
    tries = cut(tries)
    labels = [r["platform"] for r in tries.select("platform").distinct().collect()]  # a row for each platform
    parts = []
    for label in sorted(set(labels) & set(registry.api)):
        parts.append(_by_interface(tries.where(F.col("platform") == label), captures, label, registry))
    paged = [x for x in labels if x not in registry.api and registry.has(x)]
    if paged:
        parts.append(_by_pages(tries.where(F.col("platform").isin(paged)), captures, registry))
    none = [x for x in labels if not registry.has(x)]
    refused = tries.where(F.col("platform").isin(none)).select("id", F.concat(F.lit("no adapter for "), F.col("platform")).alias("error")) if none else None
    errors = [e.select("id", "error") for _, e in parts] + ([refused] if none else [])
    empty = tries.limit(0)
    wrong = cut(reduce(DataFrame.unionByName, errors)) if errors else empty.select("id", F.lit("").alias("error"))
    kinds = {"place": "bigint"}
    rows = reduce(DataFrame.unionByName, [p for p, _ in parts]) if parts else empty.select("id", *[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in ("place", *FIELDS)])
    # an interface that failed once has no list; a page's error stands only where no page has postings
    rows = dedupe(cut(rows.join(wrong, "id", "left_anti")), ["place"], ["id"])
    counts = rows.groupBy("id").agg(F.count("*").alias("jobs"))
    told = tries.select("id").join(counts, "id", "left").join(wrong, "id", "left")
    return rows, told.select("id", F.coalesce("jobs", F.lit(0)).cast("bigint").alias("jobs"), F.when(F.col("jobs").isNull(), F.col("error")).alias("error"))


def replayed(companies: DataFrame, captures: Captures, registry: Registry = BUILT_IN) -> tuple[DataFrame, DataFrame]:
    """Results (row_id, company, platform, seed_url, seed_field, jobs, error, seconds, discovered), a row for each company, and
    their postings (row_id, place, posting fields).

    companies(row_id, company, it_link, career_url, website), row_id telling them apart. Nothing is timed, so seconds are zero.
    """
    companies = cut(companies)
    sheet = cut(seed_candidates(companies, registry.rules()).where(F.col("place") <= SEEDS))
    attempts = sheet.select("row_id", "company", F.col("place").alias("attempt"), F.col("seed_url").alias("url"), "seed_field", "platform", F.lit(False).alias("discovered"))

    def tried(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = cut(rows.withColumn("id", F.col("row_id") * (SEEDS + 2) + F.col("attempt")))
        jobs, told = read_boards(rows.select("id", F.col("company").alias("company_name"), "url", "platform"), captures, registry)
        return jobs, cut(rows.join(told, "id"))

    jobs, told = tried(attempts)
    # no postings so far, and a tried seed was no vendor's board or there was none: one hop from the company's site
    seen = told.groupBy("row_id").agg(F.max("jobs").alias("jobs"), F.max((F.col("platform") == GENERIC).cast("int")).alias("generic"), F.min_by("url", "attempt").alias("first"))
    still = companies.select("row_id", "company", "website").join(seen, "row_id", "left").where("jobs is null or (jobs = 0 and generic = 1)")
    numbered = captures.pages.select(F.xxhash64("url").alias("page_id"), "url", "html").dropDuplicates(["url"])
    hop = links.discovered(still.select(F.col("row_id").alias("company"), F.col("website").alias("url")), numbered)
    found = hop.select(F.col("company").alias("row_id"), "url").join(still.select("row_id", "company", "first"), "row_id").where("first is null or url <> first")
    more = with_platform(found, "url", rules=registry.rules()).select("row_id", "company", F.lit(SEEDS + 1).cast("bigint").alias("attempt"), "url", F.lit("discovered").alias("seed_field"), "platform", F.lit(True).alias("discovered"))
    more = cut(more)
    if not more.isEmpty():
        jobs_too, told_too = tried(more)
        jobs, told = jobs.unionByName(jobs_too), told.unionByName(told_too)
    # the first with postings, else the first
    best = told.groupBy("row_id").agg(F.min_by(F.struct("id", "url", "seed_field", "platform", "jobs", "error", "discovered"), F.struct((F.col("jobs") == 0).alias("empty"), "attempt")).alias("x")).select("row_id", "x.*")
    none = F.col("id").isNull()
    results = companies.select("row_id", "company").join(best, "row_id", "left").select(
        "row_id", "company", F.coalesce("platform", F.lit(UNKNOWN)).alias("platform"), F.coalesce("url", F.lit("")).alias("seed_url"), F.coalesce("seed_field", F.lit("")).alias("seed_field"),
        F.coalesce("jobs", F.lit(0)).cast("bigint").alias("jobs"), F.when(none, NO_URL).otherwise(F.col("error")).alias("error"), F.lit(0.0).alias("seconds"), F.coalesce("discovered", F.lit(False)).alias("discovered"))
    postings = jobs.join(best.where("jobs > 0").select("id", "row_id"), "id").select("row_id", "place", *FIELDS)
    return cut(results), with_countries(postings)
