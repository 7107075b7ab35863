"""Postings of a page from whatever was captured of it: the cheapest source that tells any counts.

The markup as it came is read first; where it holds no postings, or wasn't read, what the page's own scripts fetched
(all responses together, since an endless list arrives in pieces); where that holds none, the markup as it was
rendered. A later source is parsed only for pages that are still open. A page that failed stays apart from one that
is empty: its error stands in the status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.fixed import NEEDS_A_BROWSER
from gleaner.functions.lineage import cut
from gleaner.operators import markup
from gleaner.operators.links import captured_json

MARKUP, RESPONSES, RENDERED = "markup", "responses", "rendered"
_KEPT = ["page_id", "rank", "pos", "company_name", "job_title", "job_url", "location", "country", "career_page_url", "platform"]


def rescuable(error: Column) -> Column:
    """Whether another source may tell what a failed page doesn't: not where the URL itself was refused, unless the error asks for a browser."""
    return error.isNull() | ~error.startswith("AdapterUrlError") | error.rlike(NEEDS_A_BROWSER)


def _read(pages: DataFrame, source: str, pattern: Column | None, layouts: dict[str, dict] | None) -> DataFrame:
    nodes = markup.parsed(pages, layouts)
    return cut(markup.first_way(markup.ways(nodes, pattern, layout=bool(layouts))).select(*_KEPT, F.lit(source).alias("source")))


def page_postings(pages: DataFrame, responses: DataFrame, rendered: DataFrame, pattern: Column | None = None, layouts: dict[str, dict] | None = None, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """Postings (page_id, source, rank, pos, posting fields), without derived countries, and status (page_id, url, source, jobs, error).

    pages(page_id, url, html, error, company_name, platform, career_page_url), where page_id tells rows apart and error is
    null for a page that was read; responses(page_url, pos, url, content_type, body), the first `most` of a page;
    rendered(url, html). A page has its error only where no source has postings; source is null where none has.
    """
    pages = cut(pages)
    plain = _read(pages.where("error is null"), MARKUP, pattern, layouts)
    still = pages.join(plain.select("page_id").distinct(), "page_id", "left_anti").where(rescuable(F.col("error")))
    named = captured_json(responses.join(still.select(F.col("url").alias("page_url")).distinct(), "page_url", "left_semi"), most)
    bodies = still.drop("html", "error").join(named.select(F.col("page_url").alias("url"), "pos", "body"), "url").withColumn("page_key", F.col("page_id"))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    bodies = bodies.select("page_key", F.col("page_id").cast("bigint").alias("page_id"), *[empty(c) for c in markup.PAGE[2:]], F.col("pos").cast("int").alias("pos"), "body")
    fetched = cut(markup.first_way(markup.from_payloads(markup.spread(bodies)).drop("payload")).select(*_KEPT, F.lit(RESPONSES).alias("source")))
    open_pages = still.join(fetched.select("page_id").distinct(), "page_id", "left_anti").drop("html")
    drawn = _read(open_pages.join(rendered.select("url", "html"), "url"), RENDERED, pattern, layouts)
    postings = plain.unionByName(fetched).unionByName(drawn)
    counts = postings.groupBy("page_id").agg(F.count("*").alias("jobs"), F.first("source").alias("source"))
    status = pages.join(counts, "page_id", "left").select("page_id", "url", "source", F.coalesce("jobs", F.lit(0)).cast("bigint").alias("jobs"), F.when(F.col("jobs").isNull(), F.col("error")).alias("error"))
    return postings, status
