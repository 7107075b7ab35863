"""Links of captured pages, read from markup with regular expressions, and what they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import texts, urls
from gleaner.functions.binding import held
from gleaner.functions.fixed import BUNDLE_SUFFIXES, CAREER_PATHS, NEXT_LABELS, UNKNOWN
from gleaner.functions.lineage import cut
from gleaner.functions.platforms import with_platform

_ANCHOR = r"(?is)<a\s[^>]*>.*?</a>"
_HREF = r"(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"


def _unescaped(text):
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def page_links(pages: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(page_id, pos, href, url, text, base, marked) of the anchors of pages(page_id, url, html), in document order.

    Anchors without href are left out; comments and scripts aren't searched. url is empty where a link leads
    nowhere; base is the page's own; marked tells links that the page itself declares as its next page. Of anchors
    that `wanted`, a condition on text and marked, doesn't take no URL is resolved, and they are left out.
    """
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all(bare, F.lit(_ANCHOR), F.lit(0))).alias("pos", "tag"))
    href = F.coalesce(*[F.nullif(F.regexp_extract("tag", _HREF, i), F.lit("")) for i in (1, 2, 3)])
    rows = held(rows, {"href": _unescaped(href)}).where("href is not null")
    inner = F.regexp_replace(F.regexp_replace(F.col("tag"), r"(?is)^<a\s[^>]*>|</a>$", ""), r"<[^>]*>", " ")
    text, target = texts.clean(_unescaped(inner)), urls.absolute(F.col("base"), F.col("href"))
    marked = F.regexp_like("tag", F.lit(r"(?is)^<a\s[^>]*\brel\s*=\s*[\"']?[^\"'>]*\bnext\b"))
    if wanted is None:
        found = held(rows, {"url": target, "text": text}).withColumn("marked", marked)
    else:
        found = held(held(rows, {"text": text, "marked": marked}).where(wanted), {"url": target})
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "url", "text", "base", "marked")


def scored_links(links: DataFrame) -> DataFrame:
    """(page_id, pos, url, score): links with a score above 0 as ways to postings; of one URL the first counts."""
    rows = with_platform(links.where("url <> ''"), "url")
    rows = held(rows, {"score": texts.career_score(F.col("text"), F.col("url"), F.col("platform"), F.col("base"))}).where("score > 0")
    first = rows.groupBy("page_id", "url").agg(F.min("pos").alias("pos"), F.min_by("score", "pos").alias("score"))
    return first.select("page_id", "pos", "url", F.col("score").cast("bigint").alias("score"))


def best_links(scored: DataFrame) -> DataFrame:
    """(page_id, url, score): the best link of each page; of equals the first in the document."""
    rank = F.struct(-F.col("score"), F.col("pos"))
    return scored.groupBy("page_id").agg(F.min_by("url", rank).alias("url"), F.max("score").alias("score"))


def discovered(websites: DataFrame, pages: DataFrame) -> DataFrame:
    """(company, url, how): a careers page for each of websites(company, url), from captured pages(page_id, url, html).

    The best link of the site's page, at once if it is a vendor's board; else a vendor's board that the linked
    page links to; else the linked page; else the first of the usual paths whose page reads like a listing.
    """
    def scored(some: DataFrame) -> DataFrame:
        # only links of pages that are asked for are read
        asked = pages.join(some.where("url is not null").distinct(), "url", "left_semi")
        return scored_links(page_links(asked)).join(asked.select("page_id", F.col("url").alias("at")), "page_id")

    site = websites.select("company", urls.normalised(F.col("url")).alias("root"))
    best = scored(site.select(F.col("root").alias("url"))).groupBy("at").agg(F.min_by(F.struct("url", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("x")).select("at", F.col("x.url").alias("first"), F.col("x.score").alias("points"))
    led = cut(site.join(best, site["root"] == best["at"], "left"))
    boards = scored(led.where("points < 100").select(F.col("first").alias("url"))).where("score >= 100").groupBy(F.col("at").alias("inner_at")).agg(F.min_by("url", "pos").alias("board"))
    hop = led.join(boards, (F.col("first") == F.col("inner_at")) & (F.col("points") < 100), "left")
    origin = F.concat(F.regexp_extract("root", r"^[A-Za-z]+://", 0), urls.host_of(F.col("root")))
    probes = led.select("company", F.posexplode(F.transform(F.array(*map(F.lit, CAREER_PATHS[:8])), lambda p: F.concat(origin, p))).alias("place", "probe"))
    probable = pages.join(probes.select(F.col("probe").alias("url")).distinct(), "url", "left_semi")
    listings = held(probable, {"evidence": texts.listing_evidence(F.col("html"))}).where("evidence >= 2").select(F.col("url").alias("probe")).distinct()
    probed = probes.join(listings, "probe").groupBy("company").agg(F.min_by("probe", "place").alias("probe"))
    out = hop.join(probed, "company", "left").select(
        "company", F.coalesce("board", "first", "probe").alias("url"),
        F.when(F.col("points") >= 100, "board").when(F.col("board").isNotNull(), "hop").when(F.col("first").isNotNull(), "link").otherwise("probe").alias("how"))
    return out.where("url is not null")


def _pager_number() -> Column:
    return F.when(F.col("text").rlike("^[0-9]{1,3}$"), F.col("text").cast("int"))


def pager_links(links: DataFrame) -> DataFrame:
    """(page_id, base, url, place) of the links to a next page on the page's own host, by rank of place.

    Links that are marked as the next page come first, then those that a pager labels so, then numbers from 2
    to 200, the lowest first.
    """
    own = links.where((F.col("url") != "") & (F.col("url") != F.col("base")) & (urls.host_of(F.col("url")) == urls.host_of(F.col("base"))))
    number = _pager_number()
    place = (
        F.when(F.col("marked"), F.col("pos")).when(F.lower("text").isin(NEXT_LABELS), F.lit(1 << 40) + F.col("pos"))
        .when(number.between(2, 200), F.lit(1 << 41) + number)
    )
    return own.select("page_id", "base", "url", place.cast("bigint").alias("place")).where("place is not null")


def page_pagers(pages: DataFrame) -> DataFrame:
    """pager_links of pages(page_id, url, html); of other anchors no URL is resolved."""
    of_pager = F.col("marked") | F.lower("text").isin(NEXT_LABELS) | _pager_number().between(2, 200)
    return pager_links(page_links(pages, of_pager))


def next_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url): the page that each page's pager leads to first; pages without one are left out."""
    return page_pagers(pages).groupBy("page_id").agg(F.min(F.struct("place", "url"))["url"].alias("url"))


def host_rollup(pages: DataFrame) -> DataFrame:
    """(site, pages, hosts): captured pages and hosts by the last two labels of the host."""
    host = urls.host_of(F.col("url"))
    return pages.groupBy(urls.last_labels(F.col("url")).alias("site")).agg(F.count("*").alias("pages"), F.countDistinct(host).alias("hosts"))


def script_bundles(pages: DataFrame, limit: int = 40) -> DataFrame:
    """(page_id, bundles, endpoints): script files and interface paths that a page names, sorted and without repeats."""
    src = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<script\b[^>]*\ssrc\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    full = F.filter(F.transform(src, lambda s: urls.absolute(F.col("url"), s)), lambda u: (u != "") & texts.any_of(F.lower(u), BUNDLE_SUFFIXES))
    return pages.select("page_id", F.slice(F.array_sort(F.array_distinct(full)), 1, limit).alias("bundles"), texts.endpoints(F.col("html"), limit).alias("endpoints"))


def gates(pages: DataFrame) -> DataFrame:
    """(page_id, is_challenge, is_captcha, is_barred) of pages(page_id, html)."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", texts.is_challenge(title, F.col("html")).alias("is_challenge"), texts.is_captcha(F.col("html")).alias("is_captcha"), texts.is_barred(F.col("html")).alias("is_barred"))


def captured_json(responses: DataFrame, most: int = 120, size: int = 8 << 20) -> DataFrame:
    """Responses(page_url, pos, url, content_type, body) with a JSON body of bounded size, the first `most` of each page."""
    kept = responses.where((F.lower(F.coalesce("content_type", F.lit(""))).contains("json") | F.lower("url").endswith(".json")) & (F.length("body") <= size))
    kept = kept.where(F.try_parse_json("body").isNotNull())
    return kept.withColumn("__n", F.row_number().over(W.partitionBy("page_url").orderBy("pos"))).where(F.col("__n") <= most).drop("__n")


def unknown_pages(results: DataFrame, most: int = 60) -> DataFrame:
    """(row_id, company, directory, platform, seed_url, error): the first `most` unread companies without a known vendor."""
    rows = results.where((F.col("jobs") == 0) & F.col("platform").isin("Generic HTML", UNKNOWN) & (F.coalesce("seed_url", F.lit("")) != ""))
    top = rows.orderBy("row_id").limit(most)
    return top.select("row_id", "company", texts.slug(F.col("company")).alias("directory"), "platform", "seed_url", texts.detail(F.col("error")).alias("error"))
