"""Expressions on visible text, markup and messages."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.functions.binding import bound
from gleaner.functions.fixed import (
    CAPTCHA_MARKUP,
    CAREER_PATH_PATTERN,
    CAREER_WORDS,
    CHALLENGE_MARKUP,
    CHALLENGE_TITLES,
    ENDPOINT,
    GENERIC,
    JOB_URL_HINTS,
    LISTING_EVIDENCE,
    NAVIGATION_PATTERN,
    NAVIGATION_TEXT,
    NEGATIVE_WORDS,
    NO_JOBS_DETAIL,
    NON_TITLES,
    UNKNOWN,
    WAF_MARKERS,
)


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def clean(text: Column) -> Column:
    """One line: hard blanks and runs of blanks are one blank; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{A0}]+", " "))


def looks_like_job_url(url: Column) -> Column:
    return any_of(F.lower(url), JOB_URL_HINTS)


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"^[ .:*>|-]+|[ .:*>|-]+$", "")


def looks_like_title(text: Column) -> Column:
    """Whether link text can be a posting's title: 3 to 160 characters with a letter, and no furniture."""
    return F.length(text).between(3, 160) & ~_bare(text).isin(NAVIGATION_TEXT) & ~text.rlike(NAVIGATION_PATTERN) & text.rlike(r"\p{L}")


def plausible_title(text: Column) -> Column:
    """Whether a field of a payload can be a title; whole sentences can't."""
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return F.length(text).between(3, 180) & ~_bare(text).isin(NON_TITLES) & text.rlike(r"\p{L}") & (dots <= 3) & ~text.contains("\n")


def is_challenge(title: Column, html: Column) -> Column:
    """Whether a page only checks its visitor: by its title, or by marks in its first 4000 characters."""
    head = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 4000))
    return any_of(F.lower(F.coalesce(title, F.lit(""))), CHALLENGE_TITLES) | any_of(head, CHALLENGE_MARKUP)


def is_captcha(html: Column) -> Column:
    return any_of(F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 6000)), CAPTCHA_MARKUP)


def is_barred(html: Column) -> Column:
    return any_of(F.coalesce(html, F.lit("")), WAF_MARKERS)


def listing_evidence(markup: Column) -> Column:
    """How often the words of a listing stand in the markup; two make a listing."""
    return F.regexp_count(F.coalesce(markup, F.lit("")), F.lit(LISTING_EVIDENCE))


def career_score(text: Column, url: Column, platform: Column, base: Column) -> Column:
    """How likely a link leads to a company's postings; 100 for a vendor's board, 0 or less for no."""
    label, low = F.lower(clean(text)), F.lower(url)
    slugs = [f"/{w.replace(' ', '-')}" for w in CAREER_WORDS]
    points = (
        F.when(label.isin(CAREER_WORDS), 12).when(any_of(label, CAREER_WORDS), 7).otherwise(0)
        + F.when(any_of(low, slugs), 6).otherwise(0)
        + F.when(low.rlike(CAREER_PATH_PATTERN), 8).otherwise(0)
        - F.when(urls.same_site(base, url), 0).otherwise(5)
    )
    return F.when((F.coalesce(url, F.lit("")) == "") | any_of(label, NEGATIVE_WORDS), 0).when(~platform.isin(GENERIC, UNKNOWN), 100).otherwise(points)


def endpoints(markup: Column, limit: int = 40) -> Column:
    """The first `limit` paths in quotes that look like a programming interface, in order and without repeats."""
    found = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(ENDPOINT), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x).between(4, 200)))), 1, limit)


def outcome(jobs: Column, error: Column, platform: Column) -> Column:
    """What became of a company; postings win over any error, and a missing adapter over an unknown platform."""
    return (
        F.when(jobs > 0, "jobs").when(error.isNull(), "no open jobs").when(error.contains("no adapter for"), "unsupported platform")
        .when(platform == UNKNOWN, "unknown platform").otherwise("technical failure")
    )


def reason_family(error: Column) -> Column:
    """An error message without what is particular to one company."""
    kind = F.substring_index(error, ": ", 1)
    rest = F.when(error.contains(": "), F.substring(error, F.length(kind) + 3, F.length(error))).otherwise("")
    head = F.regexp_replace(rest, r"https?://\S+", "<url>")
    head = F.trim(F.substring_index(F.substring_index(head, ": '", 1), " (", 1))
    tagged = lambda x: F.concat(kind, F.lit(f": {x}"))
    return (
        F.when(error.contains("no adapter for"), error)
        .when(error.contains("bot challenge") | error.contains("Human Verification"), tagged("anti-bot interstitial"))
        .when(error.contains("client-side") | error.contains("browser-driven"), tagged("needs a browser"))
        .when(error.contains("legacy"), tagged("legacy portal, no public endpoint"))
        .when(head == "", kind)
        .otherwise(F.concat(kind, F.lit(": "), F.substring(head, 1, 80)))
    )


def elapsed(seconds: Column) -> Column:
    """1h 04m 09s, 4m 09s or 9s."""
    s = F.floor(seconds)
    hours, minutes, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(hours > 0, F.format_string("%dh %02dm %02ds", hours, minutes, rest))
        .when(minutes > 0, F.format_string("%dm %02ds", minutes, rest)).otherwise(F.format_string("%ds", rest))
    )


def tenths(number: Column) -> Column:
    """A double with one decimal, rounded by its exact binary value and ties to the even digit, as C and Python print it.

    Spark's own formatting rounds the shortest decimal and ties up: 0.15 is below its tie and 0.25 is one, so they are
    0.1 and 0.2 here. From 2^52 on numbers are whole.
    """
    fixed = lambda x: F.when(x < 2.0**52, bound(F.floor(x), lambda whole: _tenths(whole, x - whole))).otherwise(F.format_string("%.1f", x))
    sign = F.when(number.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.format_string("%.1f", number)).otherwise(F.concat(sign, bound(F.abs(number), fixed)))


def _tenths(whole: Column, part: Column) -> Column:
    # ten times the part in two pieces, each of which is exact
    coarse = F.floor(part * 2.0**26) / F.lit(2.0**26)
    high, low = coarse * 10, (part - coarse) * 10
    digit = F.floor(high)
    over, under = low, F.lit(0.5) - (high - digit)
    up = (over > under) | ((over == under) & (digit % 2 == 1))
    return bound(whole * 10 + digit + up.cast("bigint"), lambda n: F.format_string("%d.%d", F.floor(n / 10), n % 10))


def slug(text: Column) -> Column:
    """A name for a folder."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(bare == "", "unnamed").otherwise(bare), 1, 80)


def detail(error: Column) -> Column:
    return F.coalesce(error, F.lit(NO_JOBS_DETAIL))
