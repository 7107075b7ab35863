"""Named queries over whole captures: walks that read, ranked sources, token chains, versions, and a run from companies to results.

As in `readers`, cases are laid out for every supplier and the rows that they hold are written out by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.lineage import shared_path
from gleaner.operators import markup, paging, replay, reports, sourcing, vendors
from gleaner.plans import derived as d
from gleaner.plans.derived import derived, sql, supplier_keys
from gleaner.plans.oracles import text
from gleaner.sources import datasources

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name], _SQL[name] = f, oracle
        return f

    return add


def _filled(value: str | None) -> Column:
    return F.lit(None).cast("string") if value is None else F.replace(F.lit(value), F.lit("{k}"), F.col("k"))


def _laid(s: SparkSession, sf: str, rows: list[tuple], names: list[str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """The rows, with {k} in their texts for each supplier's key, and numbers as they stand; `key` is added."""
    one = lambda r: F.struct(*[(F.lit(v).cast("bigint") if n in numbers else _filled(v)).alias(n) for n, v in zip(names, r, strict=True)])
    return supplier_keys(s, sf).select("key", F.explode(F.array(*map(one, rows))).alias("x")).select("key", "x.*")


def _put(value: object) -> str:
    if isinstance(value, str):
        return f"replace({text(value)}, '{{k}}', CAST(s_suppkey AS VARCHAR))" if "{k}" in value else text(value)
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else f"CAST({value} AS BIGINT)"


def _wanted(rows: list[tuple], names: list[str]) -> str:
    return " UNION ALL ".join("SELECT s_suppkey AS key, " + ", ".join(f"{_put(v)} AS {n}" for n, v in zip(names, r, strict=True)) + " FROM supplier" for r in rows)


_A, _B = "https://acme.example.com", "https://b{k}.example.com"


def _cards(*jobs: tuple[str, str], more: str = "") -> str:
    return "<ul>" + "".join(f'<li><a href="{href}">{title}</a></li>' for href, title in jobs) + f"</ul>{more}"


def _next(href: str) -> str:
    return f'<a rel="next" href="{href}">onwards</a>'


# ---- S1, S2, N4, X1, X2: a sheet whose columns go by other names ----


@_query("csv_alias_scan", f"SELECT company, coalesce(trim(website), '') AS website, coalesce(trim(career_url), '') AS career_url, coalesce(trim(it_link), '') AS it_link FROM {sql(d.COMPANIES)}")
def csv_alias_scan(s: SparkSession, sf: str) -> DataFrame:
    """Every company, written as a sheet with headers of other names in another order, and read back."""
    datasources.register(s)
    rows = derived(s, sf, d.COMPANIES).select(F.col("website").alias(" Web-Site "), F.lit("x").alias("Remarks"), F.col("it_link").alias("IT Link"), F.col("career_url").alias("CAREERS URL"), F.col("company").alias("Company_Name"))
    at = shared_path(s, "sheet")
    rows.write.csv(at, header=True, quote='"', escape='"')
    return s.read.format("company_sheet").schema("company string, website string, career_url string, it_link string").load(at)


# ---- P2, C10, U1, A17: a walk over a board's pages that reads them ----

#: (URL, markup)
WALKED = [
    ("{b}/w1", _cards(("/job/1", "Welder {k}"), ("/job/2", "Joiner {k}"), ("/job/3", "Tiler {k}"), more=_next("/w1?p=2"))),
    ("{b}/w1?p=2", _cards(("/job/3", "Tiler {k}"), ("/job/4", "Mason {k}"), ("/job/5", "Baker {k}"), more=_next("/w1?p=3"))),
    ("{b}/w1?p=3", _cards(("/job/1", "Welder {k}"), ("/JOB/4", "Mason {k}"), ("/job/5", "Baker {k}"), more=_next("/w1?p=4"))),
    ("{b}/w1?p=4", _cards(("/job/6", "Never read {k}"))),
    ("{b}/w2", _cards(("/job/7", "Clerk {k}"), more=_next("/w2b"))),
    ("{b}/w2b", _cards(("/job/8", "Tutor {k}"), more=_next("/w2"))),
    ("{b}/w3", _cards(("/job/9", "Nurse {k}"), more=_next("/w3gone"))),
    ("{b}/w4", "<p>No openings</p>" + _next("/w4b")),
    ("{b}/w4b", _cards(("/job/10", "Never read {k}"))),
    ("{b}/w5", _cards(("/job/11", "Cook {k}"))),
    ("{b}/w6", _cards(("/job/12", "Pilot {k}"))),
    ("{b}/w6?page=2", _cards(("/job/13", "Driver {k}"))),
    ("{b}/w6?page=3", _cards(("/job/13", "Driver {k}"))),
    ("{b}/w6?page=4", _cards(("/job/14", "Never read {k}"))),
    ("{b}/w7/1", _cards(("/job/21", "Guard one {k}"), more=_next("/w7/2"))),
    ("{b}/w7/2", _cards(("/job/22", "Guard two {k}"), more=_next("/w7/3"))),
    ("{b}/w7/3", _cards(("/job/23", "Guard three {k}"), more=_next("/w7/4"))),
    ("{b}/w7/4", _cards(("/job/24", "Guard four {k}"), more=_next("/w7/5"))),
    ("{b}/w7/5", _cards(("/job/25", "Never read {k}"))),
]
WALKED = [(u.replace("{b}", _B), m) for u, m in WALKED]
#: (number, first page, how its pages follow)
WALKS = [(1, _B + "/w1", None), (2, _B + "/w2", None), (3, _B + "/w3", None), (4, _B + "/w4", None), (5, _B + "/w5", None), (6, _B + "/w6", "?page={i}"), (7, _B + "/w7/1", None)]
_WALKED = [
    (1, 1, "Welder {k}", "/job/1"), (1, 1, "Joiner {k}", "/job/2"), (1, 1, "Tiler {k}", "/job/3"), (1, 2, "Mason {k}", "/job/4"), (1, 2, "Baker {k}", "/job/5"), (2, 1, "Clerk {k}", "/job/7"), (2, 2, "Tutor {k}", "/job/8"),
    (3, 1, "Nurse {k}", "/job/9"), (5, 1, "Cook {k}", "/job/11"), (6, 1, "Pilot {k}", "/job/12"), (6, 2, "Driver {k}", "/job/13"),
    (7, 1, "Guard one {k}", "/job/21"), (7, 2, "Guard two {k}", "/job/22"), (7, 3, "Guard three {k}", "/job/23"), (7, 4, "Guard four {k}", "/job/24"),
]
_ENDS = [(1, 3, 5, "nothing new"), (2, 2, 2, "back to a page"), (3, 1, 1, "page missing"), (4, 1, 0, "nothing new"), (5, 1, 1, "no next page"), (6, 3, 2, "nothing new"), (7, 4, 4, "page limit")]


def _walked(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages = _laid(s, sf, WALKED, ["url", "html"]).drop("key")
    starts = _laid(s, sf, WALKS, ["number", "url", "template"], ("number",)).withColumn("board", F.col("key") * 10 + F.col("number"))
    steps, ends = paging.walk(starts, pages, most=4)
    read = steps.join(pages, "url").join(starts.select("board", F.col("url").alias("career_page_url")), "board")
    rows = read.select((F.col("board") * 10 + F.col("step")).alias("page_id"), "url", "html", F.lit("Acme").alias("company_name"), F.lit("Generic HTML").alias("platform"), "career_page_url")
    found = markup.extract_jobs(rows).withColumn("board", F.floor(F.col("page_id") / 10)).withColumn("step", F.col("page_id") % 10)
    keyed = found.withColumn("posting", F.lower("job_url"))
    first, told = paging.read_until_dry(keyed.select("board", "step", F.col("posting").alias("key")), steps, ends)
    return keyed.join(first.withColumnRenamed("key", "posting"), ["board", "posting", "step"], "left_semi"), told


_NUMBER = ["floor(board / 10) AS key", "board % 10 AS number"]


@_query("board_walk_postings", _wanted([(n, step, title, _B + url) for n, step, title, url in _WALKED], ["number", "step", "job_title", "job_url"]))
def board_walk_postings(s: SparkSession, sf: str) -> DataFrame:
    """Postings of whole boards, each where it is first read."""
    return _walked(s, sf)[0].selectExpr(*_NUMBER, "step", "job_title", "job_url")


@_query("board_walk_ends", _wanted(_ENDS, ["number", "pages", "keys", "reason"]))
def board_walk_ends(s: SparkSession, sf: str) -> DataFrame:
    """How many pages each walk has read, and why it ended."""
    return _walked(s, sf)[1].selectExpr(*_NUMBER, "pages", "keys", "reason")


# ---- C4, C8, U2, F15: sources of one page ----

_BODY = '{"jobs": [{"title": "%s", "url": "%s", "location": "Paris, France", "employmentType": "full"}]}'
#: (number, markup, error, rendered markup, bodies of responses)
SOURCES = [
    (1, _cards(("/job/1", "Plain {k}")), None, _cards(("/job/9", "Not needed")), [_BODY % ("Not needed", "/job/8")]),
    (2, "<div id=app></div>", None, _cards(("/job/9", "Not needed")), [_BODY % ("First list {k}", "/job/2"), "no json", '{"other": [1]}', _BODY % ("Second list {k}", "/job/3"), _BODY % ("First list {k}", "/JOB/2")]),
    (3, "<div id=app></div>", None, _cards(("/job/4", "Drawn {k}")), ['{"news": [{"title": "About us", "url": "/about"}]}']),
    (4, None, "AdapterHttpError: HTTP 500", _cards(("/job/5", "Saved {k}")), []),
    (5, None, "AdapterUrlError: not a board", _cards(("/job/9", "Not asked for")), [_BODY % ("Not asked for", "/job/8")]),
    (6, None, "AdapterUrlError: this portal is rendered client-side", None, [_BODY % ("Fetched {k}", "/job/6")]),
    (7, "<p>No openings today</p>", None, "<p>No openings today</p>", ["[]"]),
    (8, None, "AdapterHttpError: HTTP 404", None, []),
]
_SOURCED = [(1, "markup", "Plain {k}", "/job/1", ""), (2, "responses", "First list {k}", "/job/2", "Paris, France"), (2, "responses", "Second list {k}", "/job/3", "Paris, France"), (3, "rendered", "Drawn {k}", "/job/4", ""),
            (4, "rendered", "Saved {k}", "/job/5", ""), (6, "responses", "Fetched {k}", "/job/6", "Paris, France")]
_STATUS = [(1, "markup", 1, None), (2, "responses", 2, None), (3, "rendered", 1, None), (4, "rendered", 1, None), (5, None, 0, "AdapterUrlError: not a board"), (6, "responses", 1, None), (7, None, 0, None), (8, None, 0, "AdapterHttpError: HTTP 404")]


def _sourced(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    at = lambda n: f"{_B}/s{n}"
    pages = _laid(s, sf, [(n, at(n), html, error) for n, html, error, _, _ in SOURCES], ["number", "url", "html", "error"], ("number",))
    pages = pages.select((F.col("key") * 10 + F.col("number")).alias("page_id"), "url", "html", "error", F.lit("Acme").alias("company_name"), F.lit("Generic HTML").alias("platform"), F.col("url").alias("career_page_url"))
    rendered = _laid(s, sf, [(at(n), html) for n, _, _, html, _ in SOURCES if html], ["url", "html"]).drop("key")
    bodies = [(at(n), i, "https://x.example.com/d.json", "application/json", b) for n, *_, found in SOURCES for i, b in enumerate(found)]
    responses = _laid(s, sf, bodies, ["page_url", "pos", "url", "content_type", "body"], ("pos",)).drop("key")
    return sourcing.page_postings(pages, responses, rendered)


_PAGE = ["floor(page_id / 10) AS key", "page_id % 10 AS number"]


@_query("page_sources", _wanted([(n, source, title, _B + url, place) for n, source, title, url, place in _SOURCED], ["number", "source", "job_title", "job_url", "location"]))
def page_sources(s: SparkSession, sf: str) -> DataFrame:
    """Postings of pages by the first of their sources that has any; all responses of a page together."""
    return _sourced(s, sf)[0].selectExpr(*_PAGE, "source", "job_title", "job_url", "location")


@_query("page_source_status", _wanted(_STATUS, ["number", "source", "jobs", "error"]))
def page_source_status(s: SparkSession, sf: str) -> DataFrame:
    """Pages that failed stay apart from empty ones, and refused URLs aren't asked again."""
    return _sourced(s, sf)[1].selectExpr(*_PAGE, "source", "jobs", "error")


# ---- P9: chains of pages by token ----

#: By board % 5: whole, without its page 5, back from page 6 to 3, with page 4 once more as page 5, and of nine pages.
_N = "l_orderkey % 9 + 1"
TOKEN_ROWS = f"""
SELECT board, n, key FROM (SELECT l_suppkey AS board, {_N} AS n, 'job-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS key FROM {{lineitem}})
WHERE (board % 5 = 4 OR n <= 6) AND NOT (board % 5 = 1 AND n = 5) AND NOT (board % 5 = 3 AND n = 5)
UNION ALL SELECT l_suppkey AS board, 5 AS n, 'job-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS key FROM {{lineitem}} WHERE l_suppkey % 5 = 3 AND {_N} = 4
"""
_CHAIN_SQL = f"""WITH r AS (SELECT * FROM {sql(TOKEN_ROWS)}), b AS (SELECT DISTINCT board FROM r)
SELECT board, CAST(CASE board % 5 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 8 END AS BIGINT) AS pages, CASE board % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'cut' WHEN 2 THEN 'cyclic' WHEN 3 THEN 'repeated' ELSE 'endless' END AS state,
CASE board % 5 WHEN 0 THEN NULL WHEN 1 THEN 'AdapterHttpError: page 5 is missing' WHEN 3 THEN 'AdapterHttpError: page 5 repeats known postings' ELSE 'AdapterHttpError: paging did not terminate' END AS error FROM b"""


def _chains(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = derived(s, sf, TOKEN_ROWS)
    token = lambda n: F.when(n > 1, F.concat(F.lit("t"), n.cast("string")))
    last = F.when(F.col("board") % 5 == 4, 9).otherwise(6)
    following = F.when(F.col("n") < last, token(F.col("n") + 1)).when(F.col("board") % 5 == 2, "t3")
    named = rows.select("board", token(F.col("n")).alias("token"), following.alias("next_token"), "key")
    return paging.token_chains(named.drop("key").distinct(), named.drop("next_token"), most=8)


@_query("token_pages", _CHAIN_SQL)
def token_pages(s: SparkSession, sf: str) -> DataFrame:
    """Chains by continuation token, whole or with what is wrong with them."""
    return _chains(s, sf)[1]


@_query("token_page_postings", f"SELECT DISTINCT board, n AS step, key FROM {sql(TOKEN_ROWS)} WHERE board % 5 = 0")
def token_page_postings(s: SparkSession, sf: str) -> DataFrame:
    """Postings of the boards whose chain is whole."""
    return _chains(s, sf)[0].select("board", "step", "key")


# ---- C13: interfaces in several versions ----

_CS = "https://acme{k}.csod.com/ux/ats/careersite/%d/home"
_WK = "https://apply.workable.com/w%d-{k}"
_V2 = '{"data": {"requisitions": [{"displayJobTitle": "%s {k}", "requisitionId": "%s", "locations": [{"city": "Lyon", "country": "France"}]}]}}'
#: vendor -> (number, URL, [(version, page, body, error)], markup)
VERSIONED = {
    "Cornerstone": [
        (1, _CS % 1, [("v2", 0, _V2 % ("Welder", "11"), None), ("v1", 0, _V2 % ("Old welder", "91"), None)], None),
        (2, _CS % 2, [("v2", 0, None, "AdapterHttpError: HTTP 403"), ("v1", 0, _V2 % ("Joiner", "12"), None), ("v1", 1, _V2 % ("Tiler", "13"), None)], None),
        (3, _CS % 3, [("v2", 0, _V2 % ("Half a list", "92"), None), ("v2", 1, "<html>", None), ("v1", 0, _V2 % ("Mason", "14"), None)], None),
        (4, _CS % 4, [("v2", 0, '{"data": {"requisitions": []}}', None), ("v1", 0, None, "AdapterHttpError: HTTP 404")], _cards(("/ux/ats/careersite/4/job/15", "Baker {k}"))),
        (5, _CS % 5, [("v2", 0, '{"data": {"requisitions": []}}', None)], "<p>none</p>"),
        (6, _CS % 6, [("v2", 0, None, "AdapterHttpError: HTTP 500"), ("v1", 0, "[", None)], None),
    ],
    "Workable": [
        (1, _WK % 1, [("widget", 0, '{"jobs": [{"title": "Clerk {k}", "url": "https://apply.workable.com/j/A{k}", "city": "Lyon", "country": "France"}]}', None), ("v3", 0, '{"results": [{"title": "Old clerk", "shortcode": "Z"}]}', None)], None),
        (2, _WK % 2, [("widget", 0, '{"results": []}', None), ("v3", 0, '{"results": [{"title": "Tutor {k}", "shortcode": "T{k}", "locations": [{"city": "Rome", "country": "Italy"}]}]}', None)], None),
        (3, _WK % 3, [("widget", 0, '{"jobs": []}', None), ("v3", 0, '{"results": [{"title": "Not asked for", "shortcode": "N"}]}', None)], None),
    ],
}
_VERSIONED = {
    "Cornerstone": [(1, "v2", "Welder {k}", "https://acme{k}.csod.com/ux/ats/careersite/1/job/11", "Lyon, France"), (2, "v1", "Joiner {k}", "https://acme{k}.csod.com/ux/ats/careersite/2/job/12", "Lyon, France"), (2, "v1", "Tiler {k}", "https://acme{k}.csod.com/ux/ats/careersite/2/job/13", "Lyon, France"),
                    (3, "v1", "Mason {k}", "https://acme{k}.csod.com/ux/ats/careersite/3/job/14", "Lyon, France"), (4, "page", "Baker {k}", "https://acme{k}.csod.com/ux/ats/careersite/4/job/15", "")],
    "Workable": [(1, "widget", "Clerk {k}", "https://apply.workable.com/j/A{k}", "Lyon, France"), (2, "v3", "Tutor {k}", "https://apply.workable.com/w2-{k}/j/T{k}", "Rome, Italy")],
}
_TOLD = {
    "Cornerstone": [(1, "v2", 1, None), (2, "v1", 2, None), (3, "v1", 1, None), (4, "page", 1, None), (5, "v2", 0, None), (6, None, 0, "AdapterHttpError: HTTP 500")],
    "Workable": [(1, "widget", 1, None), (2, "v3", 1, None), (3, "widget", 0, None)],
}


def _versions(s: SparkSession, sf: str, label: str) -> tuple[DataFrame, DataFrame]:
    cases = VERSIONED[label]
    rows = [(url, version, no, body, error) for _, url, bodies, _ in cases for version, no, body, error in bodies]
    payloads = _laid(s, sf, rows, ["board_url", "version", "page_no", "body", "error"], ("page_no",)).withColumn("company_name", F.lit("Acme")).drop("key")
    pages = _laid(s, sf, [(n, url, html or "") for n, url, _, html in cases], ["number", "url", "html"], ("number",))
    pages = pages.select((F.col("key") * 10 + F.col("number")).alias("page_id"), "url", "html", F.lit("Acme").alias("company_name"), F.lit(label).alias("platform"), F.col("url").alias("career_page_url"))
    names = pages.selectExpr("url AS board_url", *_PAGE)
    postings, status = vendors.versioned_postings(payloads, pages, label)
    return postings.join(names, "board_url"), status.join(names, "board_url")


def _add_versions(label: str) -> None:
    low = label.lower()
    _query(f"versioned_postings_{low}", _wanted(_VERSIONED[label], ["number", "version", "job_title", "job_url", "location"]))(
        lambda s, sf: _versions(s, sf, label)[0].select("key", "number", "version", "job_title", "job_url", "location"))
    _query(f"versioned_status_{low}", _wanted(_TOLD[label], ["number", "version", "jobs", "error"]))(lambda s, sf: _versions(s, sf, label)[1].select("key", "number", "version", "jobs", "error"))


for _label in VERSIONED:
    _add_versions(_label)


# ---- C2, C3, C15, Q23: from companies and captures to results ----

_GH, _LV = "https://boards.greenhouse.io/g%d-{k}", "https://jobs.lever.co/l%d-{k}"
_GH_BODY = '{"jobs": [{"title": "Welder {k}", "absolute_url": "https://boards.greenhouse.io/x/{k}/1", "location": {"name": "Lyon, France"}}, {"title": "Joiner {k}", "absolute_url": "https://boards.greenhouse.io/x/{k}/2", "location": {"name": "Rome, Italy"}}]}'
_SITE = "https://www.c%d-{k}.example.com"
#: (number, it_link, career_url, website)
COMPANIES = [
    (1, _GH % 1, "", ""), (2, _LV % 2, _SITE % 2 + "/careers", ""), (3, _GH % 3, "", ""), (4, "", _SITE % 4 + "/careers", ""), (5, "", "mailto:x", ""), (6, "https://jobs.gem.example.net/c6-{k}", "", ""),
    (7, "", _SITE % 7 + "/careers", ""), (8, "", "", _SITE % 8 + "/"), (9, "", _SITE % 9 + "/careers", ""), (10, _LV % 10, "", ""), (11, "https://c11-{k}.icims.com/jobs", "", ""), (12, _LV % 12, _LV % 13, _SITE % 12 + "/careers"),
]
PAYLOADS = [
    (_GH % 1, 0, _GH_BODY, None), (_LV % 2, 0, "[]", None), (_GH % 3, 0, "<html>busy</html>", None), (_LV % 8, 0, '[{"text": "Nurse {k}", "hostedUrl": "https://jobs.lever.co/l8-{k}/a", "categories": {"location": "Oslo, Norway"}}]', None), (_LV % 10, 0, "[]", None),
    (_LV % 12, 0, None, "AdapterHttpError: HTTP 503"), (_LV % 13, 0, "{}", None),
]
PAGES = [
    (_SITE % 2 + "/careers", _cards(("/job/1", "Tiler {k}"))),
    (_SITE % 4 + "/careers", _cards(("/job/1", "Mason {k}"), ("/job/2", "Baker {k}"), ("/job/3", "Clerk {k}"), more=_next("/careers?p=2"))),
    (_SITE % 4 + "/careers?p=2", _cards(("/job/3", "Clerk {k}"), ("/job/4", "Tutor {k}"), ("/job/5", "Cook {k}"), more=_next("/careers?p=3"))),
    (_SITE % 7 + "/careers", "<div id=app></div>"), (_SITE % 8 + "/", f'<a href="{_LV % 8}">We are hiring</a>'),
    ("https://c11-{k}.icims.com/jobs", '<div class="row"><a href="/jobs/77/pilot/job">Pilot {k}</a><span class="location">Paris, France</span></div>'),
    (_SITE % 12 + "/careers", _cards(("/job/9", "Third seed, not tried {k}"))),
]
RENDERED = [(_SITE % 9 + "/careers", _cards(("/job/1", "Driver {k}")))]
RESPONSES = [(_SITE % 7 + "/careers", 0, "https://x.example.com/d.json", "application/json", _BODY % ("Guard {k}", "/job/1"))]
#: (number, platform, URL, field, postings, error, discovered)
RESULTS = [
    (1, "Greenhouse", _GH % 1, "it_link", 2, None, False), (2, "Generic HTML", _SITE % 2 + "/careers", "career_url", 1, None, False), (3, "Greenhouse", _GH % 3, "it_link", 0, "AdapterHttpError: the body isn't JSON", False),
    (4, "Generic HTML", _SITE % 4 + "/careers", "career_url", 5, None, False), (5, "Unknown", "", "", 0, "no usable URL in the input sheet", False),
    (6, "Generic HTML", "https://jobs.gem.example.net/c6-{k}", "it_link", 0, "AdapterHttpError: nothing captured of https://jobs.gem.example.net/c6-{k}", False), (7, "Generic HTML", _SITE % 7 + "/careers", "career_url", 1, None, False),
    (8, "Lever", _LV % 8, "discovered", 1, None, True), (9, "Generic HTML", _SITE % 9 + "/careers", "career_url", 1, None, False), (10, "Lever", _LV % 10, "it_link", 0, None, False),
    (11, "iCIMS", "https://c11-{k}.icims.com/jobs", "it_link", 1, None, False), (12, "Lever", _LV % 12, "it_link", 0, "AdapterHttpError: HTTP 503", False),
]
_POSTED = [
    (1, "Welder {k}", "https://boards.greenhouse.io/x/{k}/1", "France"), (1, "Joiner {k}", "https://boards.greenhouse.io/x/{k}/2", "Italy"), (2, "Tiler {k}", _SITE % 2 + "/job/1", ""), (4, "Mason {k}", _SITE % 4 + "/job/1", ""),
    (4, "Baker {k}", _SITE % 4 + "/job/2", ""), (4, "Clerk {k}", _SITE % 4 + "/job/3", ""), (4, "Tutor {k}", _SITE % 4 + "/job/4", ""), (4, "Cook {k}", _SITE % 4 + "/job/5", ""), (7, "Guard {k}", _SITE % 7 + "/job/1", "France"),
    (8, "Nurse {k}", "https://jobs.lever.co/l8-{k}/a", "Norway"), (9, "Driver {k}", _SITE % 9 + "/job/1", ""), (11, "Pilot {k}", "https://c11-{k}.icims.com/jobs/77/pilot/job", "France"),
]


def _replayed(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    companies = _laid(s, sf, [(n, f"Company {n} {{k}}", *urls) for n, *urls in COMPANIES], ["number", "company", "it_link", "career_url", "website"], ("number",))
    companies = companies.select((F.col("key") * 100 + F.col("number")).alias("row_id"), "company", "it_link", "career_url", "website")
    captures = replay.Captures(
        _laid(s, sf, PAGES, ["url", "html"]).drop("key"), _laid(s, sf, RENDERED, ["url", "html"]).drop("key"),
        _laid(s, sf, RESPONSES, ["page_url", "pos", "url", "content_type", "body"], ("pos",)).drop("key"), _laid(s, sf, PAYLOADS, ["board_url", "page_no", "body", "error"], ("page_no",)).drop("key"))
    return replay.replayed(companies, captures)


_ROW = ["floor(row_id / 100) AS key", "row_id % 100 AS number"]
_RESULT_COLUMNS = ["number", "platform", "seed_url", "seed_field", "jobs", "error", "discovered"]


@_query("capture_replay", _wanted(RESULTS, _RESULT_COLUMNS))
def capture_replay(s: SparkSession, sf: str) -> DataFrame:
    """From companies, pages and payloads to a result for each company."""
    return _replayed(s, sf)[0].selectExpr(*_ROW, *_RESULT_COLUMNS[1:])


@_query("capture_replay_postings", _wanted(_POSTED, ["number", "job_title", "job_url", "country"]))
def capture_replay_postings(s: SparkSession, sf: str) -> DataFrame:
    """The postings of the same run."""
    return _replayed(s, sf)[1].selectExpr(*_ROW, "job_title", "job_url", "country")


_OUTCOMES = {n: "jobs" if jobs else "no_jobs" if not error else "technical" for n, _, _, _, jobs, error, _ in RESULTS}


def _coverage_sql() -> str:
    rows = []
    for platform in sorted({r[1] for r in RESULTS}):
        own = [r for r in RESULTS if r[1] == platform]
        made, none, bad = (sum(_OUTCOMES[r[0]] == o for r in own) for o in ("jobs", "no_jobs", "technical"))
        rows.append(f"SELECT {text(platform)} AS platform, {len(own)} * count(*) AS companies, CAST({sum(r[4] for r in own)} * count(*) AS BIGINT) AS jobs, {made} * count(*) AS produced, {none} * count(*) AS no_jobs, "
                    f"0 * count(*) AS unsupported, {bad} * count(*) AS technical, {bad} * count(*) AS failures, CAST({round(100.0 * made / len(own), 1)} AS DOUBLE) AS success_rate, CAST(0.0 AS DOUBLE) AS seconds FROM supplier")
    return " UNION ALL ".join(rows)


@_query("capture_replay_coverage", _coverage_sql())
def capture_replay_coverage(s: SparkSession, sf: str) -> DataFrame:
    """A1 over the results of the same run."""
    return reports.coverage(_replayed(s, sf)[0])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
