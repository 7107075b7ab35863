"""Named queries over captured pages and payloads, laid out from `supplier` by templates, and SQL for what they must give.

A case is a template of markup or of a body, in which {k} stands for the supplier's key, with the postings that it
holds, written out by hand. Each case is laid out for every supplier; the SQL puts the same keys into the rows that
were written out, and shares nothing else with the readers.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import links, markup, paging, vendors
from gleaner.plans.derived import supplier_keys, table
from gleaner.plans.oracles import text
from gleaner.plans.reader_cases import (
    APPLY,
    BOARD_URLS,
    CARDS,
    CHAIN,
    DOMAINS,
    HOSTED,
    LINKED_DATA,
    MICRODATA,
    PAGERS,
    ROWS,
    SITES,
    STATE,
    VENDORS,
    Case,
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Where the pages of cases are captured, and the columns that the results have.
PAGE_URL, COMPANY = "https://acme.example.com/careers/{k}", "Acme {k}"
FOUND = ["page_id", "job_title", "job_url", "location", "country", "career_page_url", "platform"]


def _filled(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{k}"), F.col("k"))


def _pages(s: SparkSession, sf: str, cases: list[Case], platform: str = "Generic HTML") -> DataFrame:
    """pages(page_id, url, html, company_name, platform, career_page_url): every case for every supplier."""
    one = lambda i, c: F.struct(
        (F.col("key") * 100 + i).alias("page_id"), _filled(c.url or PAGE_URL).alias("url"), _filled(c.source).alias("html"), _filled(COMPANY).alias("company_name"),
        F.lit(c.platform or platform).alias("platform"), _filled(c.url or PAGE_URL).alias("career_page_url"))
    rows = F.array(*[one(i, c) for i, c in enumerate(cases)])
    return supplier_keys(s, sf).select(F.explode(rows).alias("x")).select("x.*")


def _put(value: str) -> str:
    return f"replace({text(value)}, '{{k}}', CAST(s_suppkey AS VARCHAR))" if "{k}" in value else text(value)


def _wanted(cases: list[Case], platform: str = "Generic HTML", board: str | None = None) -> str:
    """SQL for the rows that the cases hold."""
    parts = [
        f"SELECT s_suppkey * 100 + {i} AS page_id, {_put(r[0])} AS job_title, {_put(r[1])} AS job_url, {_put(r[2])} AS location, {text(r[3])} AS country, "
        f"{_put(board or c.url or PAGE_URL)} AS career_page_url, {text(c.platform or platform)} AS platform FROM supplier"
        for i, c in enumerate(cases) for r in c.rows
    ]
    return " UNION ALL ".join(parts)


def _query(name: str, oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


# ---- one way of reading a page each ----


@_query("json_ld_postings", _wanted(LINKED_DATA))
def json_ld_postings(s: SparkSession, sf: str) -> DataFrame:
    """S9, F9, J9, X20."""
    return markup.finished(markup.from_linked_data(markup.parsed(_pages(s, sf, LINKED_DATA)))).select(*FOUND)


@_query("microdata_postings", _wanted(MICRODATA))
def microdata_postings(s: SparkSession, sf: str) -> DataFrame:
    """J10."""
    return markup.finished(markup.from_microdata(markup.parsed(_pages(s, sf, MICRODATA)))).select(*FOUND)


@_query("largest_card_group", _wanted(CARDS))
def largest_card_group(s: SparkSession, sf: str) -> DataFrame:
    """A2, J11, X17, X19, F6, F7."""
    return markup.finished(markup.from_cards(markup.parsed(_pages(s, sf, CARDS)))).select(*FOUND)


@_query("apply_link_titles", _wanted(APPLY))
def apply_link_titles(s: SparkSession, sf: str) -> DataFrame:
    """J12, X18."""
    return markup.finished(markup.from_apply_links(markup.parsed(_pages(s, sf, APPLY)))).select(*FOUND)


@_query("embedded_state_postings", _wanted(STATE))
def embedded_state_postings(s: SparkSession, sf: str) -> DataFrame:
    """S10, S11, S12, A3, J8, C9, T11, U3, F8, F16, X13, X14, X15, X16."""
    return markup.finished(markup.from_state(markup.parsed(_pages(s, sf, STATE)))).select(*FOUND)


@_query("strategy_chain", _wanted(CHAIN))
def strategy_chain(s: SparkSession, sf: str) -> DataFrame:
    """C6, S8."""
    return markup.extract_jobs(_pages(s, sf, CHAIN)).select(*FOUND)


def _amid(cases: list[Case], platform: str = "Generic HTML") -> str:
    """SQL for the rows of cases whose markup stands in the given pages, by page_id."""
    put = lambda value: _put(value).replace("s_suppkey", "page_id")
    return " UNION ALL ".join(
        f"SELECT page_id, {put(r[0])} AS job_title, {put(r[1])} AS job_url, {put(r[2])} AS location, {text(r[3])} AS country, {put(c.url or PAGE_URL)} AS career_page_url, {text(c.platform or platform)} AS platform FROM pages WHERE page_id % {len(cases)} = {i}"
        for i, c in enumerate(cases) for r in c.rows)


def _given(s: SparkSession, sf: str, cases: list[Case], platform: str = "Generic HTML") -> DataFrame:
    """The given pages, each with the markup of one case before its own."""
    rows = table(s, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("k"), F.coalesce("html", F.lit("")).alias("own"))
    one = lambda c: F.struct(_filled(c.url or PAGE_URL).alias("url"), _filled(c.source).alias("case"), F.lit(c.platform or platform).alias("platform"))
    held = rows.select("page_id", "k", "own", F.get(F.array(*map(one, cases)), (F.col("page_id") % len(cases)).cast("int")).alias("x"))
    return held.select("page_id", "x.url", F.concat("x.case", "own").alias("html"), _filled(COMPANY).alias("company_name"), "x.platform", F.col("x.url").alias("career_page_url"))


@_query("strategy_chain_pages", _amid(CHAIN))
def strategy_chain_pages(s: SparkSession, sf: str) -> DataFrame:
    """C6, S8 over the given pages, whose own links and scripts are no postings."""
    return markup.extract_jobs(_given(s, sf, CHAIN)).select(*FOUND)


@_query("linked_data_pages", _amid(LINKED_DATA))
def linked_data_pages(s: SparkSession, sf: str) -> DataFrame:
    """S9, J9 over the given pages."""
    return markup.finished(markup.from_linked_data(markup.parsed(_given(s, sf, LINKED_DATA)))).select(*FOUND)


@_query("embedded_state_pages", _amid(STATE))
def embedded_state_pages(s: SparkSession, sf: str) -> DataFrame:
    """S10, C9 over the given pages."""
    return markup.finished(markup.from_state(markup.parsed(_given(s, sf, STATE)))).select(*FOUND)


# ---- vendors' pages ----


@_query("vendor_pattern_extract", _wanted(HOSTED))
def vendor_pattern_extract(s: SparkSession, sf: str) -> DataFrame:
    """J13, C7, C10, C11, N8, X8, and the 27 boards that a pattern describes."""
    return vendors.hosted_postings(_pages(s, sf, HOSTED)).select(*FOUND)


@_query("vendor_row_extract", _wanted(ROWS))
def vendor_row_extract(s: SparkSession, sf: str) -> DataFrame:
    """J14, and the five boards that are read row by row."""
    return markup.vendor_rows(_pages(s, sf, ROWS), vendors.ROW_RULES).select(*FOUND)


# ---- vendors' payloads ----


def _payloads(s: SparkSession, sf: str, board_url: str, cases: list[Case]) -> DataFrame:
    """payloads(board_url, company_name, page_no, body): every case for every supplier."""
    one = lambda i, c: F.struct(_filled(c.url or board_url).alias("board_url"), _filled(COMPANY).alias("company_name"), (F.col("key") * 100 + i).alias("page_no"), _filled(c.source).alias("body"))
    return supplier_keys(s, sf).select(F.explode(F.array(*[one(i, c) for i, c in enumerate(cases)])).alias("x")).select("x.*")


def _add_vendor(label: str, board_url: str, board: str, cases: list[Case]) -> None:
    name = "xml_feed" if label == "Personio" else "vendor_api_" + label.lower().replace(" ", "_")

    def run(s: SparkSession, sf: str) -> DataFrame:
        return vendors.api_postings(_payloads(s, sf, board_url, cases), label).withColumnRenamed("page_no", "page_id").select(*FOUND)

    run.__doc__ = f"J15, X25, X28, X29: payloads of {label}."
    _query(name, _wanted([c._replace(platform=label) for c in cases], board=board))(run)


for _label, (_url, _board, _cases) in VENDORS.items():
    _add_vendor(_label, _url, _board, _cases)


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@_query("api_errors", _union([
    f"SELECT '{label}' AS platform, s_suppkey * 100 + {i} AS page_no, {text(kind)} AS error FROM supplier"
    for label in ("Greenhouse", "Lever", "Workday")
    for i, kind in ((0, "AdapterUrlError: not a board of this vendor"), (1, "AdapterHttpError: the body isn't JSON"), (2, "AdapterHttpError: the body holds no list of postings"))]))
def api_errors(s: SparkSession, sf: str) -> DataFrame:
    """What a vendor's payload can't tell, apart from boards that are empty."""
    out = None
    for label, good in (("Greenhouse", "https://boards.greenhouse.io/acme"), ("Lever", "https://jobs.lever.co/acme"), ("Workday", "https://acme.wd1.myworkdayjobs.com/Site")):
        full = {"Greenhouse": '{"jobs": []}', "Lever": "[]", "Workday": '{"jobPostings": []}'}[label]
        cases = [Case(full, [], "https://"), Case("<html>", [], good), Case('{"other": 1}', [], good), Case(full, [], good)]
        found = vendors.api_errors(_payloads(s, sf, good, cases), label).select(F.lit(label).alias("platform"), "page_no", "error")
        out = found if out is None else out.unionByName(found)
    return out


_FEEDS = [("<workzag-jobs><position>", "AdapterHttpError: the body isn't XML"), ("not xml {k}", "AdapterHttpError: the body isn't XML"), ("<workzag-jobs/>", None), ("<a><b><position><id>{k}</id></position></b></a>", None),
          ('<!DOCTYPE a [<!ENTITY x "{k}">]><a>&x;</a>', "AdapterHttpError: the body isn't XML"), ("", "AdapterHttpError: the body isn't XML")]


@_query("feed_errors", _union([f"SELECT s_suppkey * 100 + {i} AS page_no, {text(error)} AS error FROM supplier" for i, (_, error) in enumerate(_FEEDS) if error]))
def feed_errors(s: SparkSession, sf: str) -> DataFrame:
    """Feeds that can't be read, apart from those without postings."""
    bodies = _payloads(s, sf, "https://acme{k}.jobs.personio.de", [Case(body, []) for body, _ in _FEEDS])
    return vendors.api_errors(bodies, "Personio").select("page_no", "error")


@_query("board_url_errors", _union([f"SELECT s_suppkey AS key, {_put(url)} AS url, {text(error) if error else 'NULL'} AS error FROM supplier" for url, error in BOARD_URLS]))
def board_url_errors(s: SparkSession, sf: str) -> DataFrame:
    """F18."""
    rows = supplier_keys(s, sf).select("key", F.explode(F.array(*[_filled(u) for u, _ in BOARD_URLS])).alias("url"))
    return rows.select("key", "url", vendors.board_url_error(F.col("url"), ["gohire.io"]).alias("error"))


@_query("eightfold_domains", _union([f"SELECT s_suppkey AS key, {_put(url)} AS url, {_put(domain)} AS domain FROM supplier" for url, _, domain in DOMAINS]))
def eightfold_domains(s: SparkSession, sf: str) -> DataFrame:
    """X27."""
    rows = supplier_keys(s, sf).select("key", F.explode(F.array(*[F.struct(_filled(u).alias("url"), _filled(m).alias("html")) for u, m, _ in DOMAINS])).alias("x"))
    return rows.select("key", "x.url", vendors.eightfold_domain(F.col("x.url"), F.col("x.html")).alias("domain"))


# ---- from page to page ----


@_query("next_page_urls", _union([f"SELECT s_suppkey * 100 + {i} AS page_id, {_put(c.rows[0][0])} AS url FROM supplier" for i, c in enumerate(PAGERS) if c.rows]))
def next_page_urls(s: SparkSession, sf: str) -> DataFrame:
    """The first link that a pager marks or labels as next, else its lowest number."""
    return links.next_pages(_pages(s, sf, PAGERS))


@_query("board_walk", _union([f"SELECT s_suppkey AS board, CAST({i} AS BIGINT) AS step, {_put(f'https://acme.example.com/b{{k}}/{p}')} AS url FROM supplier" for i, p in ((1, "1"), (2, "2"), (3, "3"))]))
def board_walk(s: SparkSession, sf: str) -> DataFrame:
    """The pages of a board in the order of a walk along its pagers, which ends where no page is new."""
    follow = lambda n, to: f'<a href="/b{{k}}/{n}">{n}</a><a rel="next" href="/b{{k}}/{to}">more of it</a>'
    pages = _pages(s, sf, [Case(follow(n, to), [], f"https://acme.example.com/b{{k}}/{n}") for n, to in ((1, 2), (2, 3), (3, 1))])
    return paging.page_walk(pages.withColumn("board", F.floor(F.col("page_id") / 100)), "https://acme.example.com/b{k}/1")


@_query("career_page_discovery", _union([f"SELECT {_put(f'{i} Acme {{k}}')} AS company, {_put(url)} AS url, '{how}' AS how FROM supplier" for i, (_, url, how) in enumerate(SITES) if url]))
def career_page_discovery(s: SparkSession, sf: str) -> DataFrame:
    """From a company's site to its board."""
    cases = [Case(m, [], u) for site, _, _ in SITES for u, m in site]
    sites = supplier_keys(s, sf).select(F.explode(F.array(*[F.struct(_filled(f"{i} Acme {{k}}").alias("company"), _filled(site[0][0]).alias("url")) for i, (site, _, _) in enumerate(SITES)])).alias("x"))
    return links.discovered(sites.select("x.*"), _pages(s, sf, cases).select("page_id", "url", "html"))


#: More bodies than the 120 of a page that are read: the first six, then lists.
_MORE = 130


@_query("captured_json", f"SELECT {_put('https://acme.example.com/{k}')} AS page_url, CAST(unnest(list_concat([0, 2, 4, 5], range(6, 122))) AS BIGINT) AS pos FROM supplier")
def captured_json(s: SparkSession, sf: str) -> DataFrame:
    """Responses that hold JSON, the first 120 of each page."""
    kinds = [("application/json", '{"a": {k}}'), ("text/html", "<p>"), ("", "[1]"), ("application/json", "no json"), ("APPLICATION/JSON; charset=utf-8", "[{k}]"), ("application/json", "[2]")] + [("application/json", "[3]")] * _MORE
    one = lambda i, kind, body: F.struct(
        _filled("https://acme.example.com/{k}").alias("page_url"), F.lit(i).cast("bigint").alias("pos"), F.lit("https://acme.example.com/d.json" if i == 2 else "https://acme.example.com/d").alias("url"),
        F.lit(kind).alias("content_type"), _filled(body).alias("body"))
    rows = supplier_keys(s, sf).select(F.explode(F.array(*[one(i, *x) for i, x in enumerate(kinds)])).alias("x")).select("x.*")
    return links.captured_json(rows).select("page_url", "pos")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
