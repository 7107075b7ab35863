"""Named queries over the standing tables, and DuckDB SQL for each that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import fixed, places, platforms, texts, urls
from gleaner.operators import jobs, links, paging, reports, sampling, seeds
from gleaner.plans import derived as d
from gleaner.plans import oracles as o
from gleaner.plans.derived import derived, sql, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Vendors that the queries take as supported: the others have no adapter.
SUPPORTED = [n for i, n in enumerate(fixed.PLATFORMS) if i % 3]
SECONDS = 1234.56


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


def _companies(s: SparkSession, sf: str) -> DataFrame:
    return derived(s, sf, d.COMPANIES)


def _results(s: SparkSession, sf: str) -> DataFrame:
    return derived(s, sf, d.RESULTS)


def _supported(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(n,) for n in SUPPORTED], "platform string")


def _jobs(s: SparkSession, sf: str) -> DataFrame:
    return jobs.build_jobs(derived(s, sf, d.POSTINGS), "pos", "board")


def _first_jobs(s: SparkSession, sf: str, scope: list[str] | None = None) -> DataFrame:
    return jobs.first_jobs(derived(s, sf, d.POSTINGS), ["pos"], scope, ["pos", "board"])


C, R = sql(d.COMPANIES), sql(d.RESULTS)
J = o.jobs(sql(d.POSTINGS), "pos, board")
JOB_COLUMNS = "company_name, job_title, job_url, location, country, career_page_url, platform"
DEDUPED = o.first_of_each(J, "lower(company_name), lower(job_url)", "pos")
SUPPORTED_SQL = f"({', '.join(map(o.text, SUPPORTED))})"


# ---- URLs, seeds and platforms ----


@query("url_normalise_pages", f"SELECT page_id, n AS normalised, {o.site_host('n')} AS host, {o.site_path('n')} AS path FROM (SELECT page_id, {o.normalised('url')} AS n FROM pages)")
def url_normalise_pages(s: SparkSession, sf: str) -> DataFrame:
    n = urls.normalised(F.col("url"))
    rows = table(s, sf, "pages").select("page_id", n.alias("normalised"))
    return rows.select("page_id", "normalised", urls.site_host(F.col("normalised")).alias("host"), urls.site_path(F.col("normalised")).alias("path"))


@query("url_normalise_companies", f"SELECT row_id, n AS normalised, {o.site_host('n')} AS host, {o.site_path('n')} AS path FROM (SELECT row_id, {o.normalised('it_link')} AS n FROM {C})")
def url_normalise_companies(s: SparkSession, sf: str) -> DataFrame:
    rows = _companies(s, sf).select("row_id", urls.normalised(F.col("it_link")).alias("normalised"))
    return rows.select("row_id", "normalised", urls.site_host(F.col("normalised")).alias("host"), urls.site_path(F.col("normalised")).alias("path"))


@query("host_rollup_pages", f"SELECT {o.last_labels('url')} AS site, count(*) AS pages, count(DISTINCT {o.host_of('url')}) AS hosts FROM pages GROUP BY 1")
def host_rollup_pages(s: SparkSession, sf: str) -> DataFrame:
    return links.host_rollup(table(s, sf, "pages"))


@query("seed_candidates", f"SELECT * FROM {o.candidates(C)}")
def seed_candidates(s: SparkSession, sf: str) -> DataFrame:
    return seeds.seed_candidates(_companies(s, sf))


@query("platform_detect", f"SELECT row_id, platform FROM {o.with_platform(C, 'it_link')}")
def platform_detect(s: SparkSession, sf: str) -> DataFrame:
    return platforms.with_platform(_companies(s, sf), "it_link").select("row_id", "platform")


@query("platform_preview", f"SELECT platform, count(*) AS companies FROM {o.selected(C)} GROUP BY platform")
def platform_preview(s: SparkSession, sf: str) -> DataFrame:
    return seeds.selected_seeds(_companies(s, sf)).groupBy("platform").agg(F.count("*").alias("companies"))


_RANKS = " ".join(f"WHEN {o.text(n)} THEN {i + 1}" for i, n in enumerate([*fixed.PLATFORMS, fixed.GENERIC]))


@query("registry_join", f"SELECT row_id, platform, CASE platform {_RANKS} END AS rank, platform <> 'Unknown' AS has_adapter FROM {o.selected(C)}")
def registry_join(s: SparkSession, sf: str) -> DataFrame:
    # the platform table has a row for each rule
    return seeds.selected_seeds(_companies(s, sf)).join(F.broadcast(platforms.platform_table(s)), "platform", "left").select("row_id", "platform", "rank", "has_adapter")


@query("unsupported_platforms", f"SELECT platform, count(*) AS companies FROM {R} WHERE platform <> 'Unknown' AND platform NOT IN {SUPPORTED_SQL} GROUP BY platform")
def unsupported_platforms(s: SparkSession, sf: str) -> DataFrame:
    return reports.without_adapter(_results(s, sf), _supported(s))


@query("platforms_beyond_support", f"SELECT platform FROM {o.selected(C)} WHERE platform NOT IN {SUPPORTED_SQL} GROUP BY platform")
def platforms_beyond_support(s: SparkSession, sf: str) -> DataFrame:
    """The platforms that the seeds name less those that are supported."""
    named = seeds.selected_seeds(_companies(s, sf)).select("platform").distinct()
    return named.exceptAll(_supported(s))


@query("supported_semi_sample", f"""WITH x AS (SELECT row_id, platform, row_number() OVER (ORDER BY row_id) - 1 AS n, count(*) OVER () AS total FROM {o.selected(C)} WHERE platform IN {SUPPORTED_SQL})
SELECT row_id, platform FROM x WHERE total <= 40 OR (n % greatest(total // 40, 1) = 0 AND n < 40 * greatest(total // 40, 1))""")
def supported_semi_sample(s: SparkSession, sf: str) -> DataFrame:
    rows = seeds.selected_seeds(_companies(s, sf)).join(F.broadcast(_supported(s)), "platform", "left_semi")
    return sampling.stride_sample(rows.select("row_id", "platform"), "row_id", 40)


@query("input_limit", f"SELECT row_id, company FROM {C} ORDER BY row_id LIMIT 25")
def input_limit(s: SparkSession, sf: str) -> DataFrame:
    return _companies(s, sf).select("row_id", "company").orderBy("row_id").limit(25)


@query("seed_attempts_resolution", f"""WITH a AS (SELECT * FROM {sql(d.ATTEMPTS)}), sheet AS (SELECT * FROM a WHERE NOT discovered AND attempt <= 2),
g AS (SELECT company, max(CASE WHEN platform = 'Generic HTML' THEN 1 ELSE 0 END) AS generic FROM sheet GROUP BY company),
t AS (SELECT * FROM sheet UNION ALL SELECT a.* FROM a LEFT JOIN g ON a.company = g.company WHERE a.discovered AND (g.generic IS NULL OR g.generic = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN jobs = 0 THEN 1 ELSE 0 END, CASE WHEN discovered THEN 1 ELSE 0 END, attempt) AS n FROM t)
SELECT company, attempt, seed_field, platform, jobs, error, discovered FROM r WHERE n = 1""")
def seed_attempts_resolution(s: SparkSession, sf: str) -> DataFrame:
    return seeds.resolved_attempts(derived(s, sf, d.ATTEMPTS))


# ---- places and postings ----


@query("country_from_location", f"SELECT location, country FROM {o.countries(sql(d.POSTINGS))}")
def country_from_location(s: SparkSession, sf: str) -> DataFrame:
    rows = derived(s, sf, d.POSTINGS).select("location").distinct()
    return rows.select("location", places.derive_country(F.col("location")).alias("country"))


@query("job_projection", f"SELECT pos, board, {JOB_COLUMNS} FROM {J}")
def job_projection(s: SparkSession, sf: str) -> DataFrame:
    return _jobs(s, sf)


@query("job_export_view", "SELECT " + ", ".join(f'{c} AS "{h}"' for c, h in fixed.EXPORT_COLUMNS.items()) + f" FROM {DEDUPED}")
def job_export_view(s: SparkSession, sf: str) -> DataFrame:
    return jobs.export_view(_first_jobs(s, sf))


@query("dedupe_first_wins", f"SELECT pos, board, {JOB_COLUMNS} FROM {o.first_of_each(J, 'board, lower(company_name), lower(job_url)', 'pos')}")
def dedupe_first_wins(s: SparkSession, sf: str) -> DataFrame:
    return _first_jobs(s, sf, ["board"])


@query("dedupe_cross_company", f"SELECT pos, board, {JOB_COLUMNS} FROM {DEDUPED}")
def dedupe_cross_company(s: SparkSession, sf: str) -> DataFrame:
    return _first_jobs(s, sf)


_SLICES = f"(SELECT 1 AS part, * FROM {J} WHERE pos % 3 < 2 UNION ALL SELECT 2 AS part, * FROM {J} WHERE pos % 3 > 0)"


@query("union_pages_distinct", f"SELECT part, pos, job_url, job_title FROM {o.first_of_each(_SLICES, 'lower(company_name), lower(job_url)', 'part, pos')}")
def union_pages_distinct(s: SparkSession, sf: str) -> DataFrame:
    rows = _jobs(s, sf)
    # two slices that overlap where pos % 3 = 1 and together hold every posting
    both = rows.where("pos % 3 < 2").withColumn("part", F.lit(1)).unionByName(rows.where("pos % 3 > 0").withColumn("part", F.lit(2)))
    return jobs.dedupe(both, ["part", "pos"]).select("part", "pos", "job_url", "job_title")


_WIDTHS = " UNION ALL ".join(f"SELECT '{h}' AS header, CAST(least(greatest(greatest(coalesce(max(length({c})), 0), {len(h)}) + 2, 12), 70) AS BIGINT) AS width FROM x" for c, h in fixed.EXPORT_COLUMNS.items())


@query("column_widths", f"WITH x AS (SELECT * FROM {DEDUPED}) {_WIDTHS}")
def column_widths(s: SparkSession, sf: str) -> DataFrame:
    return jobs.column_widths(_first_jobs(s, sf))


# ---- results and reports ----


@query("outcome_classify", f"SELECT row_id, {o.OUTCOME} AS outcome FROM {R}")
def outcome_classify(s: SparkSession, sf: str) -> DataFrame:
    return reports.with_outcome(_results(s, sf)).select("row_id", "outcome")


@query("outcome_zero_filled", f"""WITH k(outcome) AS (VALUES {', '.join(f"({o.text(x)})" for x in fixed.OUTCOMES)}), c AS (SELECT {o.OUTCOME} AS outcome, count(*) AS n FROM {R} GROUP BY 1)
SELECT k.outcome, coalesce(c.n, 0) AS companies FROM k LEFT JOIN c ON k.outcome = c.outcome""")
def outcome_zero_filled(s: SparkSession, sf: str) -> DataFrame:
    return reports.outcome_counts(s, _results(s, sf))


@query("coverage_by_platform", f"""SELECT *, unsupported + technical AS failures, round(100.0 * produced / companies, 1) AS success_rate FROM (
SELECT platform, count(*) AS companies, CAST(sum(jobs) AS BIGINT) AS jobs, count(*) FILTER (outcome = 'jobs') AS produced, count(*) FILTER (outcome = 'no open jobs') AS no_jobs,
count(*) FILTER (outcome = 'unsupported platform') AS unsupported, count(*) FILTER (outcome IN ('technical failure', 'unknown platform')) AS technical, round(sum(seconds), 1) AS seconds
FROM (SELECT *, {o.OUTCOME} AS outcome FROM {R}) GROUP BY platform)""")
def coverage_by_platform(s: SparkSession, sf: str) -> DataFrame:
    return reports.coverage(_results(s, sf))


@query("coverage_order", f"SELECT platform, jobs, row_number() OVER (ORDER BY jobs DESC, platform) AS place FROM (SELECT platform, CAST(sum(jobs) AS BIGINT) AS jobs FROM {R} GROUP BY platform)")
def coverage_order(s: SparkSession, sf: str) -> DataFrame:
    return reports.coverage_order(reports.coverage(_results(s, sf))).select("platform", "jobs", "place")


@query("jobs_by_platform", f"SELECT platform, count(*) AS companies, CAST(sum(jobs) AS BIGINT) AS jobs, count(*) FILTER (jobs > 0) AS produced, count(*) FILTER (error IS NOT NULL) AS failed FROM {R} GROUP BY platform")
def jobs_by_platform(s: SparkSession, sf: str) -> DataFrame:
    return reports.jobs_by_platform(_results(s, sf))


@query("reason_family", f"SELECT DISTINCT error, {o.reason('error')} AS family FROM {R} WHERE error IS NOT NULL")
def reason_family(s: SparkSession, sf: str) -> DataFrame:
    return _results(s, sf).where("error is not null").select("error", texts.reason_family(F.col("error")).alias("family")).distinct()


_FAMILIES = f"(SELECT row_id, platform, {o.reason("coalesce(error, 'unknown')")} AS reason, error, {o.OUTCOME} AS outcome FROM {R})"


@query("failure_reasons_top12", f"""SELECT platform, reason, n, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY n DESC, first) AS place FROM (
SELECT platform, reason, count(*) AS n, min(row_id) AS first FROM {_FAMILIES} WHERE outcome IN ('technical failure', 'unsupported platform') GROUP BY 1, 2)) WHERE place <= 12""")
def failure_reasons_top12(s: SparkSession, sf: str) -> DataFrame:
    return reports.failure_reasons(_results(s, sf))


@query("failure_reasons_rollup", f"SELECT platform, reason, count(*) AS n FROM {_FAMILIES} WHERE error IS NOT NULL GROUP BY ROLLUP (platform, reason)")
def failure_reasons_rollup(s: SparkSession, sf: str) -> DataFrame:
    return reports.failure_rollup(_results(s, sf))


@query("failure_reasons_console", f"SELECT platform, reason, n, CAST(sum(n) OVER (PARTITION BY platform) AS BIGINT) AS platform_total FROM (SELECT platform, reason, count(*) AS n FROM {_FAMILIES} WHERE error IS NOT NULL GROUP BY 1, 2)")
def failure_reasons_console(s: SparkSession, sf: str) -> DataFrame:
    return reports.failure_console(_results(s, sf))


@query("jobs_by_country_top25", f"SELECT country, n FROM (SELECT CASE WHEN country = '' THEN '(unstated)' ELSE country END AS country, count(*) AS n, min(pos) AS first FROM {DEDUPED} GROUP BY 1) ORDER BY n DESC, first LIMIT 25")
def jobs_by_country_top25(s: SparkSession, sf: str) -> DataFrame:
    return reports.jobs_by_country(_first_jobs(s, sf))


@query("run_totals", f"""SELECT companies_processed, jobs_extracted, companies_producing_jobs, round(100.0 * companies_producing_jobs / companies_processed, 1) AS success_rate, round(CAST({SECONDS} AS DOUBLE), 1) AS crawl_seconds,
round({SECONDS} / companies_processed, 2) AS seconds_per_company, countries_identified, companies_via_discovery FROM
(SELECT count(*) AS companies_processed, count(*) FILTER (jobs > 0) AS companies_producing_jobs, count(*) FILTER (discovered) AS companies_via_discovery FROM {R}),
(SELECT count(*) AS jobs_extracted, count(DISTINCT nullif(country, '')) AS countries_identified FROM {DEDUPED})""")
def run_totals(s: SparkSession, sf: str) -> DataFrame:
    return reports.run_totals(_results(s, sf), _first_jobs(s, sf), SECONDS)


@query("top_errors", f"SELECT error, n FROM (SELECT error, count(*) AS n, min(row_id) AS first FROM {R} WHERE error IS NOT NULL GROUP BY error) ORDER BY n DESC, first LIMIT 5")
def top_errors(s: SparkSession, sf: str) -> DataFrame:
    return reports.top_errors(_results(s, sf))


@query("slowest_companies", f"SELECT row_id, company, platform, round(seconds, 1) AS seconds, jobs FROM (SELECT * FROM {R} ORDER BY seconds DESC, row_id LIMIT 15) WHERE seconds > 0")
def slowest_companies(s: SparkSession, sf: str) -> DataFrame:
    return reports.slowest(_results(s, sf))


@query("platform_rollup", f"SELECT platform, count(*) AS companies, CAST(sum(jobs) AS BIGINT) AS jobs, count(*) FILTER (jobs > 0) AS produced FROM {R} GROUP BY ROLLUP (platform)")
def platform_rollup(s: SparkSession, sf: str) -> DataFrame:
    return reports.platform_rollup(_results(s, sf))


_REPORT = f"""(SELECT r.row_id, r.company, coalesce(c.website, '') AS website, coalesce(c.career_url, '') AS career_url, coalesce(c.it_link, '') AS it_link, r.seed_url AS crawled_url,
CASE WHEN r.discovered THEN 'discovered' ELSE r.seed_field END AS seed_field, r.platform, r.outcome, coalesce(r.error, {o.text(fixed.NO_JOBS_DETAIL)}) AS detail, printf('%.1f', r.seconds) AS seconds
FROM (SELECT *, {o.OUTCOME} AS outcome FROM {R}) r LEFT JOIN {C} c ON r.row_id = c.row_id WHERE r.outcome <> 'jobs')"""


def _report(s: SparkSession, sf: str) -> DataFrame:
    return reports.report_rows(_companies(s, sf), _results(s, sf))


def _add_report(name: str, outcome: str) -> None:
    query(f"report_rows_{name}", f"SELECT * FROM {_REPORT} WHERE outcome = {o.text(outcome)}")(lambda s, sf: _report(s, sf).where(F.col("outcome") == outcome))


for _name, _outcome in (("no_jobs", "no open jobs"), ("unsupported", "unsupported platform"), ("technical", "technical failure"), ("unknown", "unknown platform")):
    _add_report(_name, _outcome)


@query("failed_companies_union", f"SELECT row_id, company, website, career_url, it_link, platform, detail AS reason FROM {_REPORT}")
def failed_companies_union(s: SparkSession, sf: str) -> DataFrame:
    return reports.failed_companies(_companies(s, sf), _results(s, sf))


@query("elapsed_format", f"""SELECT row_id, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, (s % 3600) // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS elapsed
FROM (SELECT row_id, CAST(floor(seconds * 200) AS BIGINT) AS s FROM {R})""")
def elapsed_format(s: SparkSession, sf: str) -> DataFrame:
    return _results(s, sf).select("row_id", texts.elapsed(F.col("seconds") * 200).alias("elapsed"))


@query("diagnostics_capped", f"""SELECT row_id, company, regexp_replace(regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS directory, platform, seed_url, coalesce(error, {o.text(fixed.NO_JOBS_DETAIL)}) AS error
FROM (SELECT * FROM {R} WHERE jobs = 0 AND platform IN ('Generic HTML', 'Unknown') ORDER BY row_id LIMIT 60)""")
def diagnostics_capped(s: SparkSession, sf: str) -> DataFrame:
    return links.unknown_pages(_results(s, sf))


@query("run_summary")
def run_summary(s: SparkSession, sf: str) -> DataFrame:
    return reports.summary(s, _results(s, sf), _first_jobs(s, sf), _supported(s), SECONDS)


# ---- pages ----


@query("page_links", f"SELECT page_id, pos, href, url, text FROM {o.links()}")
def page_links(s: SparkSession, sf: str) -> DataFrame:
    return links.page_links(table(s, sf, "pages")).drop("base", "marked")


_LINKED = """SELECT page_id, url, html || CASE page_id % 4 WHEN 0 THEN '<a href="/careers">Careers</a><a href="/jobs/list">See open positions</a>'
WHEN 1 THEN '<a href="https://jobs.lever.co/acme">We are hiring</a><a href="/careers">Careers</a>' WHEN 2 THEN '<a href="https://other.org/jobs">Jobs</a><a href="/press/jobs">Press jobs</a>' ELSE '' END AS html FROM {pages}"""
_SCORED = f"""(SELECT page_id, min(pos) AS pos, url, CAST(arg_min(score, pos) AS BIGINT) AS score FROM (SELECT *, {o.score('text', 'url', 'platform', 'base')} AS score FROM
{o.with_platform(f"(SELECT * FROM {o.links(sql(_LINKED))} WHERE url <> '')", 'url')}) WHERE score > 0 GROUP BY page_id, url)"""


@query("link_scores", f"SELECT * FROM {_SCORED}")
def link_scores(s: SparkSession, sf: str) -> DataFrame:
    return links.scored_links(_with_career_links(s, sf))


def _with_career_links(s: SparkSession, sf: str) -> DataFrame:
    return links.page_links(derived(s, sf, _LINKED))


@query("link_scores_best", f"SELECT page_id, url, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS n FROM {_SCORED}) WHERE n = 1")
def link_scores_best(s: SparkSession, sf: str) -> DataFrame:
    return links.best_links(links.scored_links(_with_career_links(s, sf)))


_CASES = ["Engineer II", "Apply now", "Applications Engineer", "View job details", "12345", "R&D", "ab", "Search | Jobs", "Learn more about jobs", "Lead, Data.", "  ", "More info", "Jobs...", "Ärztin"]
_CASE_ROWS = "(SELECT s_suppkey AS id, CASE " + " ".join(f"WHEN s_suppkey % {len(_CASES)} = {i} THEN {o.text(c)}" for i, c in enumerate(_CASES)) + " END AS text FROM supplier)"


@query("title_filter", f"SELECT id, text, {o.looks_like_title('text')} AS is_title FROM {_CASE_ROWS}")
def title_filter(s: SparkSession, sf: str) -> DataFrame:
    rows = s.sql(_CASE_ROWS.strip("()").replace("FROM supplier", "FROM {supplier}"), supplier=table(s, sf, "supplier"))
    return rows.select("id", "text", texts.looks_like_title(F.col("text")).alias("is_title"))


@query("job_link_filter", f"SELECT page_id, pos, url FROM {o.links(sql(_LINKED))} WHERE {o.any_of('lower(url)', fixed.JOB_URL_HINTS)}")
def job_link_filter(s: SparkSession, sf: str) -> DataFrame:
    return _with_career_links(s, sf).where(texts.looks_like_job_url(F.col("url"))).select("page_id", "pos", "url")


@query("challenge_pages", f"""SELECT page_id, {o.any_of('lower(title)', fixed.CHALLENGE_TITLES)} OR {o.any_of('lower(substr(html, 1, 4000))', fixed.CHALLENGE_MARKUP)} AS is_challenge,
{o.any_of('lower(substr(html, 1, 6000))', fixed.CAPTCHA_MARKUP)} AS is_captcha, {o.any_of('html', fixed.WAF_MARKERS)} AS is_barred
FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, html FROM (SELECT page_id, CASE page_id % 9 WHEN 0 THEN '<title>Just a Moment...</title>' WHEN 1 THEN '<div class="g-recaptcha">' WHEN 2 THEN 'gokuProps' WHEN 3 THEN '<script src=x.awsWAF.com/>' ELSE '' END || html AS html FROM pages))""")
def challenge_pages(s: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("page_id") % 9 == 0, "<title>Just a Moment...</title>").when(F.col("page_id") % 9 == 1, '<div class="g-recaptcha">').when(F.col("page_id") % 9 == 2, "gokuProps").when(F.col("page_id") % 9 == 3, "<script src=x.awsWAF.com/>").otherwise("")
    return links.gates(table(s, sf, "pages").withColumn("html", F.concat(mark, "html")))


_EVIDENCE = "coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' Apply now: full-time, part time' WHEN 1 THEN ' job id' ELSE '' END"


@query("listing_evidence", f"SELECT doc_id, CAST(len(regexp_extract_all({_EVIDENCE}, {o.text(fixed.LISTING_EVIDENCE)})) AS BIGINT) AS hits, len(regexp_extract_all({_EVIDENCE}, {o.text(fixed.LISTING_EVIDENCE)})) >= 2 AS is_listing FROM documents")
def listing_evidence(s: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 == 0, " Apply now: full-time, part time").when(F.col("doc_id") % 4 == 1, " job id").otherwise(""))
    hits = texts.listing_evidence(F.col("t")).cast("bigint")
    return table(s, sf, "documents").select("doc_id", text.alias("t")).select("doc_id", hits.alias("hits"), (hits >= 2).alias("is_listing"))


_SCRIPTED = "html || CASE page_id % 3 WHEN 0 THEN '<script src=\"/static/app.js\"></script><script>fetch(\"/api/v1/jobs?page=1\");load(''/graphql'')</script>' WHEN 1 THEN '<script>x(\"/a/search/all\",\"/api/v1/jobs?page=1\",\"/rest\")</script>' ELSE '' END"


@query("script_endpoints", f"""SELECT page_id, coalesce(list_slice(list_sort(list_distinct(list_filter(regexp_extract_all({_SCRIPTED}, {o.text(fixed.ENDPOINT)}, 1), lambda x: length(x) BETWEEN 4 AND 200))), 1, 40), []) AS endpoints,
CASE WHEN page_id % 3 = 0 THEN [regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) || '/static/app.js'] ELSE [] END AS bundles FROM pages""")
def script_endpoints(s: SparkSession, sf: str) -> DataFrame:
    return links.script_bundles(s.sql(f"SELECT page_id, url, {_SCRIPTED} AS html FROM {{pages}}", pages=table(s, sf, "pages")))


# ---- pages of listings ----


@query("pagination_until_no_new", f"""WITH RECURSIVE f AS (SELECT * FROM {sql(d.FOUND)}), first AS (SELECT board, key, min(page_no) AS page_no FROM f GROUP BY board, key), a AS (SELECT board, page_no, count(*) AS added FROM first GROUP BY 1, 2),
p AS (SELECT f.board, f.page_no, count(*) AS found, coalesce(max(a.added), 0) AS added FROM f LEFT JOIN a ON f.board = a.board AND f.page_no = a.page_no GROUP BY 1, 2),
w AS (SELECT * FROM p WHERE page_no = 0 UNION ALL SELECT p.* FROM w JOIN p ON p.board = w.board AND p.page_no = w.page_no + 1 WHERE w.added > 0 AND p.page_no < 50) SELECT board, page_no, found, added FROM w""")
def pagination_until_no_new(s: SparkSession, sf: str) -> DataFrame:
    return paging.pages_with_news(derived(s, sf, d.FOUND))


@query("pagination_next_chain", f"""WITH RECURSIVE e AS (SELECT * FROM {sql(d.EDGES)}), l AS (SELECT board, url, list(next_url ORDER BY place, next_url) AS targets FROM e GROUP BY board, url),
w AS (SELECT DISTINCT board, 1 AS step, 'p0' AS url, ['p0'] AS visited FROM e UNION ALL SELECT board, step + 1, nxt, list_append(visited, nxt) FROM (
SELECT w.board, w.step, w.visited, list_filter(l.targets, lambda t: NOT list_contains(w.visited, t))[1] AS nxt FROM w JOIN l ON l.board = w.board AND l.url = w.url WHERE w.step < 25) WHERE nxt IS NOT NULL)
SELECT board, CAST(step AS BIGINT) AS step, url FROM w""")
def pagination_next_chain(s: SparkSession, sf: str) -> DataFrame:
    edges = derived(s, sf, d.EDGES)
    return paging.next_chain(edges, edges.select("board").distinct().withColumn("url", F.lit("p0")))


@query("incomplete_boards", f"SELECT board, count(DISTINCT key) AS n, max(total) AS total FROM {sql(d.FOUND)} GROUP BY board HAVING count(DISTINCT key) < max(total)")
def incomplete_boards(s: SparkSession, sf: str) -> DataFrame:
    return paging.incomplete_boards(derived(s, sf, d.FOUND))


_PAGES = "SELECT l_suppkey AS board, CAST(l_orderkey % 12 AS BIGINT) AS page_no, CAST(count(*) AS BIGINT) AS n, CAST(max(l_suppkey % 90) AS BIGINT) AS total FROM {lineitem} GROUP BY l_suppkey, l_orderkey % 12"


@query("offsets_read", f"""WITH RECURSIVE p AS (SELECT *, sum(n) OVER (PARTITION BY board ORDER BY page_no) AS upto, first_value(total) OVER (PARTITION BY board ORDER BY page_no) AS t, row_number() OVER (PARTITION BY board ORDER BY page_no) AS i FROM {sql(_PAGES)} WHERE page_no < 10),
w AS (SELECT *, n < 30 OR upto >= t AS stop FROM p WHERE i = 1 UNION ALL SELECT p.*, p.n < 30 OR p.upto >= p.t FROM w JOIN p ON p.board = w.board AND p.i = w.i + 1 WHERE NOT w.stop) SELECT board, page_no, n, stop AS ends FROM w""")
def offsets_read(s: SparkSession, sf: str) -> DataFrame:
    return paging.offsets_read(derived(s, sf, _PAGES), 30, 10)


# ---- events ----


@query("event_props_json", "SELECT event_id, event_type, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events")
def event_props_json(s: SparkSession, sf: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(s, sf, "events").select("event_id", "event_type", F.coalesce(k, F.lit(-1)).alias("k"))


@query("event_type_mix", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def event_type_mix(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
