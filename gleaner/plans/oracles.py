"""Pieces of DuckDB SQL that state the engine's expressions once more, for the oracles."""

from __future__ import annotations

from gleaner.functions import fixed


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return ", ".join(text(v) for v in values)


def any_of(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(p)})" for p in parts) + ")"


def stripped(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"


def normalised(x: str) -> str:
    bare = f"""regexp_replace(regexp_replace({stripped(x)}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')"""
    return (f"CASE WHEN {bare} = '' THEN '' WHEN starts_with({bare}, '//') THEN 'https:' || {bare} WHEN contains({bare}, '://') THEN {bare} "
            f"WHEN contains(split_part({bare}, '/', 1), ':') THEN {bare} ELSE 'https://' || {bare} END")


def host_of(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':.*$', ''))"


def path_of(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def site_host(u: str) -> str:
    host = f"regexp_replace(regexp_replace({host_of(u)}, '[.]+$', ''), '^www[.]', '')"
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    return rf"CASE WHEN {scheme} IN ('http', 'https') AND regexp_matches({host}, '^[^\s./\\?#@:]+([.][^\s./\\?#@:]+)+$') THEN {host} END"


def site_path(u: str) -> str:
    query = f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"
    return f"lower({path_of(u)} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"


def last_labels(u: str) -> str:
    return f"regexp_extract({host_of(u)}, '([^.]*[.])?[^.]*$', 0)"


def platform_of(host: str, path: str) -> str:
    """CASE by rules: all hosts, then all paths."""
    by_host = " ".join("WHEN " + " OR ".join(f"{host} = {text(d)} OR ends_with({host}, {text('.' + d)})" for d in hosts) + f" THEN {text(n)}" for n, hosts, _ in fixed.RULES)
    by_path = " ".join(f"WHEN {any_of(path, parts)} THEN {text(n)}" for n, _, parts in fixed.RULES if parts)
    return f"CASE WHEN {host} IS NULL THEN 'Unknown' {by_host} {by_path} ELSE 'Generic HTML' END"


def with_platform(rows: str, url: str) -> str:
    """rows (a bracketed query) with p_host, p_path and platform of a raw URL column."""
    return f"""(SELECT * EXCLUDE (p_url, p_host, p_path), {platform_of('p_host', 'p_path')} AS platform FROM (
        SELECT *, {site_host('p_url')} AS p_host, {site_path('p_url')} AS p_path FROM (SELECT *, {normalised(url)} AS p_url FROM {rows})))"""


def candidates(companies: str) -> str:
    """(row_id, company, place, seed_url, seed_field, platform)"""
    listed = " UNION ALL ".join(f"SELECT row_id, company, {i} AS pos, '{f}' AS seed_field, {stripped(f)} AS seed_url FROM {companies}" for i, f in enumerate(fixed.SEED_FIELDS))
    usable = with_platform(f"(SELECT * FROM ({listed}) WHERE seed_url <> '')", "seed_url")
    return f"""(SELECT row_id, company, CAST(row_number() OVER (PARTITION BY row_id ORDER BY pos) AS BIGINT) AS place, seed_url, seed_field, platform FROM (
        SELECT *, row_number() OVER (PARTITION BY row_id, lower(rtrim(seed_url, '/')) ORDER BY pos) AS again FROM {usable} WHERE platform <> 'Unknown') WHERE again = 1)"""


def selected(companies: str) -> str:
    return f"""(SELECT c.row_id, c.company, coalesce(s.seed_url, '') AS seed_url, coalesce(s.seed_field, '') AS seed_field, coalesce(s.platform, 'Unknown') AS platform
        FROM {companies} c LEFT JOIN (SELECT * FROM {candidates(companies)} WHERE place = 1) s ON c.row_id = s.row_id)"""


def country_table() -> str:
    return "(VALUES " + ", ".join(f"({text(a)}, {text(c)})" for a, c in fixed.COUNTRY_OF.items()) + ") AS countries(alias, country)"


def countries(rows: str) -> str:
    """(location, country) of the distinct locations of rows, part by part and segment by segment."""
    states, provinces, names = texts(fixed.US_STATES), texts(fixed.CANADIAN_PROVINCES), texts(fixed.US_STATE_NAMES)
    return f"""(
    WITH locs AS (SELECT DISTINCT location FROM {rows}),
    lookup AS (SELECT * FROM {country_table()}),
    parts AS (SELECT location, trim(unnest(string_split_regex(coalesce(location, ''), {text(fixed.LOCATION_SEPARATOR)}))) AS part FROM locs),
    plain AS (SELECT location, part, trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(part, {text(fixed.LOCATION_QUALIFIER)}, ''), {text(fixed.PARENTHETICAL)}, '', 'g'))), '\\s+', ' ', 'g')) AS t
              FROM parts WHERE part <> ''),
    kept AS (SELECT * FROM plain WHERE t <> '' AND t NOT IN ({texts(fixed.PLACEHOLDERS)}) AND NOT regexp_matches(t, {text(fixed.LOCATION_COUNT)})),
    cut AS (SELECT location, part, t, list_filter(list_transform(string_split(t, ','), lambda s: trim(s)), lambda s: s <> '') AS segs FROM kept),
    seg AS (SELECT location, part, t, len(segs) AS n, unnest(segs) AS s, generate_subscripts(segs, 1) AS i FROM cut),
    flat AS (SELECT *, trim(regexp_replace(s, '[.\\s]+', ' ', 'g')) AS f FROM seg),
    told AS (SELECT flat.*, coalesce(l1.country, l2.country, CASE WHEN n > 1 THEN CASE WHEN replace(f, ' ', '') IN ({states}) THEN 'United States'
                WHEN replace(f, ' ', '') IN ({provinces}) THEN 'Canada' WHEN f IN ({names}) THEN 'United States' END END,
                CASE WHEN regexp_extract(f, '^([a-z]{{2}})\\s+\\d{{5}}(?:-\\d{{4}})?$', 1) IN ({states}) THEN 'United States' END) AS c
             FROM flat LEFT JOIN lookup l1 ON l1.alias = f LEFT JOIN lookup l2 ON l2.alias = s),
    last AS (SELECT location, part, t, arg_max(c, i) AS c FROM told WHERE c IS NOT NULL GROUP BY ALL),
    whole AS (SELECT kept.location, kept.part, coalesce(lookup.country, last.c) AS c FROM kept LEFT JOIN lookup ON lookup.alias = kept.t
              LEFT JOIN last ON last.location = kept.location AND last.part = kept.part),
    one AS (SELECT location, CASE WHEN count(DISTINCT c) = 1 THEN min(c) ELSE '' END AS country FROM whole WHERE c IS NOT NULL GROUP BY location)
    SELECT locs.location, coalesce(one.country, '') AS country FROM locs LEFT JOIN one ON one.location = locs.location)"""


def jobs(raw: str, keep: str) -> str:
    """Postings of raw rows, with the columns `keep`."""
    base = f"""(SELECT {keep}, {stripped('company_name')} AS company_name, {stripped('title')} AS job_title, {stripped('url')} AS job_url, {stripped('location')} AS location,
        {stripped('country')} AS given, {stripped('career_page_url')} AS career_page_url, {stripped('platform')} AS platform FROM {raw})"""
    return f"""(SELECT j.* EXCLUDE (given), CASE WHEN given <> '' THEN given ELSE c.country END AS country FROM {base} j JOIN {countries(base)} c ON c.location = j.location
        WHERE job_title <> '' AND job_url <> '')"""


def first_of_each(rows: str, keys: str, order: str) -> str:
    return f"(SELECT * EXCLUDE (again) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS again FROM {rows}) WHERE again = 1)"


OUTCOME = """CASE WHEN jobs > 0 THEN 'jobs' WHEN error IS NULL THEN 'no open jobs' WHEN contains(error, 'no adapter for') THEN 'unsupported platform'
    WHEN platform = 'Unknown' THEN 'unknown platform' ELSE 'technical failure' END"""


def reason(e: str) -> str:
    kind = f"split_part({e}, ': ', 1)"
    rest = f"CASE WHEN contains({e}, ': ') THEN substr({e}, length({kind}) + 3) ELSE '' END"
    head = rf"trim(split_part(split_part(regexp_replace({rest}, 'https?://\S+', '<url>', 'g'), ': ''', 1), ' (', 1))"
    return (f"CASE WHEN contains({e}, 'no adapter for') THEN {e} WHEN contains({e}, 'bot challenge') OR contains({e}, 'Human Verification') THEN {kind} || ': anti-bot interstitial' "
            f"WHEN contains({e}, 'client-side') OR contains({e}, 'browser-driven') THEN {kind} || ': needs a browser' WHEN contains({e}, 'legacy') THEN {kind} || ': legacy portal, no public endpoint' "
            f"WHEN {head} = '' THEN {kind} ELSE {kind} || ': ' || substr({head}, 1, 80) END")


def clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x{{A0}}]+', ' ', 'g'))"


def bare(x: str) -> str:
    return f"regexp_replace(lower({x}), '^[ .:*>|-]+|[ .:*>|-]+$', '', 'g')"


def looks_like_title(x: str) -> str:
    return rf"(length({x}) BETWEEN 3 AND 160 AND {bare(x)} NOT IN ({texts(fixed.NAVIGATION_TEXT)}) AND NOT regexp_matches({x}, {text(fixed.NAVIGATION_PATTERN)}) AND regexp_matches({x}, '\p{{L}}'))"


def score(label: str, url: str, platform: str, base: str) -> str:
    low, t = f"lower({url})", f"lower({clean(label)})"
    slugs = [f"/{w.replace(' ', '-')}" for w in fixed.CAREER_WORDS]
    return (f"CASE WHEN coalesce({url}, '') = '' OR {any_of(t, fixed.NEGATIVE_WORDS)} THEN 0 WHEN {platform} NOT IN ('Generic HTML', 'Unknown') THEN 100 ELSE "
            f"CASE WHEN {t} IN ({texts(fixed.CAREER_WORDS)}) THEN 12 WHEN {any_of(t, fixed.CAREER_WORDS)} THEN 7 ELSE 0 END + CASE WHEN {any_of(low, slugs)} THEN 6 ELSE 0 END "
            f"+ CASE WHEN regexp_matches({low}, {text(fixed.CAREER_PATH_PATTERN)}) THEN 8 ELSE 0 END - CASE WHEN {last_labels(base)} = {last_labels(url)} THEN 0 ELSE 5 END END")


def unescaped(x: str) -> str:
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {text(name)}, {text(mark)})"
    return x


def absolute_rooted(base: str, href: str) -> str:
    """Absolute URLs of links that are absolute, rooted or fragments, as those of the pages are."""
    origin = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0)"
    link = stripped(href)
    folder = f"regexp_replace({path_of(base)}, '[^/]*$', '')"
    return (f"CASE WHEN {link} = '' OR starts_with({link}, '#') OR regexp_matches(lower({link}), '^(javascript|mailto|tel):') THEN '' WHEN regexp_matches(lower({link}), '^[a-z][a-z0-9+.-]*:') THEN {link} "
            f"WHEN starts_with({link}, '//') THEN regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*:', 0) || {link} WHEN starts_with({link}, '?') THEN {origin} || {path_of(base)} || {link} "
            f"WHEN starts_with({link}, '/') THEN {origin} || {link} ELSE {origin} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {link} END")


def links(pages: str = "pages") -> str:
    """(page_id, pos, href, url, text, base) of the anchors of pages."""
    bare_html = "regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\\b.*?</script>', '', 'g')"
    href = "(?is)^<a\\s(?:[^>]*?\\s)?href\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s>\"'']+))"
    return f"""(SELECT page_id, pos, href, {absolute_rooted('base', 'href')} AS url, {clean(unescaped("regexp_replace(regexp_replace(tag, '(?is)^<a\\s[^>]*>|</a>$', '', 'g'), '<[^>]*>', ' ', 'g')"))} AS text, base FROM (
        SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, tag, base, {unescaped(f"coalesce(nullif(regexp_extract(tag, '{href}', 1), ''), nullif(regexp_extract(tag, '{href}', 2), ''), nullif(regexp_extract(tag, '{href}', 3), ''))")} AS href FROM (
            SELECT page_id, url AS base, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all({bare_html}, '(?is)<a\\s[^>]*>.*?</a>') AS tags FROM {pages})))
        WHERE href IS NOT NULL)"""
