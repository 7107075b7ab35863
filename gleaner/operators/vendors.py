"""Vendors as data: how each one's board is named by its URL, and where its payloads and pages keep postings.

An entry of API_RULES reads a JSON body: `lists` are the paths that may hold the postings, in order; the other
fields are paths within a posting, of which the first with text counts, or ("join", separator, paths), or
("said", paths) for values of any shape. A URL is one of `urls`, else `template` with the board's parts and the
posting's id; `board` is the board's own URL.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gleaner.functions import texts, urls
from gleaner.functions.binding import bound, once
from gleaner.functions.lineage import cut
from gleaner.operators import dom
from gleaner.operators.jobs import FIELDS, first_jobs, first_stated, with_countries
from gleaner.operators.markup import chain, first_way, from_payloads, parsed, ways

# ---- fixed values: patterns of posting URLs on hosted boards (label, hosts, pattern, how its pages follow) ----
HOSTED_RULES = [
    ("ApplicantPro", ["applicantpro.com", "applicantpool.com"], r"/jobs/\d+", "next"),
    ("ApplicantStack", ["applicantstack.com"], r"/x/detail/", "next"),
    ("Avature", ["avature.net"], r"/careers/jobdetail/", "?jobOffset={10*i}"),
    ("Bullhorn", ["bullhornstaffing.com", "bullhorn.com", "bullhorncareerportal.com"], "", "one"),
    ("CareerPlug", ["careerplug.com"], r"/jobs/\d+", "next"),
    ("ClearCompany", ["clearcompany.com"], r"/careers/jobs/[0-9a-f]{8}-[0-9a-f]{4}", "next"),
    ("Fountain", ["fountain.com"], r"/positions/[\w\-]+", "next"),
    ("Gem", ["jobs.gem.com"], "", "next"),
    ("GoHire", ["gohire.io"], r"/j/[\w\-]+", "next"),
    ("Hireology", ["hireology.com"], r"/careers/\d+", "next"),
    ("Homerun", ["homerun.co"], "", "next"),
    ("HRMDirect", ["hrmdirect.com"], r"job-opening\.php|jobid=|req=", "next"),
    ("Indeed", ["indeed.com", "indeed.jobs"], r"/viewjob\?|/rc/clk\?|/job/", "one"),
    ("isolved", ["isolvedhire.com", "myisolved.com", "isolvedhcm.com"], r"/jobs?/\d+", "next"),
    ("JazzHR", ["applytojob.com", "jazzhr.com", "jazz.co"], r"/apply/[A-Za-z0-9]{4,}/[\w\-]+", "one"),
    ("JobScore", ["jobscore.com"], r"/jobs/[\w\-]+", "next"),
    ("Join.com", ["join.com"], r"/companies/[\w\-]+/\d+", "next"),
    ("NeoGov", ["governmentjobs.com", "neogov.com", "schooljobs.com"], r"/jobs/\d+", "?page={i}"),
    ("Oleeo", ["oleeo.com", "tal.net"], r"/candidate/(?:postings|so/pm)/\d+|/opp/\d+", "next"),
    ("Paycom", ["paycomonline.net", "paycomonline.com"], r"viewjobdetails", "one"),
    ("Paycor", ["recruitingbypaycor.com", "paycor.com", "newtonsoftware.com"], r"jobintroduction\.action", "one"),
    ("Paylocity", ["paylocity.com"], r"/recruiting/jobs/details/\d+", "one"),
    ("Radancy", ["radancy.com", "talentbrew.com", "tmpwebeng.com"], r"/job/\d+", "next"),
    ("Trakstar Hire", ["recruiterbox.com", "trakstar.com", "trakstarhire.com"], r"/jobs/[\w\-]+", "next"),
    ("SilkRoad", ["silkroad.com", "silkroad-eng.com"], r"fuseaction=app\.jobinfo|jobid=\d+", "next"),
    ("TalentReef", ["talentreef.com", "jobappnetwork.com"], "", "next"),
    ("Zoho Recruit", ["zohorecruit.com", "zohorecruit.eu", "zohorecruit.in", "zohorecruit.com.au"], r"/jobs/careers/\d+", "next"),
]

# ---- fixed values: layouts of vendors whose boards are read row by row ----
ROW_RULES = {
    "iCIMS": {"href": r"/jobs/\d+/", "row_class": "row|job", "place_class": "iCIMS_JobHeaderTag|JobLocation|job-location|location"},
    "Jobvite": {"href": r"/job/[A-Za-z0-9]", "row_tags": ["li", "tr", "div"], "place_class": "jv-job-list-location|jv-job-detail-location|location"},
    "Teamtailor": {"href": r"/jobs/\d+", "row_tags": ["li", "article", "div"], "place_class": "location|department|meta", "title_tags": ["h1", "h2", "h3", "h4", "span"]},
    "Dayforce": {"href": r"/Posting/View/\d+", "row_tags": ["li", "article", "div"], "place_class": "location|address|city"},
    "SAP SuccessFactors": {"href": "", "title_class": "jobTitle-link|jobTitle", "row_tags": ["tr", "li", "div"], "place_class": "jobLocation|jobFacility"},
}

# ---- fixed values: where the vendors' interfaces keep their postings ----
API_RULES = {
    "Workday": {"board": "https://{host}/{language}/{site}", "lists": ["$.jobPostings"], "title": ["title"], "urls": [], "id": ["externalPath"], "template": "https://{host}/{language}/{site}/{id}", "location": ["locationsText"]},
    "Greenhouse": {"board": "https://boards.greenhouse.io/{token}", "lists": ["$.jobs"], "title": ["title"], "urls": ["absolute_url"], "location": ["location.name", "location", ("each", ", ", "offices", "name")]},
    "Lever": {"board": "https://jobs.lever.co/{slug}", "lists": ["$"], "title": ["text"], "urls": ["hostedUrl", "applyUrl"], "location": ["categories.location", "workplaceType"]},
    "Ashby": {"board": "https://jobs.ashbyhq.com/{slug}", "lists": ["$.jobs"], "title": ["title"], "urls": ["jobUrl", "applyUrl"], "location": [("with", " | ", "location", "secondaryLocations", "location")]},
    "SmartRecruiters": {"board": "https://jobs.smartrecruiters.com/{company}", "lists": ["$.content"], "title": ["name"], "urls": [], "id": ["id"], "template": "https://jobs.smartrecruiters.com/{company}/{id}",
                        "location": [("join", ", ", ["location.city", "location.region", "upper:location.country"])], "country": ["code:location.country"]},
    "Recruitee": {"board": "https://{slug}.recruitee.com/", "lists": ["$.offers"], "title": ["title"], "urls": ["careers_url", "careers_apply_url", "url"], "location": ["location", ("join", ", ", ["city", "state_name|state_code", "country"])]},
    "Workable": {"board": "https://apply.workable.com/{account}", "lists": ["$.jobs", "$.results"], "title": ["title"], "urls": ["url", "application_url"], "id": ["shortcode"], "template": "https://apply.workable.com/{account}/j/{id}",
                 "location": [("join", ", ", ["city", "state", "country"]), ("join", ", ", ["locations[0].city", "locations[0].region", "locations[0].country"])]},
    "BambooHR": {"board": "https://{tenant}.bamboohr.com/careers", "lists": ["$.result"], "title": ["jobOpeningName", "title"], "urls": [], "id": ["id"], "template": "https://{tenant}.bamboohr.com/careers/{id}",
                 "location": [("join", ", ", ["location.city", "location.state", "location.country"]), "location"], "country": ["name:location.country"]},
    "UltiPro": {"board": "https://{host}/{tenant}/JobBoard/{board}", "lists": ["$.opportunities"], "title": ["Title"], "urls": [], "id": ["Id"], "template": "https://{host}/{tenant}/JobBoard/{board}/OpportunityDetail?opportunityId={id}",
                "location": ["Locations[0].LocalizedDescription", ("join", ", ", ["Locations[0].Address.City", "Locations[0].Address.State.Code|Locations[0].Address.State.Name", "Locations[0].Address.Country.Name"])], "more": "Locations"},
    "ADP": {"board": "https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid={cid}{cc}&lang=en_US", "lists": ["$.jobRequisitions"], "title": ["requisitionTitle"], "urls": [], "id": ["itemID", "itemId"],
            "template": "https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid={cid}{cc}&jobId={id}&lang=en_US",
            "location": [("counted", "requisitionLocations", [("join", ", ", ["address.cityName|cityName", "address.countrySubdivisionLevel1.codeValue|countrySubdivisionLevel1.codeValue", "address.countryCode|countryCode"]), "nameCode.shortName"])]},
    "Oracle": {"board": "https://{host}/hcmUI/CandidateExperience/en/sites/{site}/requisitions", "lists": ["$.items[0].requisitionList"], "title": ["Title"], "urls": [], "id": ["Id"], "template": "https://{host}/hcmUI/CandidateExperience/en/sites/{site}/job/{id}",
               "location": ["PrimaryLocation", "Location"], "also": "secondaryLocations"},
    "Taleo": {"board": "https://{host}/careersection/{section}/jobsearch.ftl", "lists": ["$.requisitionList"], "title": ["jobTitle", "column[0]"], "urls": [], "id": ["contestNo", "jobId"], "template": "https://{host}/careersection/{section}/jobdetail.ftl?job={id}", "location": [("place", "column")]},
    "BreezyHR": {"board": "https://{tenant}.breezy.hr", "lists": ["$", "$.positions", "$.jobs", "$.data"], "title": ["name", "title"], "urls": ["url"], "id": ["id"], "template": "https://{tenant}.breezy.hr/p/{id}",
                 "location": ["location.name", ("join", ", ", ["location.city", "location.state", "location.country.name|location.country"]), ("said", ["location"])], "country": ["location.country.name", "location.country"]},
    "Rippling": {"board": "https://ats.rippling.com/{slug}/jobs", "lists": ["$", "$.jobs", "$.results", "$.data"], "title": ["name", "title"], "urls": ["url"], "id": ["uuid", "id"], "template": "https://ats.rippling.com/{slug}/jobs/{id}",
                 "location": [("said", ["workLocation", "location", "locations", "workLocations"])]},
    "Pinpoint": {"board": "https://{tenant}.pinpointhq.com", "lists": ["$", "$.data", "$.postings", "$.jobs"], "title": ["title", "name"], "urls": ["url", "public_url"],
                 "location": ["location.name", ("join", ", ", ["location.city", "location.region", "location.country"]), "location", "location_name"], "country": ["location.country", "country"]},
    "Comeet": {"board": "https://www.comeet.co/jobs/{uid}", "lists": ["$", "$.positions", "$.data"], "title": ["name", "title"], "urls": ["url_active_page", "url_comeet_hosted_page"],
               "location": ["location.name", ("join", ", ", ["location.city", "location.state", "location.country"]), "location"], "country": ["location.country"]},
    "Manatal": {"board": "https://{slug}.manatal.com", "lists": ["$.results"], "title": ["position_name", "title"], "urls": ["url", "job_url", "public_url", "career_page_url"], "http": True, "id": ["hash", "uuid", "id"],
                "template": "https://{slug}.manatal.com/job/{id}", "location": [("said", ["location"])], "country": [("said", ["country"])]},
    "Eightfold": {"board": "{origin}/careers", "lists": ["$.positions"], "title": ["name", "title"], "urls": ["canonicalPositionUrl"], "id": ["id", "pid"], "template": "{origin}/careers?pid={id}",
                  "location": [("said", ["location", "locations", "work_location", "displayLocation"])]},
    "Phenom": {"board": "{url}", "lists": ["$.refineSearch.data.jobs", "$.eagerLoadRefineSearch.data.jobs", "$.data.jobs", "$.jobs"], "title": ["title", "jobTitle"], "urls": ["jobSeoUrl", "applyUrl", "jobUrl"], "relative": True,
               "location": [("said", ["cityStateCountry", "cityState", "location", "locations", "city"])]},
    "Cornerstone": {"board": "{origin}/ux/ats/careersite/{site}/home", "lists": ["$.data.requisitions", "$.data.jobs", "$.data.results", "$.requisitions", "$.jobs", "$.results"], "title": ["displayJobTitle", "jobTitle", "title"], "urls": [], "id": ["requisitionId", "id"],
                    "template": "{origin}/ux/ats/careersite/{site}/job/{id}", "location": [("said", ["locations", "location", "displayLocation", "locationName", "city"])]},
    "UKG Ready": {"board": "{origin}/ta/{company}.careers", "lists": ["$.job_requisitions"], "title": ["job_title"], "urls": [], "id": ["id"], "template": "{origin}/ta/{company}.careers?ApplyToJob={id}",
                  "location": [("join", ", ", ["location.city", "location.state", "location.country"]), "location"]},
    "Asure": {"board": "{origin}/ta/{company}.careers", "lists": ["$.job_requisitions"], "title": ["job_title"], "urls": [], "id": ["id"], "template": "{origin}/ta/{company}.careers?ApplyToJob={id}",
              "location": [("join", ", ", ["location.city", "location.state", "location.country"]), "location"]},
    "Personio": {"board": "{origin}", "xml": True, "title": ["name"], "urls": [], "id": ["id"], "template": "{origin}/job/{id}", "location": ["office", "location", "city", "subcompany"]},
    "ADP Recruiting Management": {"board": "{url}", "shape": True, "template": "{origin}/{slug}/cx/job-details?reqId={id}", "id": ["reqid", "clientrequisitionid", "id"]},
}


def _not_in(steps: Column, *reserved: str) -> Column:
    """The first step that isn't one of the vendor's own words; null if none is left."""
    return F.try_element_at(F.filter(steps, lambda s: ~F.lower(s).isin(*reserved) if reserved else s != ""), F.lit(1))


def _after(steps: Column, word: str, away: int = 1) -> Column:
    """The step that stands so far after the first `word` (before it, if negative)."""
    at = F.array_position(F.transform(steps, F.lower), word)
    return F.when(at > 0, F.get(steps, (at - 1 + away).cast("int")))


def _label(host: Column, *reserved: str) -> Column:
    first = F.substring_index(host, ".", 1)
    return F.when((first != "") & ~first.isin(*reserved), first) if reserved else F.nullif(first, F.lit(""))


def board_parts(url: Column) -> dict[str, dict[str, Column]]:
    """The parts of each vendor's board that a URL names; a part that it needs and that is null makes the URL unusable."""
    u = F.when(F.coalesce(F.trim(url), F.lit("")) == "", F.lit(None)).when(url.contains("://"), F.trim(url)).otherwise(F.concat(F.lit("https://"), F.trim(url)))
    host, steps, q = urls.host_of(u), urls.segments(u), lambda *names: F.coalesce(*[F.nullif(urls.parameter(u, n), F.lit("")) for n in names])
    origin = F.when(host != "", F.concat(urls.scheme(u), F.lit("://"), host))
    named = F.nullif(host, F.lit(""))
    under = lambda *domains: F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    slug = lambda c, pattern="^[a-z0-9][a-z0-9._-]*$": F.when(F.lower(c).rlike(pattern), c)
    language = F.when((F.size(steps) > 1) & F.get(steps, F.lit(0)).rlike("^[a-z]{2}(?:-[A-Za-z]{2})?$"), F.get(steps, F.lit(0)))
    cut = F.array_position(F.transform(steps, F.lower), "job")
    site_steps = F.when(cut > 0, F.slice(steps, F.lit(1), F.greatest(cut.cast("int") - 1, F.lit(0)))).otherwise(steps)
    site_steps = F.when(language.isNotNull() & (F.size(site_steps) > 1), F.slice(site_steps, F.lit(2), F.size(site_steps))).otherwise(site_steps)
    api = (F.size(steps) >= 4) & (F.get(steps, F.lit(0)) == "wday") & (F.get(steps, F.lit(1)) == "cxs")
    recruiting = F.lower(F.get(site_steps, F.lit(0))) == "recruiting"
    workday = under("myworkdayjobs.com", "myworkdaysite.com", "myworkday.com")
    pick = lambda i, j, k: F.when(workday, F.when(api, F.get(steps, F.lit(i))).when(recruiting, F.get(site_steps, F.lit(j))).otherwise(k))
    cc = q("ccId", "ccid")
    return {
        "Workday": {"host": F.when(workday, host), "tenant": pick(2, 1, F.substring_index(host, ".", 1)), "site": pick(3, 2, F.get(site_steps, F.lit(0))), "language": F.when(api, "en-US").otherwise(F.coalesce(language, F.lit("en-US")))},
        "Greenhouse": {"token": F.coalesce(slug(q("for"), "^[a-z0-9][a-z0-9_-]*$"), slug(q("token"), "^[a-z0-9][a-z0-9_-]*$"), slug(q("board"), "^[a-z0-9][a-z0-9_-]*$"),
                                           slug(_not_in(steps, "embed", "job_board", "jobs", "job", "boards", "v1", "api"), "^[a-z0-9][a-z0-9_-]*$"), _label(host, "boards", "job-boards", "www"))},
        "Lever": {"slug": _not_in(steps, "v0", "postings", "api", "jobs")},
        "Ashby": {"slug": _not_in(steps, "posting-api", "job-board", "api", "embed")},
        "SmartRecruiters": {"company": F.coalesce(_not_in(steps, "v1", "companies", "postings", "api", "jobs", "search"), _label(host, "jobs", "careers", "www", "api"))},
        "Recruitee": {"slug": F.coalesce(F.when(host.contains("recruitee.com"), _label(host, "jobs", "careers", "www", "api", "app")), _not_in(steps, "o", "api", "offers", "jobs"))},
        "Workable": {"account": F.coalesce(_label(host, "apply", "www", "jobs", "careers"), _not_in(steps, "api", "v1", "v3", "widget", "accounts", "j", "jobs", "search", "browse", "companies"))},
        "BambooHR": {"tenant": F.coalesce(F.when(host.contains("bamboohr"), _label(host, "www", "app", "api", "jobs", "careers")), q("subdomain", "company", "account"))},
        "UltiPro": {"host": named, "tenant": _after(steps, "jobboard", -1), "board": _after(steps, "jobboard", 1)},
        "ADP": {"cid": F.when(~host.contains("myjobs.adp.com"), q("cid")), "cc": F.coalesce(F.concat(F.lit("&ccId="), cc), F.lit(""))},
        "Oracle": {"host": named, "site": _after(steps, "sites")},
        "Taleo": {"host": named, "section": F.when(_after(steps, "careersection").endswith(".ftl"), "").otherwise(F.coalesce(_after(steps, "careersection"), F.lit("")))},
        "BreezyHR": {"tenant": F.when(host.endswith("breezy.hr"), slug(_label(host, "www", "app", "breezy", "api"), "^[a-z0-9][a-z0-9-]*$"))},
        "Rippling": {"slug": slug(_not_in(steps, "jobs", "job", "board", "boards", "ats", "careers"))},
        "Pinpoint": {"tenant": F.when(host.endswith("pinpointhq.com"), slug(_label(host, "www", "app", "api", "admin"), "^[a-z0-9][a-z0-9-]*$"))},
        "Comeet": {"uid": F.coalesce(F.try_element_at(F.filter(steps, lambda s: s.rlike(r"(?i)^\d+\.[0-9A-Z]{2,6}$")), F.lit(1)), q("uid", "company"))},
        "Manatal": {"slug": F.coalesce(F.when(host.endswith("manatal.com"), slug(_label(host, "www", "api", "app", "careers", "career", "jobs", "job", "open"))),
                                       slug(_not_in(steps, "www", "api", "app", "careers", "career", "jobs", "job", "open")))},
        "Eightfold": {"origin": origin},
        "Phenom": {"origin": origin},
        "Cornerstone": {"origin": origin, "site": F.coalesce(F.nullif(F.regexp_extract(urls.path_of(u), r"(?i)/careersite/(\d+)", 1), F.lit("")), q("site"))},
        "UKG Ready": {"origin": F.when(under("saashr.com"), origin), "company": F.nullif(F.regexp_extract(urls.path_of(u), r"(?i)/ta/(\d+)\b", 1), F.lit(""))},
        "Asure": {"origin": F.when(under("entertimeonline.com", "asuresoftware.com"), origin), "company": F.nullif(F.regexp_extract(urls.path_of(u), r"(?i)/ta/(\d+)\b", 1), F.lit(""))},
        "Personio": {"origin": F.when(host.contains("personio.") & _label(host, "www", "jobs", "api", "app").rlike("^[a-z0-9][a-z0-9-]*$"), F.concat(F.lit("https://"), host))},
        "ADP Recruiting Management": {"origin": F.when(under("myjobs.adp.com"), F.concat(urls.scheme(u), F.lit("://"), urls.authority(u))), "slug": F.nullif(F.regexp_extract(urls.path_of(u), "^/([^/]+)/", 1), F.lit(""))},
    }


def board_url_error(url: Column, hosts: list[str]) -> Column:
    """Why a URL isn't a hosted board of a vendor: blank, without a host, or on another host; null if it is one."""
    u = F.when(F.trim(url).contains("://"), F.trim(url)).otherwise(F.concat(F.lit("https://"), F.trim(url)))
    host = urls.host_of(u)
    own = F.exists(F.array(*map(F.lit, hosts)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "no URL").when(host == "", "no host").when(~own, "another host")


def _text(posting: Column, path: str) -> Column:
    """A field's text; objects and lists have none, so that a path to a part of them can follow."""
    kind, _, name = path.rpartition(":")
    if "|" in name:
        return F.coalesce(*[_text(posting, x) for x in name.split("|")])
    value = texts.clean(F.get_json_object(posting, f"$.{name}"))
    value = F.when(~value.rlike(r"^[\[{]") & (value != ""), value)
    if kind == "upper":
        return F.upper(value)
    if kind == "code":
        return F.when(F.lower(value) == "us", "United States").when(F.lower(value).isin("gb", "uk"), "United Kingdom")
    if kind == "name":
        return F.when(F.lower(value).isin("united states", "usa", "us"), "United States").otherwise(value)
    return value


def _members(posting: Column, path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(posting, f"$.{path}"), "array<string>"), F.array().cast("array<string>"))


def _first_text(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))


def _plain(value: Column) -> Column:
    text = texts.clean(value)
    return F.when(~text.rlike(r"^[\[{]") & ~text.isin("", "true", "false", "null"), text)


@F.pandas_udf(StringType())
def _deep_text(values: pd.Series) -> pd.Series:
    """dom.text_of of JSON objects and lists, however deep; null for what isn't JSON."""
    return values.map(lambda v: None if v is None else dom.text_of(dom.decoded(v)))


def _said(value: Column) -> Column:
    """The text of any JSON value: of an object its address or what names it, of a list its first six different members."""
    return F.coalesce(_plain(value), F.nullif(_deep_text(F.when(value.rlike(r"^[\[{]"), value)), F.lit("")))


@F.pandas_udf(StructType([StructField("error", StringType()), StructField("items", ArrayType(StringType()))]))
def _feed_items(bodies: pd.Series) -> pd.DataFrame:
    """Postings of a feed as JSON objects, from the elements `position` at any depth; or why it can't be read."""
    rows = []
    for body in bodies:
        try:
            rows.append((None, [json.dumps(x) for x in dom.elements(body or "", "position")]))
        except ValueError as e:
            rows.append((str(e), None))
    return pd.DataFrame(rows, columns=["error", "items"])


def _field(posting: Column, rule: str | tuple) -> Column:
    if isinstance(rule, str):
        return _text(posting, rule)
    kind = rule[0]
    if kind == "join":
        parts = F.array(*[_text(posting, p) for p in rule[2]])
        return F.nullif(F.array_join(F.filter(parts, lambda x: x.isNotNull()), rule[1]), F.lit(""))
    if kind == "each":
        names = F.transform(_members(posting, rule[2]), lambda m: _text(m, rule[3]))
        return F.nullif(F.array_join(F.filter(names, lambda x: x.isNotNull()), rule[1]), F.lit(""))
    if kind == "said":
        return F.coalesce(*[_said(F.get_json_object(posting, f"$.{p}")) for p in rule[1]])
    if kind == "counted":
        told = F.filter(F.transform(_members(posting, rule[1]), lambda m: F.coalesce(*[_field(m, r) for r in rule[2]])), lambda x: x.isNotNull())
        return bound(told, lambda x: F.when(F.size(x) > 1, F.concat(F.get(x, F.lit(0)), F.lit(" (+"), (F.size(x) - 1).cast("string"), F.lit(" more)"))).otherwise(F.get(x, F.lit(0))))
    if kind == "with":
        more = F.transform(_members(posting, rule[3]), lambda m: F.coalesce(_text(m, rule[4]), F.when(~m.startswith("{"), F.trim(m))))
        return F.nullif(F.array_join(F.array_distinct(F.filter(F.concat(F.array(_text(posting, rule[2])), more), lambda x: x.isNotNull() & (x != ""))), rule[1]), F.lit(""))
    # the first value after the title that reads like a place and isn't a date
    values = F.filter(F.slice(_members(posting, rule[1]), F.lit(2), F.size(_members(posting, rule[1]))), lambda v: ~v.rlike(r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}$") & v.rlike("[A-Za-z]{2,},|[A-Za-z]{4,}"))
    return F.try_element_at(values, F.lit(1))


def _first(posting: Column, rules: list) -> Column:
    return F.coalesce(*[_field(posting, r) for r in rules], F.lit("")) if rules else F.lit("")


def _filled(template: str, parts: dict[str, Column], identity: Column | None = None) -> Column:
    """A template with the board's parts and the posting's id; null for an id without text."""
    pieces: list[Column] = []
    for chunk in template.replace("}", "{").split("{"):
        pieces.append(identity if chunk == "id" and identity is not None else parts[chunk] if chunk in parts else F.lit(chunk))
    return F.concat(*pieces) if identity is None else F.when(identity != "", F.concat(*pieces))


def _usable(payloads: DataFrame, parts: dict[str, Column]) -> DataFrame:
    usable = F.lit(True)
    for part in parts.values():
        usable = usable & part.isNotNull()
    return payloads.where(usable)


def parts_of(url: Column, label: str, rule: dict) -> dict[str, Column]:
    """The parts of a board's URL: a rule's own patterns (name -> pattern with one group), else what the vendor is known for."""
    if "parts" in rule:
        return {name: F.nullif(F.regexp_extract(F.trim(url), pattern, 1), F.lit("")) for name, pattern in rule["parts"].items()} | {"url": F.trim(url)}
    parts = once("parts of board_url", lambda: board_parts(F.col("board_url"))) if str(url) == str(F.col("board_url")) else board_parts(url)
    return parts[label] | {"url": F.trim(url)}


def api_postings(payloads: DataFrame, label: str, keep: list[str] | None = None, rule: dict | None = None, countries: bool = True) -> DataFrame:
    """Postings of captured bodies(board_url, company_name, page_no, body) of one vendor, of repeats the first.

    Bodies that aren't JSON (or XML, for a feed), or hold no list where the vendor keeps it, and boards whose URL
    doesn't name the vendor's parts, yield nothing: see api_errors. Columns `keep` are carried, and tell boards apart.
    """
    rule, keep = rule or API_RULES[label], keep or []
    first = lambda raw: (first_jobs if countries else first_stated)(raw, ["page_no", "seq"], ["career_page_url", *keep], ["page_no", "seq", *keep])
    parts = parts_of(F.col("board_url"), label, rule)
    board = _filled(rule["board"], parts).alias("career_page_url")
    named = _usable(payloads, parts)
    if rule.get("shape"):
        return first(_by_shape(named, label, rule, parts, board, keep))
    if rule.get("xml"):
        found = _feed_items(F.col("body"))["items"]
    else:
        found = F.coalesce(*[F.from_json(F.when(F.get_json_object("body", p).startswith("["), F.get_json_object("body", p)), "array<string>") for p in rule["lists"]])
    rows = named.select("company_name", "board_url", "page_no", *keep, F.posexplode(found).alias("seq", "posting"))
    p = F.col("posting")
    own = F.coalesce(*[_text(p, x) for x in rule["urls"]]) if rule["urls"] else F.lit(None).cast("string")
    if rule.get("http"):
        own = F.coalesce(*[F.when(_text(p, x).startswith("http"), _text(p, x)) for x in rule["urls"]])
    if rule.get("relative"):
        own = urls.absolute(parts["origin"], own)
    if "template" in rule:
        own = F.coalesce(own, _filled(rule["template"], parts, F.regexp_replace(_first(p, rule["id"]), "^/+", "")))
    place = _first(p, rule["location"])
    for name, less in (("more", 1), ("also", 0)):
        if name in rule:
            others = F.size(_members(p, rule[name])) - less
            place = F.when((others > 0) & (place != ""), F.concat(place, F.lit(" (+"), others.cast("string"), F.lit(" more)"))).otherwise(place)
    raw = rows.select(
        "page_no", "seq", *keep, "company_name", board, F.lit(label).alias("platform"), _first(p, rule["title"]).alias("title"),
        F.coalesce(own, F.lit("")).alias("url"), place.alias("location"), _first(p, rule.get("country", [])).alias("country"))
    return first(raw)


def _by_shape(named: DataFrame, label: str, rule: dict, parts: dict[str, Column], board: Column, keep: list[str]) -> DataFrame:
    """Rows for build_jobs of bodies whose postings are told by the keys that their objects share."""
    key = F.xxhash64("board_url", "page_no", *keep)
    pages = named.select(key.alias("page_key"), F.col("page_no").alias("page_id"), F.col("board_url").alias("url"), "company_name", F.lit(label).alias("platform"), board, F.lit(0).alias("pos"), "body", *keep)
    link = _filled(rule["template"], parts_of(F.col("url"), label, rule), F.col("identity"))
    found = from_payloads(pages, rule["id"], F.coalesce(link, F.lit("")))
    if keep:
        found = found.join(pages.select("page_key", *keep).distinct(), "page_key")
    return found.select(F.col("page_id").alias("page_no"), F.col("pos").alias("seq"), *keep, "company_name", "career_page_url", "platform", "title", "url", "location", "country")


def api_errors(payloads: DataFrame, label: str, keep: list[str] | None = None, rule: dict | None = None) -> DataFrame:
    """(board_url, page_no, error): what api_postings can't read, with the columns `keep`."""
    rule = rule or API_RULES[label]
    bad_url = F.lit(False)
    for part in parts_of(F.col("board_url"), label, rule).values():
        bad_url = bad_url | part.isNull()
    lists = F.lit(False)
    for p in rule.get("lists", []):
        lists = lists | F.coalesce(F.get_json_object("body", p).startswith("["), F.lit(False))
    error = F.when(bad_url, "AdapterUrlError: not a board of this vendor")
    if rule.get("lists"):
        error = error.when(F.try_parse_json("body").isNull(), "AdapterHttpError: the body isn't JSON").when(~lists, "AdapterHttpError: the body holds no list of postings")
    elif rule.get("xml"):
        error = error.when(_feed_items(F.col("body"))["error"].isNotNull(), "AdapterHttpError: the body isn't XML")
    else:
        error = error.when(F.try_parse_json("body").isNull(), "AdapterHttpError: the body isn't JSON")
    return payloads.select("board_url", "page_no", *(keep or []), error.alias("error")).where("error is not null")


# ---- fixed values: the answers that a vendor's boards may give, the better first, and whether a page stands in for none ----
VERSIONS = {
    "Workable": {"order": ["widget", "v3"], "lists": {"widget": ["$.jobs"], "v3": ["$.results"]}, "page": False},
    "Cornerstone": {"order": ["v2", "v1"], "lists": {}, "page": True},
    "Phenom": {"order": ["widget"], "lists": {}, "page": True},
    "Taleo": {"order": ["rest"], "lists": {}, "page": True},
}
PAGE = "page"


def versioned_postings(payloads: DataFrame, pages: DataFrame, label: str, rule: dict | None = None, versions: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (board_url, version, place, posting fields) and status (board_url, version, jobs, error) of boards that answer in several versions.

    payloads(board_url, company_name, version, page_no, body, error), pages(page_id, url, html, company_name, platform, career_page_url). The
    choice is made for a whole board, never row by row: the first version all of whose bodies can be read; where a page may
    stand in, one that tells postings, else the board's page. A board that no version and no page tells has the first error.
    """
    rule, versions = rule or API_RULES[label], versions or VERSIONS[label]
    payloads = cut(payloads.where(F.col("version").isin(versions["order"])))
    rank = F.array_position(F.array(*map(F.lit, versions["order"])), F.col("version"))
    found, wrong = [], [payloads.where("error is not null").select("board_url", "version", "page_no", "error")]
    for v in versions["order"]:
        shaped = rule | ({"lists": versions["lists"][v]} if v in versions["lists"] else {})
        bodies = payloads.where((F.col("version") == v) & F.col("error").isNull())
        found.append(api_postings(bodies, label, ["board_url", "version"], shaped, countries=False))
        wrong.append(api_errors(bodies, label, ["version"], shaped).select("board_url", "version", "page_no", "error"))
    postings, errors = cut(reduce(DataFrame.unionByName, found)), cut(reduce(DataFrame.unionByName, wrong))
    counts = postings.groupBy("board_url", "version").agg(F.count("*").alias("jobs"))
    sound = payloads.select("board_url", "version").distinct().join(errors.select("board_url", "version"), ["board_url", "version"], "left_anti").join(counts, ["board_url", "version"], "left").fillna(0, ["jobs"])
    chosen = cut((sound.where("jobs > 0") if versions["page"] else sound).groupBy("board_url").agg(F.min_by(F.struct("version", "jobs"), rank).alias("x")).select("board_url", "x.*"))
    place = F.col("page_no").cast("bigint") * F.lit(1 << 32) + F.col("seq")
    rows = postings.join(chosen.select("board_url", "version"), ["board_url", "version"]).select("board_url", "version", place.alias("place"), *FIELDS)
    boards = payloads.select("board_url").unionByName(pages.select(F.col("url").alias("board_url"))).distinct()
    if versions["page"]:
        still = pages.join(chosen.select(F.col("board_url").alias("url")), "url", "left_anti")
        read = first_way(ways(parsed(still))).join(pages.select("page_id", F.col("url").alias("board_url")), "page_id")
        read = cut(read.select("board_url", F.lit(PAGE).alias("version"), (F.col("rank") * F.lit(1 << 44) + F.col("pos")).alias("place"), *FIELDS))
        rows = rows.unionByName(read)
        chosen = chosen.unionByName(read.groupBy("board_url", "version").agg(F.count("*").alias("jobs")))
    first = errors.groupBy("board_url").agg(F.min_by("error", F.struct(rank.alias("rank"), "page_no")).alias("error"))
    empty = (sound if versions["page"] else sound.limit(0)).groupBy("board_url").agg(F.min_by("version", rank).alias("said_none"))
    told = boards.join(chosen, "board_url", "left").join(empty, "board_url", "left").join(first, "board_url", "left")
    # a version that was read and is empty isn't an error
    return with_countries(rows), told.select("board_url", F.coalesce("version", "said_none").alias("version"), F.coalesce("jobs", F.lit(0)).cast("bigint").alias("jobs"), F.when(F.coalesce("version", "said_none").isNull(), F.col("error")).alias("error"))


def hosted_postings(pages: DataFrame) -> DataFrame:
    """Postings of hosted boards' pages by their vendor's URL pattern (by `platform`), else by any page's ways."""
    return chain(parsed(pages), pattern_of(F.col("platform")))


def pattern_of(platform: Column, rules: list[tuple] | None = None) -> Column:
    """The pattern that a platform's posting URLs follow; null for one without."""
    pattern = F.lit(None).cast("string")
    for label, _, regex, _ in rules or HOSTED_RULES:
        if regex:
            pattern = F.when(platform == label, f"(?i){regex}").otherwise(pattern)
    return pattern


def eightfold_domain(url: Column, markup: Column) -> Column:
    """The tenant that an Eightfold board serves: named by its URL, else by its page, else guessed from its host; empty if nothing tells."""
    u = F.when(F.trim(url).contains("://"), F.trim(url)).otherwise(F.concat(F.lit("https://"), F.trim(url)))
    in_page = F.lower(F.regexp_extract(F.coalesce(markup, F.lit("")), r"(?i)[\"']domain[\"']\s*:\s*[\"']([a-z0-9][a-z0-9.\-]*\.[a-z]{2,})[\"']", 1))
    common = ["www", "careers", "jobs", "app", "api"]
    guessed = bound(urls.host_of(u), lambda host: F.when(
        host.endswith("eightfold.ai"), F.when(F.substring_index(host, ".", 1).isin(common), "").otherwise(F.concat(F.substring_index(host, ".", 1), F.lit(".com")))).otherwise(
        F.regexp_extract(F.regexp_replace(host, "^(?:(?:" + "|".join(common) + ")[.])+", ""), r"^.*[.].*$", 0)))
    return F.coalesce(F.nullif(F.lower(urls.parameter(u, "domain")), F.lit("")), F.nullif(in_page, F.lit("")), guessed)
