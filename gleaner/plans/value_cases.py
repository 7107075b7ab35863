"""Named queries over values written out by hand, laid out for every supplier, with what each must give: nothing here is taken from the tables of fixed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import places, platforms, texts, urls
from gleaner.plans.derived import supplier_keys
from gleaner.plans.oracles import text

Query = Callable[[SparkSession, str], DataFrame]

PLATFORMS = [
    ("https://acme.wd5.myworkdayjobs.com/en-US/External", "Workday"), ("acme.myworkdaysite.com/recruiting/acme/jobs", "Workday"), ("https://careers.example.com/wday/cxs/acme/x/jobs", "Workday"),
    ("https://boards.greenhouse.io/acme", "Greenhouse"), ("https://grnh.se/abc", "Greenhouse"), ("https://example.com/embed/job_board?for=acme", "Greenhouse"), ("https://jobs.lever.co/acme", "Lever"),
    ("https://jobs.ashbyhq.com/acme", "Ashby"), ("https://careers-acme.icims.com/jobs", "iCIMS"), ("https://recruiting.ultipro.com/ACM1/JobBoard/x", "UltiPro"), ("https://acme.rec.pro.ukg.net/x", "UKG"),
    ("https://careers.smartrecruiters.com/Acme", "SmartRecruiters"), ("https://career4.successfactors.com/career?company=acme", "SAP SuccessFactors"), ("https://example.com/careers?company=acme", "SAP SuccessFactors"),
    ("https://acme.taleo.net/careersection/ex/jobsearch.ftl", "Taleo"), ("https://eeho.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX", "Oracle"), ("https://jobs.jobvite.com/acme", "Jobvite"),
    ("https://acme.teamtailor.com/jobs", "Teamtailor"), ("https://acme.bamboohr.com/careers", "BambooHR"), ("https://acme.recruitee.com", "Recruitee"), ("https://apply.workable.com/acme", "Workable"),
    ("https://us.dayforcehcm.com/CandidatePortal/en-US/acme", "Dayforce"), ("https://acme.breezy.hr", "BreezyHR"), ("https://acme.applytojob.com/apply", "JazzHR"), ("https://acme.applicantpro.com", "ApplicantPro"),
    ("https://recruiting.paylocity.com/recruiting/jobs/All/x", "Paylocity"), ("https://www.paycomonline.net/v4/ats", "Paycom"), ("https://acme.avature.net/careers", "Avature"), ("https://acme.eightfold.ai/careers", "Eightfold"),
    ("https://jobs.gem.com/acme", "Gem"), ("https://ats.rippling.com/acme/jobs", "Rippling"), ("https://acme.jobs.personio.de", "Personio"), ("https://acme.pinpointhq.com", "Pinpoint"), ("https://www.comeet.com/jobs/acme/1.2", "Comeet"),
    ("https://acme.csod.com/ux/ats/careersite/1/home", "Cornerstone"), ("https://acme.zohorecruit.com/jobs", "Zoho Recruit"), ("https://www.governmentjobs.com/careers/acme", "NeoGov"), ("https://join.com/companies/acme", "Join.com"),
    ("https://acme.hrmdirect.com", "HRMDirect"), ("https://careers.jobscore.com/acme", "JobScore"), ("https://acme.clearcompany.com", "ClearCompany"), ("https://acme.careerplug.com", "CareerPlug"), ("https://acme.tal.net", "Oleeo"),
    ("https://workforcenow.adp.com/mascsr/x?cid=1", "ADP"), ("https://acme.isolvedhire.com", "isolved"), ("https://acme.silkroad.com", "SilkRoad"), ("https://jobs.gohire.io/acme", "GoHire"), ("https://acme.homerun.co", "Homerun"),
    # hosts of all vendors come before paths of any
    ("https://jobs.lever.co/wday/x", "Lever"), ("HTTPS://WWW.JOBS.LEVER.CO:443/Acme", "Lever"), ("https://user@jobs.lever.co./acme", "Lever"),
    # no vendor's host, though it looks like one
    ("https://notlever.co/acme", "Generic HTML"), ("https://lever.co.example.com", "Generic HTML"), ("https://example.com/?next=jobs.lever.co", "Generic HTML"), ("https://example.com/careers", "Generic HTML"),
    ("N/A", "Unknown"), ("", "Unknown"), ("tbd", "Unknown"), ("mailto:jobs@lever.co", "Unknown"), ("ftp://jobs.lever.co/x", "Unknown"), ("https://", "Unknown"), ("localhost", "Unknown"),
]
COUNTRIES = [
    ("Austin, TX", "United States"), ("Austin, TX 78701", "United States"), ("Albany, New York", "United States"), ("U.S.", "United States"), ("San Francisco, CA", "United States"), ("Berlin, DE", "United States"),
    ("Toronto, ON, Canada", "Canada"), ("Vancouver, BC", "Canada"), ("Remote - Canada", "Canada"), ("London, UK", "United Kingdom"), ("Edinburgh, Scotland", "United Kingdom"), ("Munich, Deutschland", "Germany"),
    ("Hybrid: Paris, France", "France"), ("Fully Remote in India", "India"), ("Bangalore, India; Pune, India", "India"), ("High Point, NC (main site)", "United States"), ("Austin, TX | Boston, MA", "United States"),
    ("Tel Aviv, Israel", "Israel"), ("Sao Paulo, Brasil", "Brazil"), ("Dubai, UAE", "United Arab Emirates"), ("Prague, Czechia", "Czech Republic"), ("Seoul, Korea", "South Korea"),
    ("Paris, France | Austin, TX", ""), ("Portland, OR", ""), ("3 Locations", ""), ("Multiple Locations", ""), ("Remote", ""), ("n/a", ""), ("", ""), ("CA", ""), ("Springfield", ""), ("Bath, Somewhere", ""),
]
SPLITS = [("Austin, TX | Boston, MA", "Austin, TX#Boston, MA"), ("Dublin or Paris; Rome / Oslo", "Dublin#Paris#Rome#Oslo"), ("Portland, OR", "Portland,"), ("Oregon City", "Oregon City"), ("", ""), (" ; ", "")]
TITLES = [
    ("Senior Engineer", True), ("R&D Lead, Data.", True), ("Ärztin", True), ("Applications Engineer", True), ("Viewer experience designer", True), ("Apply now", False), ("View job details", False), ("Learn more about jobs", False), ("12345", False),
    ("ab", False), ("  ", False), (" Careers ", False), ("Next", False), ("More info", False), ("x" * 161, False), ("x" * 160, True),
]
NORMALISED = [
    ("  https://a.example/x ", "https://a.example/x"), ('"a.example/x"', "https://a.example/x"), ("'//a.example'", "https://a.example"), ("a.example", "https://a.example"), ("mailto:x@a.example", "mailto:x@a.example"), ("", ""), (" ", ""),
    ("a.example/x:y", "https://a.example/x:y"), ("HTTP://A.example", "HTTP://A.example"),
]
REASONS = [
    ("no adapter for Gem", "no adapter for Gem"), ("AdapterHttpError: HTTP 403 for https://a.example.com/x?y=1 (forbidden)", "AdapterHttpError: HTTP 403 for <url>"), ("AdapterHttpError: HTTP 500 for https://b.example.com/z: 'oops'", "AdapterHttpError: HTTP 500 for <url> 'oops'"), ("AdapterHttpError: the body reads: 'oops' (x)", "AdapterHttpError: the body reads"),
    ("AdapterUrlError: this portal is rendered client-side", "AdapterUrlError: needs a browser"), ("WorkdayApiError: Human Verification page", "WorkdayApiError: anti-bot interstitial"), ("AdapterUrlError: legacy portal at https://c.example.com", "AdapterUrlError: legacy portal, no public endpoint"),
    ("TimeoutError: ", "TimeoutError"), ("ValueError", "ValueError"), ("KeyError: " + "k" * 90, "KeyError: " + "k" * 80),
]
ELAPSED = [("0", "0s"), ("59", "59s"), ("60", "1m 00s"), ("249", "4m 09s"), ("3849", "1h 04m 09s"), ("90061", "25h 01m 01s")]
ABSOLUTE = [
    ("/x", "https://a.example/x"), ("x", "https://a.example/d/x"), ("../x", "https://a.example/x"), ("?p=2", "https://a.example/d/e?p=2"), ("//b.example/y", "https://b.example/y"), ("https://b.example/", "https://b.example/"), ("./x/../y#z", "https://a.example/d/y#z"),
    ("#top", ""), ("", ""), ("javascript:go()", ""), ("MAILTO:x@y.example", ""), ("tel:1", ""),
]


def _cases(values: list[tuple], by: Callable[[Column], Column] | None) -> tuple[Query, str]:
    """Each value for every supplier's key; `by` is the expression that is held against what was written out (None: the platform)."""
    rows = [(str(v), w) for v, w in values]
    kind = "boolean" if isinstance(rows[0][1], bool) else "string"
    wanted = ", ".join(f"({text(v)}, {str(w).lower() if kind == 'boolean' else text(w)})" for v, w in rows)

    def run(s: SparkSession, sf: str) -> DataFrame:
        given = supplier_keys(s, sf).select("key", F.explode(F.array(*[F.lit(v) for v, _ in rows])).alias("value"))
        if by is None:
            return platforms.with_platform(given, "value", "found").select("key", "value", "found")
        return given.select("key", "value", by(F.col("value")).alias("found"))

    return run, f"SELECT s_suppkey AS key, value, found FROM supplier, (VALUES {wanted}) AS cases(value, found)"


_ALL = {
    "platform_cases": _cases(PLATFORMS, None),
    "country_cases": _cases(COUNTRIES, places.derive_country),
    "location_split_cases": _cases(SPLITS, lambda c: F.array_join(places.split_locations(c), "#")),
    "title_cases": _cases(TITLES, texts.looks_like_title),
    "url_cases": _cases(NORMALISED, urls.normalised),
    "absolute_url_cases": _cases(ABSOLUTE, lambda c: urls.absolute(F.lit("https://a.example/d/e?q=1"), c)),
    "reason_cases": _cases(REASONS, texts.reason_family),
    "elapsed_cases": _cases(ELAPSED, lambda c: texts.elapsed(c.cast("double"))),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
