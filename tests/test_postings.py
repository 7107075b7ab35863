import json

import pytest

from gleaner.operators import markup, vendors

PAGES = "page_id bigint, url string, html string, company_name string, platform string, career_page_url string"


def _pages(spark, *htmls, platform="Generic HTML"):
    return spark.createDataFrame([(i, f"https://acme.com/careers/{i}", h, "Acme", platform, "https://acme.com") for i, h in enumerate(htmls)], PAGES)


def _found(df):
    return sorted((r.job_title, r.job_url, r.location) for r in df.collect())


def test_ways_to_read_a_page(spark):
    ld = json.dumps({"@graph": [{"@type": "JobPosting", "title": "Welder", "url": "/j/1", "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX"}}}]})
    card = lambda n: f'<li class="job"><a href="/jobs/{n}">Engineer {n}</a><span class="location">London, UK</span></li>'
    pages = _pages(spark, f'<script type="application/ld+json">{ld}</script>', "<ul>" + "".join(map(card, range(4))) + "</ul>", "<nav><a href='/about'>About us</a></nav>", "", None, "<<<li><a")
    got = _found(markup.extract_jobs(pages))
    assert ("Welder", "https://acme.com/j/1", "Austin, TX") in got
    assert [x for x in got if x[0] != "Welder"] == [(f"Engineer {n}", f"https://acme.com/jobs/{n}", "London, UK") for n in range(4)]


@pytest.mark.parametrize("label,url,body,wanted", [
    ("Greenhouse", "https://boards.greenhouse.io/acme", {"jobs": [{"title": "A", "absolute_url": "https://x/1", "location": {"name": "Paris, France"}}]}, [("A", "https://x/1", "Paris, France")]),
    ("Lever", "https://jobs.lever.co/acme", [{"text": "B", "hostedUrl": "https://x/2", "categories": {"location": "Remote"}}], [("B", "https://x/2", "Remote")]),
    ("BambooHR", "https://acme.bamboohr.com/careers", {"result": [{"id": "7", "jobOpeningName": "C", "location": {"city": "Lindon", "state": "Utah"}}]}, [("C", "https://acme.bamboohr.com/careers/7", "Lindon, Utah")]),
    ("Ashby", "https://jobs.ashbyhq.com/acme", {"jobs": [{"title": "D", "jobUrl": "https://x/4", "location": "Oslo", "secondaryLocations": [{"location": "Rome"}]}]}, [("D", "https://x/4", "Oslo | Rome")]),
    ("Lever", "https://jobs.lever.co/acme", {"no": "list"}, []),
])
def test_payloads(spark, label, url, body, wanted):
    rows = spark.createDataFrame([(url, "Acme", 0, json.dumps(body)), (url, "Acme", 1, "not json"), (url, "Acme", 2, None)], "board_url string, company_name string, page_no bigint, body string")
    assert _found(vendors.api_postings(rows, label)) == wanted
