"""Cases for the queries of readers: markup or a body with {k} for a key, and the postings in it, written out by hand.

A posting is (title, URL, location, country). Nothing here is taken from the tables or rules of the readers.
"""

from __future__ import annotations

from typing import NamedTuple


class Case(NamedTuple):
    source: str
    rows: list[tuple]
    url: str = ""
    platform: str = ""


ACME = "https://acme.example.com"


def _ld(body: str) -> str:
    return f'<html><script type="application/ld+json">{body}</script></html>'


LINKED_DATA = [
    Case(_ld('{"@type": "JobPosting", "title": "Welder {k}", "url": "/j/{k}", "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX"}}}'),
         [("Welder {k}", f"{ACME}/j/{{k}}", "Austin, TX", "United States")]),
    Case(_ld('{"@graph": [{"@type": "WebSite", "name": "Acme"}, {"@type": ["Thing", "JobPosting"], "title": "Joiner&nbsp; {k}", "url": "j/{k}",'
             ' "jobLocation": [{"address": [{"addressLocality": "Munich", "addressCountry": {"name": "Germany"}}]}, {"address": "Rome"}]}]}').replace("&nbsp;", "\\u00a0"),
         [("Joiner {k}", f"{ACME}/careers/j/{{k}}", "Munich, Germany", "Germany")]),
    Case(_ld('{"@type": "JobPosting", "title": }') + _ld('{"type": " jobposting ", "name": "Clerk {k}", "@id": "https://jobs.example.org/p/{k}", "jobLocation": {"address": "Paris, France"}}'),
         [("Clerk {k}", "https://jobs.example.org/p/{k}", "Paris, France", "France")]),
    Case(_ld('[{"@type": "JobPosting", "title": "Tutor {k}", "sameAs": "//jobs.example.org/t/{k}", "applicantLocationRequirements": {"name": "Canada"}},'
             ' {"@type": "JobPosting", "title": "Tutor again", "url": "HTTPS://JOBS.example.org/T/{k}"}, {"@type": "JobPosting", "title": "  ", "url": "/blank"},'
             ' {"@type": "JobPosting", "title": "No link"}, {"@type": "Person", "title": "Boss", "url": "/boss"}]'),
         [("Tutor {k}", "https://jobs.example.org/t/{k}", "Canada", "Canada")]),
    Case(_ld('{"@type": "JobPosting", "title": "Cook {k}", "url": "/c/{k}", "jobLocation": {"name": "Berlin, DE"}}'), [("Cook {k}", f"{ACME}/c/{{k}}", "Berlin, DE", "United States")]),
    Case("", []),
    Case("<script type='application/ld+json'><li", []),
]

MICRODATA = [
    Case('<div itemscope itemtype="https://schema.org/JobPosting"><h2 itemprop="title">Nurse <b>{k}</b></h2><a itemprop="url" href="/n/{k}">see</a><p itemprop="jobLocation">Leeds, UK</p></div>',
         [("Nurse {k}", f"{ACME}/n/{{k}}", "Leeds, UK", "United Kingdom")]),
    Case('<section itemtype="http://schema.org/jobPosting"><span itemprop="name">Chef {k}</span><a href="/x/{k}">more</a><i itemprop="addressLocality">Oslo</i><i itemprop="addressLocality">Rome</i></section>',
         [("Chef {k}", f"{ACME}/x/{{k}}", "Oslo", "")]),
    Case('<article itemtype="JobPosting"><meta itemprop="title" content=" Pilot {k} "><link itemprop="url" href="https://o.example.org/{k}"><meta itemprop="jobLocation" content="Toronto, ON">',
         [("Pilot {k}", "https://o.example.org/{k}", "Toronto, ON", "Canada")]),
    Case('<div itemtype="https://schema.org/Person"><b itemprop="name">Ann {k}</b><a href="/ann">her</a></div>', []),
    Case('<div itemtype="https://schema.org/JobPosting"><b itemprop="title">No link {k}</b></div>', []),
]

_LIST = "".join(f'<li class="job"><a href="/jobs/{{k}}-{n}">Fitter {n} of {{k}}</a><span class="location">Leeds, UK</span></li>' for n in range(4))
CARDS = [
    Case(f'<nav><a class="top" href="/jobs/all">Our promise to you</a></nav><ul>{_LIST}</ul>', [(f"Fitter {n} of {{k}}", f"{ACME}/jobs/{{k}}-{n}", "Leeds, UK", "United Kingdom") for n in range(4)]),
    Case('<p><a href="/job/a{k}">Porter {k}</a></p><div class="x"><a href="/job/b{k}">Driver {k}</a></div>', [("Porter {k}", f"{ACME}/job/a{{k}}", "", ""), ("Driver {k}", f"{ACME}/job/b{{k}}", "", "")]),
    Case("<table>" + "".join(f'<tr><td><a href="/jobs/{{k}}/{n}">Analyst {n} {{k}}</a><td>Austin, TX</tr>' for n in "abc") + "</table>", [(f"Analyst {n} {{k}}", f"{ACME}/jobs/{{k}}/{n}", "Austin, TX", "United States") for n in "abc"]),
    Case('<ul class="a">' + "".join(f'<li class="x"><a href="/jobs/x{n}/{{k}}">Cook {n} {{k}}</a>' for n in "abc") + '</ul><ol class="b">' + "".join(f'<li class="y"><a href="/jobs/y{n}/{{k}}">Baker {n} {{k}}</a>' for n in "abc") + "</ol>",
         [(f"Cook {n} {{k}}", f"{ACME}/jobs/x{n}/{{k}}", "", "") for n in "abc"]),
    Case('<ul><li><a href="/about">About us</a><li><a href="/jobs/">Jobs</a><li><a href="#jobs/1">Fragment {k}</a><li><a href="mailto:jobs/1@x.example">Mail {k}</a><li><a href="/jobs/12">12345</a></ul>', []),
    Case('<li class="job"><a href="/jobs/{k}">Clerk {k}</a><span class="city">Clerk {k}</span><span id="place">Oslo, Norway</span></li>', [("Clerk {k}", f"{ACME}/jobs/{{k}}", "Oslo, Norway", "Norway")]),
    Case("<<<li><a", []),
]

APPLY = [
    Case('<div class="box"><h3>Data Engineer {k}</h3><a href="/jobs/{k}/apply">Apply now</a><span class="location">Oslo, Norway</span></div>', [("Data Engineer {k}", f"{ACME}/jobs/{{k}}/apply", "Oslo, Norway", "Norway")]),
    Case("".join(f'<table><tr><td>Porter {n} {{k}}</td><td>Austin, TX</td><td><a href="/job/{n}{{k}}">View</a></td></tr></table>' for n in "ab"), [(f"Porter {n} {{k}}", f"{ACME}/job/{n}{{k}}", "Austin, TX", "United States") for n in "ab"]),
    Case('<ul><li><div class="job-title">Baker {k}</div><a href="/jobs/b{k}">View job</a><a href="/jobs/b{k}">Apply here</a></li></ul>', [("Baker {k}", f"{ACME}/jobs/b{{k}}", "", "")]),
    Case('<h2>Site Lead {k}</h2><ul><li><a href="/job/{k}/apply">Apply here</a></li></ul>', [("Site Lead {k}", f"{ACME}/job/{{k}}/apply", "", "")]),
    Case('<div><a href="/job/{k}">Apply</a><a href="/job/t{k}">Own title {k}</a></div>', []),
]

_STATE = '<script type="application/json">{}</script>'.format
_ONE = '{"title": "Planner {k}", "url": "/p/{k}", "location": "Leeds, UK", "department": "Ops"}'
_TWO = '{"title": "Buyer {k}", "url": "/p/b{k}", "location": {"city": "Austin", "state": "TX"}, "department": "Ops"}'
STATE = [
    Case(_STATE('{"jobs": [' + _ONE + ", " + _TWO + "]}"), [("Planner {k}", f"{ACME}/p/{{k}}", "Leeds, UK", "United Kingdom"), ("Buyer {k}", f"{ACME}/p/b{{k}}", "Austin, TX", "United States")]),
    Case('<script>window.__INITIAL_STATE__ = {"note": "a } brace and \\" mark", "list": [{"jobTitle": "Rigger {k}", "jobUrl": "https://j.example.org/{k}", "city": "Oslo", "country": "Norway"}]}; other()</script>',
         [("Rigger {k}", "https://j.example.org/{k}", "Oslo", "Norway")]),
    Case("""<div data-page='{"data": {"openings": [{"name": "Tutor {k}", "applyUrl": "/apply/{k}", "locations": ["Paris, France", "Lyon, France", "Paris, France"], "team": "T"}]}}'></div>""",
         [("Tutor {k}", f"{ACME}/apply/{{k}}", "Paris, France, Lyon, France", "France")]),
    Case('<div data-props="{&quot;jobs&quot;: [{&quot;title&quot;: &quot;Guard {k}&quot;, &quot;link&quot;: &quot;/g/{k}&quot;, &quot;shift&quot;: 1}]};"></div>', [("Guard {k}", f"{ACME}/g/{{k}}", "", "")]),
    Case('<div data-state="{&amp;quot;jobs&amp;quot;: [{&amp;quot;title&amp;quot;: &amp;quot;Warden {k}&amp;quot;, &amp;quot;link&amp;quot;: &amp;quot;/w/{k}&amp;quot;, &amp;quot;shift&amp;quot;: 1}]}"></div>', [("Warden {k}", f"{ACME}/w/{{k}}", "", "")]),
    Case('<script id="small">{"jobs": [{"title": "Small {k}", "url": "/small/{k}", "city": "Rome"}]}</script>' + _STATE('{"a": "' + "x" * 300 + '", "menu": [{"title": "Our shops", "href": "/shops"}]}') + _STATE('{"b": [' + ", ".join(
        '{"title": "Big ' + n + ' {k}", "url": "/big/{k}/' + n + '", "city": "Rome, Italy"}' for n in "abc") + "]}"), [(f"Big {n} {{k}}", f"{ACME}/big/{{k}}/{n}", "Rome, Italy", "Italy") for n in "abc"]),
    Case(_STATE('{"teams": [{"name": "Sales", "url": "/s", "location": "x"}], "rows": [{"Job-Title": "Miner {k}", "Detail_URL": "/m/{k}", "Office": {"name": "Perth"}}, {"Job-Title": "Smith {k}", "Detail_URL": "/s/{k}", "Office": null}]}'),
         [("Miner {k}", f"{ACME}/m/{{k}}", "Perth", ""), ("Smith {k}", f"{ACME}/s/{{k}}", "", "")]),
    Case(_STATE('{"items": [{"title": "Nanny {k}", "slug": "nanny", "permalink": {"href": "/n/{k}"}, "remote": true, "address": {"addressLocality": "Bonn", "addressCountry": {"name": "Germany"}}}]}'), [("Nanny {k}", f"{ACME}/n/{{k}}", "Bonn, Germany", "Germany")]),
    Case("<script>var jobsData = [{'bad': 1}]; var jobData = [{\"title\": \"Scout {k}\", \"href\": \"/s/{k}\", \"city\": \"Rome, Italy\"}]</script>", [("Scout {k}", f"{ACME}/s/{{k}}", "Rome, Italy", "Italy")]),
    Case(_STATE('{"jobs": [{"title": "Careers", "url": "/a", "city": "x"}, {"title": "A. B. C. D. E.", "url": "/b", "city": "x"}, {"title": "No link {k}", "city": "x"}, {"name": "Plain {k}", "href": "/c"}]}'), []),
    Case('<script type="application/json">[[[[</script><script src="/x.js">jobsData = []</script>', []),
]

CHAIN = [
    Case(LINKED_DATA[0].source + MICRODATA[0].source + CARDS[0].source, LINKED_DATA[0].rows),
    Case(_ld('{"@type": "JobPosting", "title": "No link"}') + MICRODATA[0].source + CARDS[0].source, MICRODATA[0].rows),
    Case(CARDS[0].source + _STATE('{"jobs": [' + _ONE + "]}"), CARDS[0].rows),
    Case(APPLY[0].source + STATE[0].source, APPLY[0].rows),
    Case("<p>none</p>" + STATE[0].source, STATE[0].rows),
    Case("<<<li><a", []), Case("", []), Case(CARDS[4].source, []),
]

_HREFS = {
    "ApplicantPro": ("https://a{k}.applicantpro.com/jobs/77", "/jobs/{n}{k}"),
    "ApplicantStack": ("https://a{k}.applicantstack.com/x/openings", "/x/detail/{n}{k}"),
    "Avature": ("https://a{k}.avature.net/careers", "/careers/JobDetail/Mason/{n}{k}"),
    "CareerPlug": ("https://a{k}.careerplug.com/", "/jobs/{n}{k}"),
    "ClearCompany": ("https://a{k}.clearcompany.com/careers/jobs", "/careers/jobs/0a1b2c{n}d-4e5f-{k}"),
    "Fountain": ("https://www.fountain.com/a{k}", "/a{k}/positions/mason-{n}"),
    "GoHire": ("https://jobs.gohire.io/a{k}", "/j/m{n}{k}"),
    "Hireology": ("https://careers.hireology.com/a{k}", "/a{k}/careers/{n}{k}"),
    "HRMDirect": ("https://a{k}.hrmdirect.com/", "/employment/job-opening.php?n={n}{k}"),
    "Indeed": ("https://www.indeed.com/cmp/a{k}", "/viewjob?jk={n}{k}"),
    "isolved": ("https://a{k}.isolvedhire.com/", "/job/{n}{k}"),
    "JazzHR": ("https://a{k}.applytojob.com/", "/apply/ab1{n}{k}/Mason"),
    "JobScore": ("https://careers.jobscore.com/a{k}", "/a{k}/jobs/mason-{n}"),
    "Join.com": ("https://join.com/companies/a{k}", "/companies/a{k}/{n}-mason"),
    "NeoGov": ("https://www.governmentjobs.com/careers/a{k}", "/careers/a{k}/jobs/{n}/mason"),
    "Oleeo": ("https://a{k}.tal.net/", "/candidate/so/pm/{n}{k}"),
    "Paycom": ("https://www.paycomonline.net/v4/ats", "/v4/ats/ViewJobDetails?job={n}{k}"),
    "Paycor": ("https://recruitingbypaycor.com/career/a{k}", "/career/JobIntroduction.action?id={n}{k}"),
    "Paylocity": ("https://recruiting.paylocity.com/recruiting/jobs/All/a{k}", "/Recruiting/Jobs/Details/{n}{k}"),
    "Radancy": ("https://a{k}.talentbrew.com/search", "/job/{n}{k}"),
    "Trakstar Hire": ("https://a{k}.hire.trakstar.com/", "/jobs/fk0{n}{k}"),
    "SilkRoad": ("https://a{k}.silkroad.com/epostings", "/epostings/index.cfm?fuseaction=app.jobinfo&amp;id={n}{k}"),
    "Zoho Recruit": ("https://a{k}.zohorecruit.com/jobs/careers", "/jobs/Careers/{n}{k}/mason"),
}


def _origin(url: str) -> str:
    return "/".join(url.split("/")[:3])


def _hosted(label: str, url: str, href: str) -> Case:
    one, two = href.replace("{n}", "1"), href.replace("{n}", "2")
    page = (f'<ul><li><a href="{one}">Mason {{k}}</a><span class="location">Leeds, UK</span></li><li><h3>Tiler {{k}}</h3><a href="{two}">View details</a></li>'
            f'<li><a href="/about-us">The firm {{k}}</a></li></ul><a href="{url}#top">Opening hours {{k}}</a>')
    full = [_origin(url) + x.replace("&amp;", "&") for x in (one, two)]
    return Case(page, [("Mason {k}", full[0], "Leeds, UK", "United Kingdom"), ("Tiler {k}", full[1], "", "")], url, label)


#: Boards without a pattern of their own are read like any page: the link that only says "View details" isn't one of its cards.
_PLAIN = {"Bullhorn": "https://a{k}.bullhornstaffing.com/", "Gem": "https://jobs.gem.com/a{k}", "Homerun": "https://a{k}.homerun.co/", "TalentReef": "https://a{k}.talentreef.com/"}
HOSTED = [_hosted(label, *x) for label, x in _HREFS.items()] + [
    Case('<li><a href="/jobs/1{k}">Mason {k}</a><span class="location">Leeds, UK</span></li><li><a href="/jobs/2{k}">View details</a></li>', [("Mason {k}", _origin(u) + "/jobs/1{k}", "Leeds, UK", "United Kingdom")], u, label)
    for label, u in _PLAIN.items()
] + [Case(LINKED_DATA[0].source, [("Welder {k}", "https://b{k}.gohire.io/j/{k}", "Austin, TX", "United States")], "https://b{k}.gohire.io/", "GoHire")]

ROWS = [
    Case('<div class="iCIMS_row"><div><a href="/jobs/1{k}/mason/job">Mason {k}</a></div><span class="JobLocation">Leeds, UK</span></div><div class="row"><a href="/jobs/2{k}/x/job"> </a></div>',
         [("Mason {k}", "https://a{k}.icims.com/jobs/1{k}/mason/job", "Leeds, UK", "United Kingdom")], "https://a{k}.icims.com/jobs/search?ss=1", "iCIMS"),
    Case('<table><tr><td><a href="/a{k}/job/oX{k}">Mason {k}</a></td><td class="jv-job-list-location">Leeds, UK</td></tr><tr><td><a href="/a{k}/job/oY{k}">Tiler {k}</a></td><td class="location">Tiler {k}</td></tr></table>',
         [("Mason {k}", "https://jobs.jobvite.com/a{k}/job/oX{k}", "Leeds, UK", "United Kingdom"), ("Tiler {k}", "https://jobs.jobvite.com/a{k}/job/oY{k}", "", "")], "https://jobs.jobvite.com/a{k}", "Jobvite"),
    Case('<ul><li><a href="/jobs/1{k}-mason"><i>new</i><span class="t">Mason {k}</span></a><div class="mt-1"><span class="meta">Leeds, UK</span></div></li></ul>',
         [("Mason {k}", "https://a{k}.teamtailor.com/jobs/1{k}-mason", "Leeds, UK", "United Kingdom")], "https://a{k}.teamtailor.com/jobs", "Teamtailor"),
    Case('<li><a href="/CandidatePortal/en-US/a/Posting/View/1{k}">Mason {k}</a><div class="address">Leeds, UK</div></li>',
         [("Mason {k}", "https://us.dayforcehcm.com/CandidatePortal/en-US/a/Posting/View/1{k}", "Leeds, UK", "United Kingdom")], "https://us.dayforcehcm.com/CandidatePortal/en-US/a{k}", "Dayforce"),
    Case('<table><tr><td><a class="jobTitle-link" href="/job/Mason/1{k}/">Mason {k}</a></td><td><span class="jobLocation">Leeds, UK</span></td></tr></table><a href="/job/Other/2{k}/">Other {k}</a>',
         [("Mason {k}", "https://jobs.a{k}.example.com/job/Mason/1{k}/", "Leeds, UK", "United Kingdom")], "https://jobs.a{k}.example.com/search/", "SAP SuccessFactors"),
    Case(LINKED_DATA[0].source, [("Welder {k}", "https://b.dayforcehcm.com/j/{k}", "Austin, TX", "United States")], "https://b.dayforcehcm.com/CandidatePortal/en-US/b{k}", "Dayforce"),
]

_UK, _US = "United Kingdom", "United States"
#: label -> (URL as captured, the board's own URL, bodies)
VENDORS = {
    "Workday": ("https://acme{k}.wd1.myworkdayjobs.com/fr-FR/Site/job/x", "https://acme{k}.wd1.myworkdayjobs.com/fr-FR/Site", [
        Case('{"total": 3, "jobPostings": [{"title": "Mason {k}", "externalPath": "/job/Leeds/Mason_{k}", "locationsText": "Leeds, UK"}, {"title": "", "externalPath": "/job/x"}, {"title": "No path"}, {"title": "Tiler {k}", "externalPath": "job/T_{k}", "locationsText": "2 Locations"}]}',
             [("Mason {k}", "https://acme{k}.wd1.myworkdayjobs.com/fr-FR/Site/job/Leeds/Mason_{k}", "Leeds, UK", _UK), ("Tiler {k}", "https://acme{k}.wd1.myworkdayjobs.com/fr-FR/Site/job/T_{k}", "2 Locations", "")]),
        Case('{"jobPostings": []}', []), Case("<html>", [])]),
    "Greenhouse": ("https://boards.greenhouse.io/embed/job_board?for=acme{k}", "https://boards.greenhouse.io/acme{k}", [
        Case('{"jobs": [{"title": " Mason  {k}", "absolute_url": "https://x.example/{k}", "location": {"name": "Leeds, UK"}}, {"title": "Twice", "absolute_url": "HTTPS://X.example/{k}"}, {"title": "Tiler {k}", "absolute_url": "https://x.example/t{k}", "location": "Austin, TX"}]}',
             [("Mason {k}", "https://x.example/{k}", "Leeds, UK", _UK), ("Tiler {k}", "https://x.example/t{k}", "Austin, TX", _US)]),
        Case('{"jobs": [{"title": "Smith {k}", "absolute_url": "https://x.example/s{k}", "offices": [{"name": "Oslo"}, {"name": ""}, {"name": "Paris, France"}]}]}', [("Smith {k}", "https://x.example/s{k}", "Oslo, Paris, France", "France")])]),
    "Lever": ("jobs.lever.co/acme{k}/1", "https://jobs.lever.co/acme{k}", [
        Case('[{"text": "Mason {k}", "hostedUrl": "https://x.example/{k}", "applyUrl": "https://x.example/a", "categories": {"location": "Leeds, UK"}}, {"text": "Tiler {k}", "applyUrl": "https://x.example/t{k}", "categories": {"team": "x"}, "workplaceType": "remote"}]',
             [("Mason {k}", "https://x.example/{k}", "Leeds, UK", _UK), ("Tiler {k}", "https://x.example/t{k}", "remote", "")]), Case('{"no": "list"}', [])]),
    "Ashby": ("https://jobs.ashbyhq.com/acme{k}", "https://jobs.ashbyhq.com/acme{k}", [
        Case('{"jobs": [{"title": "Mason {k}", "jobUrl": "https://x.example/{k}", "location": "Oslo, Norway", "secondaryLocations": [{"location": "Bergen, Norway"}, "Oslo, Norway", "Moss"]}, {"title": "Tiler {k}", "applyUrl": "https://x.example/t{k}"}]}',
             [("Mason {k}", "https://x.example/{k}", "Oslo, Norway | Bergen, Norway | Moss", "Norway"), ("Tiler {k}", "https://x.example/t{k}", "", "")])]),
    "SmartRecruiters": ("https://careers.smartrecruiters.com/Acme{k}", "https://jobs.smartrecruiters.com/Acme{k}", [
        Case('{"totalFound": 3, "content": [{"id": "1{k}", "name": "Mason {k}", "location": {"city": "Leeds", "region": "", "country": "gb"}}, {"id": "2{k}", "name": "Tiler {k}", "location": {"city": "Berlin", "country": "de"}}, {"id": "", "name": "No id"}]}',
             [("Mason {k}", "https://jobs.smartrecruiters.com/Acme{k}/1{k}", "Leeds, GB", _UK), ("Tiler {k}", "https://jobs.smartrecruiters.com/Acme{k}/2{k}", "Berlin, DE", _US)])]),
    "Recruitee": ("https://acme{k}.recruitee.com/o/x", "https://acme{k}.recruitee.com/", [
        Case('{"offers": [{"title": "Mason {k}", "careers_url": "https://x.example/{k}", "location": "Leeds, UK"}, {"title": "Tiler {k}", "careers_apply_url": "https://x.example/t{k}", "city": "Austin", "state_code": "TX", "country": "United States"}]}',
             [("Mason {k}", "https://x.example/{k}", "Leeds, UK", _UK), ("Tiler {k}", "https://x.example/t{k}", "Austin, TX, United States", _US)])]),
    "Workable": ("https://apply.workable.com/acme{k}/", "https://apply.workable.com/acme{k}", [
        Case('{"jobs": [{"title": "Mason {k}", "url": "https://x.example/{k}", "city": "Leeds", "state": "", "country": "United Kingdom"}]}', [("Mason {k}", "https://x.example/{k}", "Leeds, United Kingdom", _UK)]),
        Case('{"results": [{"title": "Tiler {k}", "shortcode": "AB{k}", "locations": [{"city": "Austin", "region": "TX", "country": "United States"}, {"city": "x"}]}, {"title": "No code"}], "nextPage": "t"}',
             [("Tiler {k}", "https://apply.workable.com/acme{k}/j/AB{k}", "Austin, TX, United States", _US)])]),
    "BambooHR": ("https://acme{k}.bamboohr.com/careers/9", "https://acme{k}.bamboohr.com/careers", [
        Case('{"result": [{"id": "7{k}", "jobOpeningName": "Mason {k}", "location": {"city": "Lindon", "state": "Utah", "country": "usa"}}, {"id": 8, "title": "Tiler {k}", "location": "Leeds, UK"}, {"id": "9{k}", "title": "Smith {k}", "location": {"city": "Oslo", "country": "Norway"}}]}',
             [("Mason {k}", "https://acme{k}.bamboohr.com/careers/7{k}", "Lindon, Utah, usa", _US), ("Tiler {k}", "https://acme{k}.bamboohr.com/careers/8", "Leeds, UK", _UK), ("Smith {k}", "https://acme{k}.bamboohr.com/careers/9{k}", "Oslo, Norway", "Norway")])]),
    "UltiPro": ("https://recruiting.ultipro.com/ACM{k}/JobBoard/b-1/?q=", "https://recruiting.ultipro.com/ACM{k}/JobBoard/b-1", [
        Case('{"totalCount": 2, "opportunities": [{"Id": "1{k}", "Title": "Mason {k}", "Locations": [{"LocalizedDescription": "Leeds, UK"}, {"x": 1}, {"x": 2}]}, {"Id": "2{k}", "Title": "Tiler {k}", "Locations": [{"Address": {"City": "Austin", "State": {"Code": "TX", "Name": "Texas"}, "Country": {"Name": "United States"}}}]}]}',
             [("Mason {k}", "https://recruiting.ultipro.com/ACM{k}/JobBoard/b-1/OpportunityDetail?opportunityId=1{k}", "Leeds, UK (+2 more)", _UK), ("Tiler {k}", "https://recruiting.ultipro.com/ACM{k}/JobBoard/b-1/OpportunityDetail?opportunityId=2{k}", "Austin, TX, United States", _US)])]),
    "ADP": ("https://workforcenow.adp.com/x.html?cid=c{k}&ccId=9_1", "https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid=c{k}&ccId=9_1&lang=en_US", [
        Case('{"jobRequisitions": [{"itemID": "1{k}", "requisitionTitle": "Mason {k}", "requisitionLocations": [{"address": {"cityName": "Austin", "countrySubdivisionLevel1": {"codeValue": "TX"}, "countryCode": "US"}}, {"nameCode": {"shortName": "Waco"}}, {"address": {}}]},'
             ' {"itemId": "2{k}", "requisitionTitle": "Tiler {k}", "requisitionLocations": [{"nameCode": {"shortName": "Leeds, UK"}}]}]}',
             [("Mason {k}", "https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid=c{k}&ccId=9_1&jobId=1{k}&lang=en_US", "Austin, TX, US (+1 more)", _US),
              ("Tiler {k}", "https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid=c{k}&ccId=9_1&jobId=2{k}&lang=en_US", "Leeds, UK", _UK)])]),
    "Oracle": ("https://eq{k}.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/jobs", "https://eq{k}.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/requisitions", [
        Case('{"items": [{"TotalJobsCount": 2, "requisitionList": [{"Id": "1{k}", "Title": "Mason {k}", "PrimaryLocation": "Leeds, UK", "secondaryLocations": [{"Name": "x"}, {"Name": "y"}]}, {"Id": 2, "Title": "Tiler {k}", "Location": "Oslo, Norway", "secondaryLocations": []}]}]}',
             [("Mason {k}", "https://eq{k}.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/1{k}", "Leeds, UK (+2 more)", _UK), ("Tiler {k}", "https://eq{k}.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/2", "Oslo, Norway", "Norway")]),
        Case('{"items": []}', [])]),
    "Taleo": ("https://acme{k}.taleo.net/careersection/ex/jobsearch.ftl", "https://acme{k}.taleo.net/careersection/ex/jobsearch.ftl", [
        Case('{"requisitionList": [{"contestNo": "1{k}", "column": ["Mason {k}", "2024-01-05", "Leeds, UK", "x"]}, {"jobId": "2{k}", "jobTitle": "Tiler {k}", "column": ["T", "1/2/24", "US", "Oslo"]}, {"contestNo": "3{k}", "column": []}], "pagingData": {"totalCount": 3}}',
             [("Mason {k}", "https://acme{k}.taleo.net/careersection/ex/jobdetail.ftl?job=1{k}", "Leeds, UK", _UK), ("Tiler {k}", "https://acme{k}.taleo.net/careersection/ex/jobdetail.ftl?job=2{k}", "Oslo", "")])]),
    "BreezyHR": ("https://acme{k}.breezy.hr/p/x", "https://acme{k}.breezy.hr", [
        Case('[{"id": "1{k}", "name": "Mason {k}", "url": "https://x.example/{k}", "location": {"name": "Leeds", "country": {"name": "United Kingdom", "id": "GB"}}}, {"id": "2{k}", "title": "Tiler {k}", "location": {"city": "Oslo", "country": "Norway"}}]',
             [("Mason {k}", "https://x.example/{k}", "Leeds", _UK), ("Tiler {k}", "https://acme{k}.breezy.hr/p/2{k}", "Oslo, Norway", "Norway")]),
        Case('{"positions": [{"id": "3{k}", "name": "Smith {k}", "location": "Austin, TX"}]}', [("Smith {k}", "https://acme{k}.breezy.hr/p/3{k}", "Austin, TX", _US)])]),
    "Rippling": ("https://ats.rippling.com/acme{k}/jobs", "https://ats.rippling.com/acme{k}/jobs", [
        Case('[{"uuid": "1{k}", "name": "Mason {k}", "url": "https://x.example/{k}", "workLocation": {"label": "Leeds, UK"}}, {"id": "2{k}", "title": "Tiler {k}", "locations": ["Oslo", "Bergen, Norway", "Oslo"]}]',
             [("Mason {k}", "https://x.example/{k}", "Leeds, UK", _UK), ("Tiler {k}", "https://ats.rippling.com/acme{k}/jobs/2{k}", "Oslo, Bergen, Norway", "Norway")]),
        Case('{"results": [{"uuid": "3{k}", "name": "Smith {k}", "workLocation": false, "location": {"city": "Austin", "state": "TX"}}]}', [("Smith {k}", "https://ats.rippling.com/acme{k}/jobs/3{k}", "Austin, TX", _US)]),
        Case('[{"uuid": "4{k}", "name": "Nurse {k}", "workLocation": {"address": {"city": "Oslo", "country": "Norway"}}}, {"uuid": "5{k}", "name": "Cook {k}", "location": {"city": {"label": {"text": "Oslo"}}}},'
             ' {"uuid": "6{k}", "name": "Guard {k}", "locations": [{"place": 1}, {"name": {"value": {"title": {"name": "Rome, Italy"}}}}]}]',
             [("Nurse {k}", "https://ats.rippling.com/acme{k}/jobs/4{k}", "Oslo, Norway", "Norway"), ("Cook {k}", "https://ats.rippling.com/acme{k}/jobs/5{k}", "Oslo", ""), ("Guard {k}", "https://ats.rippling.com/acme{k}/jobs/6{k}", "Rome, Italy", "Italy")])]),
    "Pinpoint": ("https://acme{k}.pinpointhq.com/postings", "https://acme{k}.pinpointhq.com", [
        Case('{"data": [{"title": "Mason {k}", "url": "https://x.example/{k}", "location": {"name": "Leeds", "country": "United Kingdom"}}, {"name": "Tiler {k}", "public_url": "https://x.example/t{k}", "location": {"city": "Bonn", "region": "NRW", "country": "Germany"}}, {"title": "Smith {k}", "url": "https://x.example/s{k}", "location_name": "Oslo", "country": "Norway"}]}',
             [("Mason {k}", "https://x.example/{k}", "Leeds", _UK), ("Tiler {k}", "https://x.example/t{k}", "Bonn, NRW, Germany", "Germany"), ("Smith {k}", "https://x.example/s{k}", "Oslo", "Norway")])]),
    "Comeet": ("https://www.comeet.com/jobs/acme{k}/12.00A", "https://www.comeet.co/jobs/12.00A", [
        Case('[{"uid": "1", "name": "Mason {k}", "url_active_page": "https://x.example/{k}", "location": {"name": "Leeds", "country": "United Kingdom"}}, {"name": "Tiler {k}", "url_comeet_hosted_page": "https://x.example/t{k}", "location": {"city": "Haifa", "state": "", "country": "Israel"}}]',
             [("Mason {k}", "https://x.example/{k}", "Leeds", _UK), ("Tiler {k}", "https://x.example/t{k}", "Haifa, Israel", "Israel")])]),
    "Manatal": ("https://acme{k}.manatal.com/", "https://acme{k}.manatal.com", [
        Case('{"results": [{"hash": "h{k}", "position_name": "Mason {k}", "url": "/relative", "location": {"city": "Leeds", "country": "United Kingdom"}, "country": {"name": "United Kingdom"}}, {"id": 2, "title": "Tiler {k}", "public_url": "https://x.example/t{k}", "location": "Austin, TX"}], "next": null}',
             [("Mason {k}", "https://acme{k}.manatal.com/job/h{k}", "Leeds, United Kingdom", _UK), ("Tiler {k}", "https://x.example/t{k}", "Austin, TX", _US)])]),
    "Eightfold": ("https://acme{k}.eightfold.ai/careers?domain=acme.com", "https://acme{k}.eightfold.ai/careers", [
        Case('{"count": 2, "positions": [{"id": 1{k}, "name": "Mason {k}", "location": "Leeds, UK"}, {"pid": "2{k}", "title": "Tiler {k}", "canonicalPositionUrl": "https://x.example/t{k}", "locations": ["Oslo, Norway", "Moss, Norway"]}]}',
             [("Mason {k}", "https://acme{k}.eightfold.ai/careers?pid=1{k}", "Leeds, UK", _UK), ("Tiler {k}", "https://x.example/t{k}", "Oslo, Norway, Moss, Norway", "Norway")])]),
    "Phenom": ("https://careers.acme{k}.example/us/en", "https://careers.acme{k}.example/us/en", [
        Case('{"refineSearch": {"data": {"jobs": [{"jobId": "1", "title": "Mason {k}", "cityStateCountry": "Leeds, UK", "jobSeoUrl": "/us/en/job/{k}"}]}}}', [("Mason {k}", "https://careers.acme{k}.example/us/en/job/{k}", "Leeds, UK", _UK)]),
        Case('{"jobs": [{"jobTitle": "Tiler {k}", "applyUrl": "https://x.example/t{k}", "locations": ["Austin, TX"]}]}', [("Tiler {k}", "https://x.example/t{k}", "Austin, TX", _US)])]),
    "Cornerstone": ("https://acme{k}.csod.com/ux/ats/careersite/4/home?c=acme", "https://acme{k}.csod.com/ux/ats/careersite/4/home", [
        Case('{"data": {"requisitions": [{"requisitionId": 1{k}, "displayJobTitle": "Mason {k}", "locations": ["Leeds, UK", "Leeds, UK"]}]}}', [("Mason {k}", "https://acme{k}.csod.com/ux/ats/careersite/4/job/1{k}", "Leeds, UK", _UK)]),
        Case('{"results": [{"id": "2{k}", "title": "Tiler {k}", "displayLocation": "Oslo, Norway"}]}', [("Tiler {k}", "https://acme{k}.csod.com/ux/ats/careersite/4/job/2{k}", "Oslo, Norway", "Norway")])]),
    "UKG Ready": ("https://secure.saashr.com/ta/6{k}.careers?x=1", "https://secure.saashr.com/ta/6{k}.careers", [
        Case('{"job_requisitions": [{"id": 1{k}, "job_title": "Mason {k}", "location": {"city": "Austin", "state": "TX", "country": "USA"}}, {"id": 2, "job_title": " "}]}', [("Mason {k}", "https://secure.saashr.com/ta/6{k}.careers?ApplyToJob=1{k}", "Austin, TX, USA", _US)])]),
    "Asure": ("https://secure7.entertimeonline.com/ta/6{k}.careers", "https://secure7.entertimeonline.com/ta/6{k}.careers", [
        Case('{"job_requisitions": [{"id": 1{k}, "job_title": "Mason {k}", "location": "Leeds, UK"}]}', [("Mason {k}", "https://secure7.entertimeonline.com/ta/6{k}.careers?ApplyToJob=1{k}", "Leeds, UK", _UK)])]),
    "Personio": ("https://acme{k}.jobs.personio.de/?language=en", "https://acme{k}.jobs.personio.de", [
        Case('<?xml version="1.0" encoding="UTF-8"?>\n<workzag-jobs><position><id>1{k}</id><office>Munich, Germany</office><name>Mason &amp; Tiler {k}</name></position><position><id>2{k}</id><name><![CDATA[Smith {k}]]></name><subcompany>Acme</subcompany></position><position><id></id><name>No id</name></position></workzag-jobs>',
             [("Mason & Tiler {k}", "https://acme{k}.jobs.personio.de/job/1{k}", "Munich, Germany", "Germany"), ("Smith {k}", "https://acme{k}.jobs.personio.de/job/2{k}", "Acme", "")]),
        Case("<workzag-jobs><position><id>3", []), Case("<workzag-jobs/>", []), Case("not xml", []),
        Case('<f:jobs xmlns:f="https://x.example/ns" xmlns="https://x.example/other"><department><name>Works</name><team><f:position><id>4{k}</id><f:name>Nurse {k}</f:name><office>Lyon, France</office></f:position></team><position><id>5{k}</id><name>Cook {k}</name></position></department></f:jobs>',
             [("Nurse {k}", "https://acme{k}.jobs.personio.de/job/4{k}", "Lyon, France", "France"), ("Cook {k}", "https://acme{k}.jobs.personio.de/job/5{k}", "", "")])]),
    "ADP Recruiting Management": ("https://myjobs.adp.com/acme{k}/cx/job-listing", "https://myjobs.adp.com/acme{k}/cx/job-listing", [
        Case('{"jobRequisitions": [{"reqId": "R{k}", "title": "Mason {k}", "location": "Leeds, UK"}, {"reqId": "S{k}", "title": "Tiler {k}", "location": {"city": "Austin", "state": "TX"}}], "menu": [{"title": "Start page", "href": "/"}]}',
             [("Mason {k}", "https://myjobs.adp.com/acme{k}/cx/job-details?reqId=R{k}", "Leeds, UK", _UK), ("Tiler {k}", "https://myjobs.adp.com/acme{k}/cx/job-details?reqId=S{k}", "Austin, TX", _US)]),
        Case("no json", [])]),
}

#: (URL, why it isn't a board of gohire.io)
BOARD_URLS = [
    ("https://jobs.gohire.io/a{k}", None), ("gohire.io/a{k}", None), ("  ", "no URL"), ("https:///a{k}", "no host"), ("https://notgohire.io/a{k}", "another host"), ("https://a{k}.example.com/?u=gohire.io", "another host"),
]

#: (URL, markup, domain)
DOMAINS = [
    ("https://acme{k}.eightfold.ai/careers?domain=Acme{k}.com", "", "acme{k}.com"), ("https://careers.acme{k}.org/x", '{"domain": "Acme{k}.net"}', "acme{k}.net"), ("https://acme{k}.eightfold.ai/careers", "<p>", "acme{k}.com"),
    ("https://careers.jobs.acme{k}.co.uk/careers", "", "acme{k}.co.uk"), ("https://app.eightfold.ai/careers", "", ""), ("careers.localhost", "", ""),
]

_P = f"{ACME}/careers/{{k}}"
PAGERS = [
    Case('<a href="/x/2">2</a><a href="?p=9">Next</a><a rel="next" href="?p=2">onwards</a>', [(_P + "?p=2",)]),
    Case('<a href="/x/2">2</a><a href="?p=3"> Next  page </a>', [(_P + "?p=3",)]),
    Case('<a href="/x/7">7</a><a href="/x/3">3</a><a href="/x/1">1</a><a href="/x/201">201</a>', [(f"{ACME}/x/3",)]),
    Case('<a rel="next" href="https://other.example.org/2">next</a><a href="/x/12">12</a>', [(f"{ACME}/x/12",)]),
    Case(f'<a rel="next" href="{_P}">next</a><a href="#">2</a><a href="/x">more jobs</a>', []),
    Case('<a href="?o=1">»</a>', [(_P + "?o=1",)]),
]

_S = "https://www.s{i}-{k}.example.com"


def _site(i: int, *pages: tuple[str, str]) -> list[tuple[str, str]]:
    return [(_S.replace("{i}", str(i)) + path, html) for path, html in pages]


#: (pages of a site, the first its start; where its board is; how it was found)
SITES = [
    (_site(0, ("/", '<a href="https://jobs.lever.co/s{k}">We are hiring</a><a href="/careers">Careers</a>')), "https://jobs.lever.co/s{k}", "board"),
    (_site(1, ("/", '<a href="/about">About</a><a href="/careers">Careers</a>'), ("/careers", '<a href="https://boards.greenhouse.io/s{k}">Open roles</a>')), "https://boards.greenhouse.io/s{k}", "hop"),
    (_site(2, ("/", '<a href="/press">Press jobs</a><a href="/jobs">Jobs</a>'), ("/jobs", "<p>none</p>")), _S.replace("{i}", "2") + "/jobs", "link"),
    (_site(3, ("/", "<p>Welcome</p>"), ("/jobs", "<p>Job title: Mason. Department: works. Apply now</p>")), _S.replace("{i}", "3") + "/jobs", "probe"),
    (_site(4, ("/", "<p>Welcome</p>")), "", ""),
]
