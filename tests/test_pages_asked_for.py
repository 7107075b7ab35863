"""a run reads links only where they are asked for."""

from gleaner.operators import links

PAGE = """<a href="/p2" rel="next">On</a><a href="/p3">Next</a><a href="/p4"> 4 </a><a href="/p5">1</a><a href="/p6">201</a>
<a href="https://else.example/p">2</a><a href="/p7">007</a><a>3</a><a href="#">5</a><a href="/job/1">Welder</a><!-- <a href="/p8">8</a> -->"""


def _pages(spark):
    rows = [(1, "https://a.example/", PAGE), (2, "https://b.example/", None), (3, "https://c.example/", "<a href='/careers'>Careers</a>"), (4, "https://c.example/careers", '<a href="https://jobs.lever.co/c">We are hiring</a>')]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_links_of_a_pager_are_those_among_all_links(spark):
    pages = _pages(spark)
    key = lambda rows: sorted(map(tuple, rows.collect()))
    found = key(links.page_pagers(pages))
    assert found == key(links.pager_links(links.page_links(pages))) and len(found) == 4


def test_only_pages_of_sites_and_where_they_lead_are_searched(spark):
    sites = spark.createDataFrame([(1, "https://c.example/"), (2, ""), (3, None), (4, "https://none.example/")], "company bigint, url string")
    found = links.discovered(sites, _pages(spark))
    assert [tuple(r) for r in found.collect()] == [(1, "https://jobs.lever.co/c", "hop")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= plan.count("posexplode(regexp_extract_all") > 0
