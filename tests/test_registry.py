"""Adapters of a user's own, and runs that use them."""


from gleaner.operators import replay
from gleaner.operators.registry import BUILT_IN, Registry

RULE = {"board": "https://jobs.acme-ats.example/{slug}", "lists": ["$.openings"], "title": ["name"], "urls": ["link"], "id": ["id"], "template": "https://jobs.acme-ats.example/{slug}/{id}",
        "location": [("said", ["where"])], "parts": {"slug": r"^https?://jobs[.]acme-ats[.]example/([^/?#]+)"}}


def _captures(spark, pages=(), payloads=()):
    return replay.Captures(
        spark.createDataFrame(list(pages), "url string, html string"), spark.createDataFrame([], "url string, html string"),
        spark.createDataFrame([], "page_url string, pos bigint, url string, content_type string, body string"), spark.createDataFrame(list(payloads), "board_url string, page_no bigint, body string, error string"))


def _companies(spark, *links):
    return spark.createDataFrame([(i, f"C{i}", x, "", "") for i, x in enumerate(links)], "row_id bigint, company string, it_link string, career_url string, website string")


def test_a_vendor_of_ones_own(spark):
    own = BUILT_IN.copy()
    assert own.register_interface("Acme ATS", ["jobs.acme-ats.example"], RULE) and own.register_pattern("Pagey", ["pagey.example"], r"/opening/\d+", "?page={i}")
    board, bad, paged = "https://jobs.acme-ats.example/shop", "https://jobs.acme-ats.example/", "https://x.pagey.example/all"
    body = '{"openings": [{"name": "Welder", "id": "7", "where": {"address": {"city": "Oslo", "country": "Norway"}}}, {"name": "Joiner", "link": "https://x.example/2"}]}'
    link = lambda n: f'<a href="/opening/{n}">Guard number {n}</a>'
    captures = _captures(spark, [(paged, link(1)), (paged + "?page=2", link(2)), (paged + "?page=3", link(2)), (paged + "?page=4", link(3))], [(board, 0, body, None), (bad, 0, body, None)])
    results, jobs = replay.replayed(_companies(spark, board, bad, paged, "https://jobs.lever.co/none"), captures, own)
    got = {r.row_id: (r.platform, r.jobs, r.error) for r in results.collect()}
    assert got == {0: ("Acme ATS", 2, None), 1: ("Acme ATS", 0, "AdapterUrlError: not a board of this vendor"), 2: ("Pagey", 2, None), 3: ("Lever", 0, "AdapterHttpError: nothing captured of https://jobs.lever.co/none")}
    assert sorted((r.job_title, r.job_url, r.location, r.country) for r in jobs.where("row_id = 0").collect()) == [
        ("Joiner", "https://x.example/2", "", ""), ("Welder", "https://jobs.acme-ats.example/shop/7", "Oslo, Norway", "Norway")]
    assert not BUILT_IN.has("Acme ATS")


def test_a_rule_that_doesnt_load_is_skipped(spark):
    own = Registry()
    for label, rule, why in (("A", {k: v for k, v in RULE.items() if k != "title"}, "without title"), ("B", RULE | {"colour": 1}, "not understood: colour"), ("C", RULE | {"parts": {"slug": "("}}, "a part's pattern"),
                             ("D", RULE | {"template": "{other}/{id}"}, "no part other"), ("E", RULE | {"lists": []}, "without lists"), ("F", RULE | {"parts": {"slug": "x"}}, "part slug has 0 groups")):
        assert not own.register_interface(label, ["a.example"], rule) and own.skipped[label].startswith(why) and not own.has(label)
    assert not own.register_pattern("G", ["g.example"], "[") and not own.register_rows("H", ["h.example"], {"shape": 1}) and not own.register_interface("I", ["Not a host"], RULE)
    assert own.rules()[0][0] == "Workday" and set(own.skipped) == set("ABCDEFGHI")
    assert own.register_interface("A", ["a.example"], RULE | {"parts": {"slug": "//([a-z.]+)"}}) and "A" not in own.skipped
    results, _ = replay.replayed(_companies(spark, "https://jobs.lever.co/x", ""), _captures(spark), own)
    assert sorted((r.row_id, r.jobs, r.error) for r in results.collect()) == [(0, 0, "no adapter for Lever"), (1, 0, replay.NO_URL)]


def test_no_companies(spark):
    results, jobs = replay.replayed(spark.createDataFrame([], "row_id bigint, company string, it_link string, career_url string, website string"), _captures(spark))
    assert results.count() == 0 and jobs.count() == 0
