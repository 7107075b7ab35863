"""Queries that once read a part of their table, against plain loops over all of it."""

import pytest

from gleaner.functions import fixed
from gleaner.operators import reports
from gleaner.plans import catalogue
from gleaner.plans import derived as d

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def walked(spark):
    return catalogue.queries()["pagination_next_chain"](spark, DATA).collect()


def test_every_board_is_followed(spark, walked):
    links, boards = {}, set()
    for r in d.derived(spark, DATA, d.EDGES).collect():
        links.setdefault((r.board, r.url), []).append((r.place, r.next_url))
        boards.add(r.board)
    wanted = []
    for board in boards:
        path = ["p0"]
        while len(path) < 25:
            step = next((u for _, u in sorted(links.get((board, path[-1]), [])) if u not in path), None)
            if step is None:
                break
            path.append(step)
        wanted += [(board, i + 1, u) for i, u in enumerate(path)]
    assert sorted(map(tuple, walked)) == sorted(wanted)


def test_outcomes_of_all_results(spark):
    results = d.derived(spark, DATA, d.RESULTS)
    got = dict(map(tuple, catalogue.queries()["outcome_zero_filled"](spark, DATA).collect()))
    assert sum(got.values()) == results.count() and got["jobs"] == results.where("jobs > 0").count() > 0


def test_an_outcome_of_no_company_is_zero(spark):
    results = d.derived(spark, DATA, d.RESULTS).where("jobs > 0").limit(3)
    got = dict(map(tuple, reports.outcome_counts(spark, results).collect()))
    assert got == {o: 3 if o == "jobs" else 0 for o in fixed.OUTCOMES}


def test_slices_hold_every_posting(spark):
    rows = sorted(catalogue._jobs(spark, DATA).collect(), key=lambda r: r.pos)
    kept = {}
    for part, held in ((1, (0, 1)), (2, (1, 2))):
        for r in rows:
            if r.pos % 3 in held:
                kept.setdefault((r.company_name.lower(), r.job_url.lower()), (part, r.pos, r.job_url, r.job_title))
    got = catalogue.queries()["union_pages_distinct"](spark, DATA).select("part", "pos", "job_url", "job_title").collect()
    assert sorted(map(tuple, got)) == sorted(kept.values())
    assert {r.pos % 6 for r in got} == set(range(6))
