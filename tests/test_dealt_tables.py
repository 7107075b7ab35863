"""Tasks on small tables, of whose rows much is made, grow in number and not in size."""

import pytest

import __spark_entry__
from gleaner.plans import derived

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,rows", [("country_cases", 32), ("url_normalise_companies", 1)])
def test_tasks_hold_few_rows_and_lose_none(spark, monkeypatch, name, rows):
    whole = __spark_entry__.queries()[name](spark, DATA)
    wanted = sorted(map(tuple, whole.collect()), key=repr)
    monkeypatch.setattr(derived, "ROWS", {"customer": 10, "supplier": 2}, raising=False)
    found = __spark_entry__.queries()[name](spark, DATA)
    most = derived.ROWS["supplier" if rows > 1 else "customer"] * rows
    sizes = found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) > 4 and max(sizes) <= 2 * most
    assert sorted(map(tuple, found.collect()), key=repr) == wanted


@pytest.mark.parametrize("name", ["board_walk_ends", "board_walk_postings"])
def test_rows_laid_out_from_few_bytes_are_not_taken_for_small(spark, name):
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
