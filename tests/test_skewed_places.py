"""no task holds all postings of one location, or all postings without one."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators.jobs import FIELDS, with_countries


@pytest.fixture()
def joined_by_sorting(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("place,stated,wanted", [("", "", ""), ("Lyon, France", "", "France"), ("Lyon, France", "Chad", "Chad")])
def test_postings_of_one_location_are_dealt_out(joined_by_sorting, place, stated, wanted):
    told_of = lambda value: F.when(F.col("id") >= 0, value).otherwise("?")  # noqa: E731  no literal, which the optimizer would fold
    text = {"company_name": F.lit("Acme"), "job_url": F.concat(F.lit("https://a.example/"), F.col("id").cast("string")), "location": told_of(place), "country": told_of(stated)}
    jobs = joined_by_sorting.range(4000).select(*[text.get(c, F.lit("x")).alias(c) for c in FIELDS])
    told = with_countries(jobs)
    sizes = told.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 4000 and max(sizes) < 2500
    assert told.groupBy("country").count().collect() == [(wanted, 4000)]
