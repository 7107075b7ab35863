import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import places, texts, urls
from gleaner.functions.platforms import with_platform


def _each(spark, expression, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_countries(spark):
    cases = {
        "Austin, TX": "United States", "Austin, TX 78701": "United States", "Vancouver, BC": "Canada", "London, UK": "United Kingdom", "Remote - Canada": "Canada",
        "Austin, TX | Boston, MA": "United States", "Paris, France; Pune, India": "", "3 Locations": "", "Portland, OR": "", "CA (+8 more)": "", "": "", None: "", "Berlin, DE": "United States",
        "Austin, TX (+1 more)": "United States", "Toronto, ON, Canada": "Canada", "Multiple Locations": "",
    }
    assert dict(zip(cases, _each(spark, places.derive_country, list(cases)), strict=True)) == cases


def test_urls(spark):
    cases = {" \"acme.com/jobs\" ": "https://acme.com/jobs", "//x.y": "https://x.y", "http://a.b": "http://a.b", "mailto:a@b.c": "mailto:a@b.c", "": "", None: ""}
    assert dict(zip(cases, _each(spark, urls.normalised, list(cases)), strict=True)) == cases
    links = {"/a/../b": "https://h.com/b", "c": "https://h.com/d/c", "?q=1": "https://h.com/d/e?q=1", "#x": "", "javascript:x": "", "//o.com/z": "https://o.com/z", "../u?v": "https://h.com/u?v", "http://k": "http://k"}
    assert dict(zip(links, _each(spark, lambda c: urls.absolute(F.lit("https://h.com/d/e"), c), list(links)), strict=True)) == links


def test_platforms(spark):
    cases = {"https://boards.greenhouse.io/acme": "Greenhouse", "https://x.wd5.myworkdayjobs.com/en-US/s": "Workday", "notlever.co": "Generic HTML", "https://jobs.lever.co/a": "Lever", "N/A": "Unknown", "": "Unknown", None: "Unknown"}
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, u string")
    assert [r.platform for r in with_platform(rows, "u").orderBy("i").collect()] == list(cases.values())


@pytest.mark.parametrize("text,wanted", [("Engineer II", True), ("Apply now", False), ("12345", False), ("ab", False), ("Ärztin", True)])
def test_titles(spark, text, wanted):
    assert _each(spark, texts.looks_like_title, [text]) == [wanted]


def test_elapsed_and_reasons(spark):
    assert _each(spark, lambda c: texts.elapsed(c.cast("int")), ["9", "249", "3849"]) == ["9s", "4m 09s", "1h 04m 09s"]
    assert _each(spark, texts.reason_family, ["no adapter for Gem", "E: HTTP 403 for https://a.b/c (x)", "V"]) == ["no adapter for Gem", "E: HTTP 403 for <url>", "V"]


def test_tenths_by_exact_values(spark):
    rng = random.Random(2)
    inputs = [0.0, -0.0, 0.05, 0.15, 0.25, 0.35, 0.75, 0.95, 12.25, 49.95, 2.5, 9.96, 1e-20, 5e-324, -0.25, -3.15, 0.049999999999999996, 2.0**52 - 0.5, 2.0**51 + 0.25, 2.0**52]
    inputs += [round(rng.uniform(0, 60), 2) for _ in range(300)] + [rng.randrange(2000) / 20 for _ in range(300)] + [math.nextafter(rng.randrange(2000) / 20, rng.choice([0, 99])) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x double")
    got = [r.y for r in rows.select("i", texts.tenths(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [f"{x:.1f}" for x in inputs]
