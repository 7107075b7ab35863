import json

import pytest

from gleaner.operators import jobs, reports
from gleaner.plans import catalogue
from gleaner.sources import sheet, sinks

DATA = "/root/testdata/sf0.001"


def _read(spark, tmp_path, text):
    (tmp_path / "in.csv").write_bytes(text.encode("utf-8"))
    return [tuple(r)[1:] for r in sheet.read_companies(spark, str(tmp_path / "in.csv")).orderBy("row_id").collect()]


def test_headers_by_alias_and_marks(spark, tmp_path):
    text = "﻿Careers / Jobs URL,company website,Company,ATS Link,Website\nc.com/jobs, w.com ,\"A, \"\"B\"\"\",N/A,x.com\n,,,,\n , , ,y,\nnull,w2.com,C,,\n"
    assert _read(spark, tmp_path, text) == [('A, "B"', "x.com", "c.com/jobs", "N/A"), ("C", "", "null", "")]


def test_first_of_equal_headers_and_no_link_column(spark, tmp_path):
    assert _read(spark, tmp_path, "Name,Website,website,Career URL\nA,1,2,3\n") == [("A", "1", "3", "")]


def test_missing_columns_are_named(spark, tmp_path):
    with pytest.raises(sheet.SheetError, match="website, career_url"):
        _read(spark, tmp_path, "Company\nA\n")
    with pytest.raises(sheet.SheetError, match="empty"):
        _read(spark, tmp_path, "")


def test_reports_make_up_the_failures(spark, tmp_path):
    companies, results = catalogue._companies(spark, DATA), catalogue._results(spark, DATA)
    paths = sinks.write_outcomes(reports.report_rows(companies, results).where("outcome <> 'unknown platform'"), str(tmp_path))
    read = {k: spark.read.csv(p, header=True).count() for k, p in paths.items()}
    assert read["unknown platform"] == 0 and spark.read.csv(paths["unknown platform"], header=True).columns[0] == "Company"
    sinks.write_failures(reports.failed_companies(companies, results), str(tmp_path / "failed"))
    unknown = reports.with_outcome(results).where("outcome = 'unknown platform'").count()
    assert spark.read.csv(str(tmp_path / "failed"), header=True).count() == sum(read.values()) + unknown


def test_jobs_and_summary(spark, tmp_path):
    found = jobs.dedupe(catalogue._jobs(spark, DATA), ["pos"])
    for kind in ("parquet", "csv"):
        sinks.write_jobs(found, str(tmp_path / kind), kind)
        read = spark.read.parquet(str(tmp_path / kind)) if kind == "parquet" else spark.read.csv(str(tmp_path / kind), header=True)
        assert read.count() == found.count() and "Job Title" in read.columns
    sinks.write_summary(catalogue.run_summary(spark, DATA), str(tmp_path / "summary"))
    document = json.loads(spark.read.text(str(tmp_path / "summary")).first()["value"])
    assert document["totals"]["companies_processed"] == catalogue._results(spark, DATA).count()


def test_files_of_a_folder_have_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Company,Website,Careers URL\nAcme,acme.example,acme.example/jobs\n")
    (tmp_path / "b.csv").write_text("\ufeffIT LINK,Name,Careers Page,URL\njobs.lever.co/b,Beta,beta.example/c,beta.example\n")
    got = sorted((r.company, r.website, r.career_url, r.it_link) for r in sheet.read_companies(spark, str(tmp_path)).collect())
    assert got == [("Acme", "acme.example", "acme.example/jobs", ""), ("Beta", "beta.example", "beta.example/c", "jobs.lever.co/b")]
