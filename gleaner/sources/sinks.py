"""Where results go: postings as Parquet and CSV, a report for each outcome, and the summary document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.fixed import FAILURE_COLUMNS, REPORT_COLUMNS, REPORT_FILES
from gleaner.operators.jobs import export_view

REPORT_FIELDS = ["company", "website", "career_url", "it_link", "crawled_url", "seed_field", "platform", "outcome", "detail", "seconds"]
FAILURE_FIELDS = ["company", "website", "career_url", "it_link", "platform", "reason"]


def _csv(rows: DataFrame, path: str) -> None:
    # quotes are doubled, as spreadsheets expect; an empty result still has its header
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_jobs(jobs: DataFrame, path: str, kind: str = "parquet") -> None:
    """Postings under the headers of the exported sheet, as `parquet` or `csv`."""
    rows = export_view(jobs)
    if kind == "csv":
        _csv(rows, path)
    else:
        rows.write.mode("overwrite").parquet(path)


def write_failures(failed: DataFrame, path: str) -> None:
    """reports.failed_companies as CSV."""
    _csv(failed.select(*[F.col(c).alias(h) for c, h in zip(FAILURE_FIELDS, FAILURE_COLUMNS, strict=True)]), path)


def write_outcomes(report: DataFrame, folder: str) -> dict[str, str]:
    """reports.report_rows as one CSV folder for each outcome, also where it has no rows: outcome -> path."""
    out = {}
    for outcome, name in REPORT_FILES.items():
        rows = report.where(F.col("outcome") == outcome)
        out[outcome] = f"{folder}/{name}"
        _csv(rows.select(*[F.col(c).alias(h) for c, h in zip(REPORT_FIELDS, REPORT_COLUMNS, strict=True)]), out[outcome])
    return out


def write_summary(summary: DataFrame, path: str) -> None:
    """reports.summary, a row of bounded size, as text."""
    summary.select("json").coalesce(1).write.mode("overwrite").text(path)
