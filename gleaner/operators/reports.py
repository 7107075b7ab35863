"""What a run's results add up to. results: (row_id, company, platform, seed_url, seed_field, jobs, error, seconds, discovered)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import texts
from gleaner.functions.fixed import NO_JOBS_DETAIL, OUTCOMES, UNKNOWN


def with_outcome(results: DataFrame) -> DataFrame:
    return results.withColumn("outcome", texts.outcome(F.col("jobs"), F.col("error"), F.col("platform")))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 1), F.lit(0.0))


def coverage(results: DataFrame) -> DataFrame:
    """A row for each platform; technical failures take in those of unknown platforms. One shuffle of partial sums."""
    has = lambda *x: F.count_if(F.col("outcome").isin(*x))
    rows = with_outcome(results).groupBy("platform").agg(
        F.count("*").alias("companies"), F.sum("jobs").cast("bigint").alias("jobs"), has("jobs").alias("produced"), has("no open jobs").alias("no_jobs"),
        has("unsupported platform").alias("unsupported"), has("technical failure", "unknown platform").alias("technical"), F.sum("seconds").alias("seconds"))
    return rows.withColumn("failures", F.col("unsupported") + F.col("technical")).withColumn("success_rate", _share(F.col("produced"), F.col("companies"))).withColumn("seconds", F.round("seconds", 1))


def coverage_order(cover: DataFrame) -> DataFrame:
    """coverage with its place in the report: most postings first, then by name. It has a row for each platform only."""
    return cover.withColumn("place", F.row_number().over(W.orderBy(F.desc("jobs"), "platform")).cast("bigint"))


def outcome_counts(spark: SparkSession, results: DataFrame) -> DataFrame:
    """(outcome, companies) with all outcomes, also those that no company has."""
    known = spark.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    counts = with_outcome(results).groupBy("outcome").agg(F.count("*").alias("companies"))
    return known.join(counts, "outcome", "left").select("outcome", F.coalesce("companies", F.lit(0)).alias("companies"))


def jobs_by_platform(results: DataFrame) -> DataFrame:
    return results.groupBy("platform").agg(
        F.count("*").alias("companies"), F.sum("jobs").cast("bigint").alias("jobs"),
        F.count_if(F.col("jobs") > 0).alias("produced"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def _reasons(results: DataFrame) -> DataFrame:
    """(platform, reason, n, first): failures by family, with the first row that has it."""
    family = texts.reason_family(F.coalesce("error", F.lit("unknown")))
    return results.withColumn("reason", family).groupBy("platform", "reason").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))


def failure_reasons(results: DataFrame, most: int = 12) -> DataFrame:
    """(platform, reason, n, place): the `most` commonest families of technical and unsupported failures by platform."""
    rows = with_outcome(results).where(F.col("outcome").isin("technical failure", "unsupported platform"))
    place = F.row_number().over(W.partitionBy("platform").orderBy(F.desc("n"), "first")).cast("bigint")
    return _reasons(rows).withColumn("place", place).where(F.col("place") <= most).drop("first")


def failure_rollup(results: DataFrame) -> DataFrame:
    """(platform, reason, n) of every failed company, with subtotals by platform and a total (nulls)."""
    family = texts.reason_family(F.col("error"))
    rows = results.where("error is not null").select("platform", family.alias("reason"))
    return rows.rollup("platform", "reason").agg(F.count("*").alias("n"))


def failure_console(results: DataFrame) -> DataFrame:
    """(platform, reason, n, platform_total): families of all failed companies, beside their platform's total."""
    rows = _reasons(results.where("error is not null"))
    return rows.withColumn("platform_total", F.sum("n").over(W.partitionBy("platform"))).drop("first")


def jobs_by_country(jobs: DataFrame, most: int = 25) -> DataFrame:
    """(country, n): the commonest countries of postings(pos, country); of equals, the one seen first."""
    named = F.when(F.coalesce("country", F.lit("")) == "", "(unstated)").otherwise(F.col("country"))
    rows = jobs.groupBy(named.alias("country")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(most).select("country", "n")


def run_totals(results: DataFrame, jobs: DataFrame, seconds: float) -> DataFrame:
    """One row of totals; a run without companies has zeros."""
    made = jobs.agg(F.count("*").alias("jobs_extracted"), F.countDistinct(F.nullif("country", F.lit(""))).alias("countries_identified"))
    ran = results.agg(F.count("*").alias("companies_processed"), F.count_if(F.col("jobs") > 0).alias("companies_producing_jobs"), F.count_if(F.col("discovered")).alias("companies_via_discovery"))
    per = F.coalesce(F.round(F.lit(seconds) / F.nullif("companies_processed", F.lit(0)), 2), F.lit(0.0))
    return ran.crossJoin(made).select(  # one row each
        "companies_processed", "jobs_extracted", "companies_producing_jobs", _share(F.col("companies_producing_jobs"), F.col("companies_processed")).alias("success_rate"),
        F.round(F.lit(seconds), 1).alias("crawl_seconds"), per.alias("seconds_per_company"), "countries_identified", "companies_via_discovery")


def slowest(results: DataFrame, most: int = 15) -> DataFrame:
    """The `most` slowest companies, without those of no measured time: the limit comes first."""
    top = results.orderBy(F.desc("seconds"), "row_id").limit(most).where("seconds > 0")
    return top.select("row_id", "company", "platform", F.round("seconds", 1).alias("seconds"), "jobs")


def top_errors(results: DataFrame, most: int = 5) -> DataFrame:
    rows = results.where("error is not null").groupBy("error").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(most).select("error", "n")


def without_adapter(results: DataFrame, supported: DataFrame) -> DataFrame:
    """(platform, companies): platforms of results that supported(platform) lacks; none if nothing is supported."""
    if not supported.limit(1).count():
        return results.groupBy("platform").agg(F.count("*").alias("companies")).limit(0)
    named = supported.select("platform").distinct()
    # supported platforms number as many as the rules have
    return results.where(F.col("platform") != UNKNOWN).join(F.broadcast(named), "platform", "left_anti").groupBy("platform").agg(F.count("*").alias("companies"))


def report_rows(companies: DataFrame, results: DataFrame) -> DataFrame:
    """Rows of the outcome reports: every company without postings, with its URLs from the sheet."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    sheet = companies.select("row_id", F.col("company").alias("sheet_company"), "website", "career_url", "it_link")
    rows = with_outcome(results).where("outcome <> 'jobs'").join(sheet, "row_id", "left")
    return rows.select(
        "row_id", F.when(empty("company") != "", F.col("company")).otherwise(empty("sheet_company")).alias("company"),
        empty("website").alias("website"), empty("career_url").alias("career_url"), empty("it_link").alias("it_link"), empty("seed_url").alias("crawled_url"),
        F.when(F.col("discovered"), "discovered").otherwise(empty("seed_field")).alias("seed_field"), "platform", "outcome",
        texts.detail(F.col("error")).alias("detail"), texts.tenths(F.col("seconds")).alias("seconds"))


def failed_companies(companies: DataFrame, results: DataFrame) -> DataFrame:
    """(row_id, company, website, career_url, it_link, platform, reason) of every company without postings."""
    rows = report_rows(companies, results)
    return rows.select("row_id", "company", "website", "career_url", "it_link", "platform", F.coalesce("detail", F.lit(NO_JOBS_DETAIL)).alias("reason"))


def platform_rollup(results: DataFrame) -> DataFrame:
    """(platform, companies, jobs, produced), with a total row (null platform)."""
    return results.rollup("platform").agg(F.count("*").alias("companies"), F.sum("jobs").cast("bigint").alias("jobs"), F.count_if(F.col("jobs") > 0).alias("produced"))


def summary(spark: SparkSession, results: DataFrame, jobs: DataFrame, supported: DataFrame, seconds: float) -> DataFrame:
    """One row `json`: the whole run as one document. Every part of it has a bounded number of rows."""

    def listed(rows: DataFrame, order: list[Column], item: Column) -> DataFrame:
        place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o")
        before = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
        return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(place, item.alias("x"))), before), lambda s: s["x"]).alias("list"))

    def mapping(rows: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
        return listed(rows, order, F.struct(F.col(key).alias("key"), F.col(value).alias("value"))).select(F.map_from_entries("list").alias("list"))

    cover = coverage(results)
    reasons = failure_reasons(results)
    by_platform = reasons.groupBy("platform").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("reason", "n").alias("x")))), lambda s: s["x"])).alias("reasons"))
    slow = slowest(results)
    parts = {
        "totals": run_totals(results, jobs, seconds).select(F.struct("*").alias("list")),
        "outcomes": mapping(outcome_counts(spark, results), "outcome", "companies", [F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))]),
        "platforms": listed(cover, [-F.col("jobs"), F.col("platform")], F.struct(*cover.columns)),
        "platforms_detected_without_an_adapter": mapping(without_adapter(results, supported), "platform", "companies", [-F.col("companies"), F.col("platform")]),
        "failure_reasons": mapping(by_platform, "platform", "reasons", [F.col("platform")]),
        "jobs_by_country": mapping(jobs_by_country(jobs), "country", "n", [-F.col("n"), F.col("country")]),
        "slowest_companies": listed(slow, [-F.col("seconds"), F.col("row_id")], F.struct("company", "platform", "seconds", "jobs")),
    }
    out = None
    for name, part in parts.items():
        one = part.withColumnRenamed("list", name)
        out = one if out is None else out.crossJoin(one)  # one row each
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return out.select(F.to_json(F.struct(stamp.alias("generated_at"), *parts)).alias("json"))
