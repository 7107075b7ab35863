"""Inputs for the catalogue's queries, derived from the standing tables by arithmetic on their keys.

The text of each is SQL that Spark and DuckDB both read, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.fixed import RULES
from gleaner.functions.lineage import join_by_measure


def _case(expr: str, values: list[str], other: str = "''") -> str:
    def text(v: str) -> str:
        return "'" + v.replace("'", "''") + "'"

    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + f" ELSE {other} END"


HOSTS = [hosts[0] for _, hosts, _ in RULES]
PARTS = [parts[0] for _, _, parts in RULES if parts]
LOCATIONS = [
    "Austin, TX", "London, UK", "Remote - Canada", "Austin, TX | Boston, MA", "3 Locations", "Portland, OR", "Berlin, DE", "Austin, TX (+1 more)", "CA (+8 more)",
    "Toronto, ON, Canada", "Vancouver, BC", "Paris, France", "Hybrid: Munich, Deutschland", "Multiple Locations", "n/a", "", "Austin, TX 78701", "Fully Remote in India",
    "Bangalore, India; Pune, India", "Dublin, Ireland or Paris, France", "High Point, NC (EAS Premier)", "U.S.", "New York", "Albany, New York", "St. John's, NL", "Remote",
]
ERRORS = [
    "no adapter for Gem", "AdapterHttpError: HTTP 403 for https://a.example.com/x?y=1 (forbidden)", "AdapterHttpError: HTTP 500 for https://b.example.com/z: 'oops'",
    "AdapterUrlError: this portal is rendered client-side", "WorkdayApiError: Human Verification page", "AdapterUrlError: legacy portal at https://c.example.com", "TimeoutError: ",
    "ValueError", "AdapterHttpError: bot challenge on https://d.example.com",
]
LABELS = [n for n, _, _ in RULES] + ["Generic HTML", "Unknown"]

COMPANIES = f"""
SELECT c_custkey AS row_id, c_name AS company,
  CASE WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN '   ' WHEN c_custkey % 17 = 0 THEN NULL
       WHEN c_custkey % 19 = 0 THEN 'mailto:jobs@example.com' WHEN c_custkey % 23 = 0 THEN ' "//T' || CAST(c_custkey AS STRING) || '.lever.co/x y" '
       ELSE 'https://t' || CAST(c_custkey AS STRING) || '.' || {_case(f"c_custkey % {len(HOSTS) + 6}", HOSTS, "'example.net:8443'")} || {_case("c_custkey % 5", ["/", "/jobs", "/Careers?x=1", "", "/a#b"])} END AS it_link,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN 'HTTPS://T' || CAST(c_custkey AS STRING) || '.' || {_case(f"c_custkey % {len(HOSTS) + 6}", HOSTS, "'example.net'")} || '/'
       ELSE 'www.Company' || CAST(c_custkey AS STRING) || '.example.com.' || {_case(f"c_custkey % {len(PARTS) + 5}", [p.upper() for p in PARTS], "'/careers'")} END AS career_url,
  CASE WHEN c_custkey % 29 = 0 THEN 'none found' ELSE 'user:pw@Company' || CAST(c_custkey AS STRING) || '.example.com' END AS website
FROM {{customer}}
"""

POSTINGS = f"""
SELECT l_orderkey * 8 + l_linenumber AS pos, l_suppkey AS board, CAST(l_linenumber AS BIGINT) AS page_no,
  CASE WHEN l_suppkey % 3 = 0 THEN ' COMPANY ' ELSE 'Company ' END || CAST(l_suppkey % 40 AS STRING) AS company_name,
  CASE WHEN l_orderkey % 29 = 0 THEN '   ' ELSE ' Engineer ' || CAST(l_partkey % 500 AS STRING) || ' ' END AS title,
  CASE WHEN l_orderkey % 31 = 0 THEN NULL WHEN l_linenumber % 3 = 0 THEN 'HTTPS://Jobs.example.com/Job/' || CAST(l_partkey % 700 AS STRING)
       ELSE 'https://jobs.example.com/job/' || CAST(l_partkey % 700 AS STRING) END AS url,
  {_case(f"l_partkey % {len(LOCATIONS)}", LOCATIONS)} AS location,
  CASE WHEN l_partkey % 9 = 0 THEN ' Iceland ' ELSE '' END AS country,
  'https://board' || CAST(l_suppkey AS STRING) || '.example.com/' AS career_page_url, 'Generic HTML' AS platform
FROM {{lineitem}}
"""

RESULTS = f"""
SELECT o_orderkey AS row_id, 'Company ' || CAST(o_custkey AS STRING) AS company, o_custkey AS custkey,
  {_case(f"o_orderkey % {len(LABELS)}", LABELS)} AS platform, 'https://c' || CAST(o_custkey AS STRING) || '.example.com' AS seed_url,
  CASE o_orderkey % 3 WHEN 0 THEN 'it_link' WHEN 1 THEN 'career_url' ELSE 'website' END AS seed_field,
  CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 40 ELSE 0 END AS jobs,
  {_case(f"o_orderkey % {len(ERRORS) + 3}", ERRORS, "NULL")} AS error,
  CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice / 10000 END AS seconds, o_orderkey % 37 = 0 AS discovered
FROM {{orders}}
"""

ATTEMPTS = f"""
SELECT 'Company ' || CAST(o_custkey AS STRING) AS company, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt,
  CASE o_orderkey % 3 WHEN 0 THEN 'it_link' WHEN 1 THEN 'career_url' ELSE 'website' END AS seed_field,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Generic HTML' ELSE 'Workday' END AS platform, CASE WHEN o_orderkey % 6 = 0 THEN 5 ELSE 0 END AS jobs,
  {_case(f"o_orderkey % {len(ERRORS) + 3}", ERRORS, "NULL")} AS error, o_orderkey % 5 = 0 AS discovered
FROM {{orders}}
"""

FOUND = """
SELECT l_suppkey AS board, CAST(l_orderkey % 60 AS BIGINT) AS page_no, 'job-' || CAST(l_partkey % 97 AS STRING) AS key, CAST(120 AS BIGINT) AS total FROM {lineitem}
"""

EDGES = """
SELECT l_suppkey AS board, 'p' || CAST(l_orderkey % 40 AS STRING) AS url, 'p' || CAST(l_partkey % 40 AS STRING) AS next_url, l_orderkey * 8 + l_linenumber AS place FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of small tables that one task works on: much is made of each, and a file of few bytes would be one task's however many it holds.
ROWS = {"customer": 10_000, "supplier": 1_000}


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ROWS, dealt out so that tasks grow in number, not in size, with its rows."""
    join_by_measure(spark)
    rows = table(spark, sf_dir, name)
    return rows.repartition(rows.count() // ROWS[name] + 1)


def supplier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, k) of every supplier, the second as text, dealt out."""
    return dealt(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").cast("string").alias("k"))


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of one of the texts above."""
    names = [n for n in ("customer", "lineitem", "orders", "pages", "part", "supplier") if f"{{{n}}}" in text]
    return spark.sql(text, **{n: (dealt if n in ROWS else table)(spark, sf_dir, n) for n in names})


def sql(text: str) -> str:
    """The same for DuckDB, as a bracketed query."""
    for n in ("customer", "lineitem", "orders", "pages", "part", "supplier"):
        text = text.replace(f"{{{n}}}", n)
    return f"({text.strip()})"
