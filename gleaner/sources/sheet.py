"""The sheet of companies: CSV files whose columns go by several names."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.fixed import HEADER_ALIASES
from gleaner.functions.urls import stripped

REQUIRED = ["company", "website", "career_url"]


class SheetError(ValueError):
    """A sheet that can't be read as one of companies."""


def _plain(header: str) -> str:
    return re.sub("[^a-z0-9]+", "", header.strip().lower())


def resolve(header: list[str]) -> dict[str, int]:
    """Place of each known column: the first alias in order that a header spells, of equal headers the first."""
    places: dict[str, int] = {}
    for i, name in enumerate(header):
        places.setdefault(_plain(name), i)
    found = {}
    for column, aliases in HEADER_ALIASES.items():
        at = [places[_plain(a)] for a in aliases if _plain(a) in places]
        if at:
            found[column] = at[0]
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise SheetError(f"columns not found: {', '.join(missing)}; the sheet has: {', '.join(header)}")
    return found


def read_companies(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(row_id, company, website, career_url, it_link) of CSV at a path; row_id grows with the place in the files.

    Cells are text without outer blanks, an empty one is an empty string, and N/A stays as it is. Rows that
    are blank or name no company go. multi_line reads line breaks within quotes, one task a file. Each file of a
    folder is read by its own header; files of other columns stand after those like the first.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.min("at").alias("at")).orderBy("at").collect()  # a row for each file of the sheet
    if not heads:
        raise SheetError(f"{path} is empty")
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in heads:
        groups.setdefault(tuple(next(csv.reader([r["head"].removeprefix("\ufeff")]), [])), []).append(r["file"])
    tables = []
    for header, files in groups.items():
        at = resolve(list(header))
        schema = ", ".join(f"c{i} string" for i in range(len(header)))
        rows = spark.read.csv(path if len(groups) == 1 else files, schema=schema, header=True, quote='"', escape='"', nullValue="", multiLine=multi_line, encoding="UTF-8", mode="PERMISSIVE")
        tables.append(rows.select([stripped(F.col(f"c{at[c]}")).alias(c) if c in at else F.lit("").alias(c) for c in HEADER_ALIASES]))
    return reduce(DataFrame.union, tables).select(F.monotonically_increasing_id().alias("row_id"), "*").where("company <> ''")
