"""Every query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from gleaner.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", catalogue.oracle_sql())
def test_as_in_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    there = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in there.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in there.fetchall()), key=repr)


def test_flagship_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
