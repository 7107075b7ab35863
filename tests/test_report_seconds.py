"""Seconds of the outcome reports where they lie on or next to a tie, against SQL."""

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["report_rows_no_jobs", "report_rows_technical"])
def test_ties_as_in_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CAST(o_orderkey * 500 AS DOUBLE) AS o_totalprice) FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{DATA}/customer.parquet') TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).select("row_id", "seconds").collect()
    wanted = con.execute(f"SELECT row_id, seconds FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert wanted and sorted(map(tuple, got)) == sorted(wanted)
