"""Every registered query with an oracle agrees with DuckDB on sf0.001."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_against_oracle(spark, con, name, scratch):
    df = E.queries()[name](spark, SF)
    # written and read back: names that clash fail here
    df.write.parquet(scratch + "/out")
    df = spark.read.parquet(scratch + "/out")
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert isinstance(got, list)
        return
    res = con.sql(sql)
    assert sorted(df.columns) == sorted(res.columns)
    assert got == rows_of(res.columns, res.fetchall())


def test_entry(spark):
    out = E.entry(spark)
    assert out.count() > 0
