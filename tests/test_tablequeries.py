"""Queries of scalar functions and summaries against DuckDB."""

import os

import pytest
from pyspark.sql import functions as F
from test_catalogue import TABLES, plain

from tessera.functions import scalars
from tessera.plans import tablequeries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(tablequeries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = tablequeries.QUERIES[name](spark, SF)
    want = duck.execute(tablequeries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want and want


def test_bounds_are_errors(spark):
    with pytest.raises(Exception, match="maximum lies outside"):
        spark.range(1).select(scalars.in_bounds(F.lit(101), 1, 100, "maximum")).collect()
