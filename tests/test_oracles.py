"""Every registered query against its SQL in DuckDB, over the whole small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from factweave.plans import registry
from tests.compare import rows_of, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert spark_rows(found) == rows_of(columns, want.fetchall())


def test_no_query_lacks_an_oracle():
    assert set(QUERIES) == set(ORACLES)
