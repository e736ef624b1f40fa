"""Every registered query on the smallest tables; those with SQL are compared with DuckDB."""

import os

import pytest

from check_sql import compare, connect
from riskmill.plans import QUERIES, SQL

SF = os.environ.get("RISKMILL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, verdict = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0
