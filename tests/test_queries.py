"""Every registered query with SQL gives DuckDB's rows, on small tables."""

import pytest

from kinograph.queries import ORACLES, QUERIES
from tests.compare import connection, differences

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""
