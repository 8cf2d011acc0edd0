"""Every registered relational query against its SQL on the smallest tables."""

import pytest

from lakemill.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, FOLDER).columns
        return
    compare(QUERIES[name](spark, FOLDER), con, ORACLES[name])
