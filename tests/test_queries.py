"""Every query of the library against its SQL."""

import os

import pytest
from parity import connect, same

from graphloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    sql = registry.oracle_sql().get(name)
    assert sql is None or same(df, con, sql) == ""
