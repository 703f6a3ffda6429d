"""Every query of the library against its SQL on the smallest tables."""

import os

import pytest

from stacksift.plans import registry

from .oracle import from_duckdb, from_spark

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = from_spark(QUERIES[name](spark, SF))
    if name in SQL:
        want = from_duckdb(SQL[name], SF)
        assert got == want, f"only in Spark: {list((got - want).items())[:3]}; only in SQL: {list((want - got).items())[:3]}"
    else:
        assert sum(got.values()) > 1
