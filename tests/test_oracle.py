"""Every catalogue query with an oracle, against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from tests.compare import connect, difference
from tidewatch.plans.catalog import all_oracle_sql, all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_queries(), all_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
