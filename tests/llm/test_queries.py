"""All queries run on the small tables; those with SQL agree with DuckDB."""

import pytest

from mailjobs.llm import oracles, queries
from tests.helpers import same

QUERIES, ORACLES = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
