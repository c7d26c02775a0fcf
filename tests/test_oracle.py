"""Every query against its SQL counterpart on the smallest tables."""

import __spark_entry__ as entry_module
import compare
import pytest

QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return compare.connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, sf, connection):
    assert compare.difference(QUERIES[name](spark, sf), connection, ORACLE[name]) is None


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns == ["thread_id", "title", "status", "revision", "updated_at"]
    assert result.count() == 20
