"""Every registered query equals its DuckDB oracle on the same parquet (sf0.001)."""

import pytest

from loadkit.catalog import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    problems, _ = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert not problems, problems


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(QUERIES) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
