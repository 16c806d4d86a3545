import pytest

from loadkit.llm.catalog import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    problems, rows = compare(QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), ORACLE[name])
    assert not problems and rows
