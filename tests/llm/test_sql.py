import pytest

from termloom.llm.queries import QUERIES, SQL
from tests.parity import check


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])
