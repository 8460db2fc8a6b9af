import pytest

import __spark_entry__ as entry
from termloom.plans.queries import QUERIES, SQL
from tests.parity import DATA, check


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "rank", "doc_id", "score"] and 0 < df.count()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
