import pytest

from lexmill.plans import queries
from tests.oracle import SMALL, assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_entry_has_a_query_and_sql_for_each_operator(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "doc_key", "doc_id", "score", "rank"]
