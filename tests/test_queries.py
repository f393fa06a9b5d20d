"""Every query of the library against its SQL, or at least that it runs and has rows."""

import pytest

from pagespine import operators

QUERIES, SQL = operators.collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tiny, by_sql, same, name):
    same(QUERIES[name](spark, tiny), *by_sql(SQL[name], tiny))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name):
    """Values are in test_plain and test_pages."""
    assert QUERIES[name](spark, tiny).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
