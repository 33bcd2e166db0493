"""Every core query with SQL gives the rows the SQL gives."""

import pytest

import oracle
from weftline import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, con, name):
    assert oracle.compare(core.queries()[name](spark, small), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert core.queries()[name](spark, small).columns


def test_entry_without_optional_part(spark, small):
    import __spark_entry__ as e

    assert set(core.queries()) <= set(e.queries())
    assert e.entry(spark).count() > 0
