"""The queries of this subpackage over the smallest tables, and those with SQL against it."""

import pytest

import oracle
from weftline.llm import queries as q

SQL = q.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, con, name):
    assert oracle.compare(q.queries()[name](spark, small), con, SQL[name]) == []


FOUND = {"p4_found": ["src_table", "record_id", "pii_type", "nth"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(SQL)))
def test_runs_without_repeats(spark, small, name):
    df = q.queries()[name](spark, small)
    assert df.columns == FOUND.get(name, df.columns)
    assert df.count() == df.distinct().count() > 0
