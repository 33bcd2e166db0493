"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def current(t: str, order: str = "updated_at desc nulls last") -> str:
    """SQL of the current rows of a table: the latest delivery of each id."""
    return f"(select * from (select *, row_number() over (partition by id order by {order}) as _rn from {t} where id is not null) where _rn = 1)"
