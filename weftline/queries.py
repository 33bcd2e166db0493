"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import dialogue, graphs, relational, searching, upkeep  # noqa: F401  (they register themselves)
from weftline.catalog.registry import QUERIES, SQL
from weftline.operators.flatten import flatten_members, flatten_objects
from weftline.operators.latest import latest_rows
from weftline.session import table


def _nested(spark: SparkSession, d: str, build: Callable[..., DataFrame]) -> DataFrame:
    """The four nested columns of the domain, current rows only."""
    agents = latest_rows(table(spark, d, "agents").select(F.lower("id").alias("id"), "updated_at", "spec", "functions"), ["id"], ["updated_at"], ["spec", "functions"])
    apis = latest_rows(table(spark, d, "api_functions").select(F.lower("id").alias("id"), "updated_at", "function_spec"), ["id"], ["updated_at"], ["function_spec"])
    calls = latest_rows(table(spark, d, "ai_responses").select(F.lower("id").alias("id"), "updated_at", "tool_calls"), ["id"], ["updated_at"], ["tool_calls"])
    out = build(agents.where("id is not null"), "id", [("spec", "agents.spec"), ("functions", "agents.functions")])
    out = out.unionByName(build(apis.where("id is not null"), "id", [("function_spec", "api_functions.function_spec")]))
    return out.unionByName(build(calls.where("id is not null and tool_calls is not null"), "id", [("tool_calls", "ai_responses.tool_calls")]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d, flatten_objects).select("src_field", "record_id", "node_path", "parent_path").distinct()


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d, flatten_members)


_OPEN = "case when json_type({j}) = 'VARCHAR' and json_valid(trim({j} ->> '$')) and json_type(trim({j} ->> '$')) in ('OBJECT', 'ARRAY', 'VARCHAR') then trim({j} ->> '$')::json else {j} end"


def _now(t: str, column: str) -> str:
    return f"(select lower(id) as rid, {column} from (select *, row_number() over (partition by lower(id) order by updated_at desc nulls last) as _rn from {t} where id is not null) where _rn = 1)"


P5 = rf"""
with recursive raw as (select 'agents.spec' as src, rid, trim(spec, E' \t\n\r') as t from {_now('agents','spec')} union all select 'agents.functions', rid, trim(functions, E' \t\n\r') from {_now('agents','functions')}
  union all select 'api_functions.function_spec', rid, trim(function_spec, E' \t\n\r') from {_now('api_functions','function_spec')} union all select 'ai_responses.tool_calls', rid, trim(tool_calls, E' \t\n\r') from {_now('ai_responses','tool_calls')}),
a as (select src, rid, t::json as j from raw where json_valid(t)),
a1 as (select src, rid, {_OPEN.format(j='j')} as j from a), a2 as (select src, rid, {_OPEN.format(j='j')} as j from a1), a3 as (select src, rid, {_OPEN.format(j='j')} as j from a2),
n as (
  select src, rid, '$' as path, '$' as owner, j, 0 as depth from a3 where json_type(j) in ('OBJECT', 'ARRAY')
  union all
  select src, rid, path || case when box = 'ARRAY' then '[' || k || ']' else '.' || k end, case when box = 'OBJECT' then path else owner end, {_OPEN.format(j=_OPEN.format(j='v'))}, depth + 1
  from (select n.src, n.rid, n.path, n.owner, n.depth, json_type(n.j) as box, e.key as k, e.value as v from n, json_each(n.j) e where json_type(n.j) in ('OBJECT', 'ARRAY') and n.depth < 40))
"""
P5_FOUND = P5 + "select distinct src as src_field, rid as record_id, path as node_path, owner as parent_path from n where json_type(j) = 'OBJECT' and depth > 0"
P5_MEMBERS = P5.replace("where json_type(j) in ('OBJECT', 'ARRAY')\n  union all", "union all", 1) + """select distinct src as src_field, rid as record_id, owner as node_path, path as member_path,
case json_type(j) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind, case json_type(j) when 'VARCHAR' then j ->> '$' else j::varchar end as value from n where json_type(j) not in ('OBJECT', 'ARRAY')"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return searching.hybrid_search(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p5_found": p5_found, "p5_members": p5_members} | QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND, "p5_members": P5_MEMBERS} | SQL
