"""Tools of agents, access, sessions, uploads and memories over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import engine
from weftline.catalog import frames
from weftline.catalog.registry import current, query
from weftline.operators import entities, security
from weftline.operators import messages as m
from weftline.operators import sessions as ses
from weftline.session import table

_FUNCTIONS = "(select name, description, case when json_valid(function_spec) then function_spec::json end as spec from " + current("api_functions") + " where name is not null)"


def _functions(spark: SparkSession, d: str) -> DataFrame:
    f = frames.current(spark, d, "api_functions", ["name", "description", "function_spec"]).where("name is not null")
    return f.withColumn("function_spec", F.when(F.try_parse_json("function_spec").isNotNull(), F.col("function_spec")))


@query(f"select name, coalesce(spec ->> '$.description', description) as described, count(*) as n from {_FUNCTIONS} group by 1, 2")
def h3_tools_all(spark: SparkSession, d: str) -> DataFrame:
    f = _functions(spark, d)
    tools = m.tools_of(f, f.select("name"), "anthropic")
    return tools.select("name", F.get_json_object("tool", "$.description").alias("described")).groupBy("name", "described").agg(F.count("*").alias("n"))


_ASKED = "(select id, unnest(json_keys(functions)) as name from " + current("agents") + " where json_valid(functions) and json_type(functions) = 'OBJECT')"


@query(f"select id, a.name, coalesce(spec ->> '$.description', description) as described from {_ASKED} a join {_FUNCTIONS} f on a.name = f.name")
def b13_agent_tools(spark: SparkSession, d: str) -> DataFrame:
    a = frames.current(spark, d, "agents", ["functions"]).where(F.try_parse_json("functions").isNotNull() & F.col("functions").rlike(r"^\s*\{"))
    tools = m.agent_tools(a, _functions(spark, d), "id", "functions", add_defaults=False)
    return tools.select("id", "name", F.get_json_object("tool", "$.function.description").alias("described"))


@query("""select t, count(*) filter (10 <= coalesce(l, 5) or userid = u) as n from (select 'resources' as t, userid, required_access_level as l from resources union all select 'ai_responses', userid, required_access_level from ai_responses), (select min(userid) as u from resources)
group by 1""")
def g2_secured_tables(spark: SparkSession, d: str) -> DataFrame:
    who = table(spark, d, "resources").agg(F.min("userid")).first()[0]
    e = engine.Engine(spark)
    for name in ("resources", "ai_responses"):
        e.frames[name] = table(spark, d, name).select("userid", "groupid", "required_access_level")
    seen = e.secure_all(security.UserContext(who, security.PARTNER))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n, df in seen.items()]
    return parts[0].unionByName(parts[1])


@query("select id from (select *, 0 as x from " + current("api_functions") + ") where 5 <= coalesce(required_access_level, 100)")
def g5_allowed_functions(spark: SparkSession, d: str) -> DataFrame:
    return security.allowed_functions(frames.current(spark, d, "api_functions", ["required_access_level"]), security.INTERNAL).select("id")


@query("select id, coalesce(session_completed_at, case when session_type is null then timestamp '2030-01-01' end) as done from " + current("chat_sessions"))
def h7_complete_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = frames.current(spark, d, "chat_sessions", ["session_type", "session_completed_at"]).withColumn("updated_at", F.col("session_completed_at"))
    out = ses.complete_sessions(s, s.where("session_type is null"), F.lit("2030-01-01").cast("timestamp_ntz"))
    return out.select("id", F.col("session_completed_at").alias("done"))


@query("""select upload_id from (select o_orderkey::varchar as upload_id, o_orderdate as u from orders where o_orderstatus in ('F') and o_custkey % 2 = 0 and lower(o_orderpriority) like '%urgent%' order by u desc, upload_id limit 15 offset 5)""")
def p33_list_uploads(spark: SparkSession, d: str) -> DataFrame:
    u = frames.uploads(spark, d).withColumn("status", F.when(F.col("userid").cast("long") % 2 == 0, "done").otherwise("open"))
    return ses.list_uploads(u, tags=["F"], status="done", text="urgent", limit=15, offset=5).select("upload_id")


@query("select c_custkey, case when c_custkey % 3 = 0 then 'new' || c_custkey else c_name end as token from customer")
def p35_sync_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("token"))
    return ses.sync_keys(c, "c_custkey", c.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("token")))


@query("select id, session_type from (select * from " + current("chat_sessions") + ") where updated_at > timestamp '2025-01-15' and session_type is not null and userid in (select userid from resources) order by updated_at desc, id limit 50")
def p11_recent_memories(spark: SparkSession, d: str) -> DataFrame:
    s = frames.current(spark, d, "chat_sessions", ["session_type", "userid", "updated_at"])
    kinds = [r[0] for r in table(spark, d, "chat_sessions").select("session_type").where("session_type is not null").distinct().collect()]  # a handful
    users = table(spark, d, "resources").where("userid is not null").select(F.col("userid").alias("id")).distinct()
    return engine.recent_memories(s, users, dt.datetime(2025, 1, 15), kinds, 50).select("id", "session_type")


@query("select n_nationkey as key, n_name as prompt from nation where n_name like '%A'")
def b11_prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    """The table of fields that a prompt shows, one line a field, found again in the text."""
    rows = [(r.n_nationkey, r.n_name) for r in table(spark, d, "nation").where("n_name like '%A'").collect()]  # a fixed table
    prompt = entities.markdown_prompt("Nations", "All of them", [(n, str(k), "") for k, n in rows], {"region": ["x", "y"]})
    lines = [x.split(" | ") for x in prompt.splitlines() if x.startswith("| ") and x[2:5] not in ("fie", "---")]
    return spark.createDataFrame([(int(x[1]), x[0][2:]) for x in lines], "key long, prompt string").select(F.col("key"), "prompt")


@query("select userid, count(*) as n, count(distinct session_id) as sessions from (select lower(session_id) as session_id, userid from " + current("ai_responses") + " where userid is not null and created_at >= timestamp '2025-03-01' and created_at < timestamp '2025-03-08') group by 1")
def p12_digest(spark: SparkSession, d: str) -> DataFrame:
    t = frames.current(spark, d, "ai_responses", ["session_id", "userid", "created_at", "content"])
    return ses.digest(t, dt.datetime(2025, 3, 1), days=7).select("userid", F.col("messages").alias("n"), "sessions")
