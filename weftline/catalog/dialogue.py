"""Messages, provider mappings, stream folding, sessions and uploads over the test tables."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import frames
from weftline.catalog.registry import current, query
from weftline.operators import entities
from weftline.operators import messages as m
from weftline.session import shared_folder, table
from weftline.streaming import streams


def _turns(spark: SparkSession, d: str) -> DataFrame:
    t = frames.current(spark, d, "ai_responses", ["session_id", "role", "content", "tool_calls", "tool_eval_data", "created_at", "updated_at", "model_name", "status", "function_stack"])
    return t.where("session_id is not null").withColumn("session_id", F.lower("session_id")).withColumn("role", m.speaker(F.col("role")))


_WHO = "case when regexp_replace(lower(trim(role)), '[ -]+', '_', 'g') in ({}) then '{}'"
_ROLE = " ".join(_WHO.format(", ".join(f"'{x}'" for x in names), who).replace("case ", "", 1) for who, names in m.SPEAKERS.items())
_T = f"(select id, lower(session_id) as session_id, case {_ROLE} end as role, content, tool_calls, tool_eval_data, created_at, model_name, status, function_stack from " + current("ai_responses") + " where session_id is not null)"


_OPEN = "case when json_type({0}) = 'VARCHAR' and json_valid(trim({0} ->> '$')) and json_type(trim({0} ->> '$')) in ('OBJECT', 'ARRAY', 'VARCHAR') then trim({0} ->> '$')::json else {0} end"
#: calls and results of all messages: session_id, id, created_at, side, x (an object)
_TOOLS = f"""t0 as (select session_id, id, created_at, 'call' as side, trim(tool_calls) as t from {_T} where tool_calls is not null union all select session_id, id, created_at, 'result', trim(tool_eval_data) from {_T} where tool_eval_data is not null),
t1 as (select session_id, side, t::json as j from t0 where json_valid(t)), t2 as (select session_id, side, {_OPEN.format('j')} as j from t1), t3 as (select session_id, side, {_OPEN.format('j')} as j from t2),
t4 as (select session_id, side, unnest(case when json_type(j) = 'ARRAY' then from_json(j, '["json"]') else [j] end) as x from t3),
tools as (select session_id, side, x, coalesce(x ->> '$.function.name', x ->> '$.functionCall.name', x ->> '$.function_call.name', x ->> '$.name') as name from t4 where json_type(x) = 'OBJECT' and x::varchar <> '{{}}')"""


def _full_turns(spark: SparkSession, d: str) -> DataFrame:
    return m.canonical_turns(_turns(spark, d))


@query(f"""with {_TOOLS}, u as (select distinct session_id, 0 as rank, 'system' as role, 'text' as kind, 'be brief' as content from {_T} union all select session_id, 1, role, 'text', content from {_T} where role = 'user'
union all select session_id, 2, role, 'text', content from {_T} where role = 'assistant' and content is not null union all select session_id, 2, 'assistant', 'call', name from tools where side = 'call' and name is not null
union all select session_id, 2, 'tool', 'result', null from tools where side = 'result')
select session_id, rank, role, kind, count(*) as n, min(content) as first from u group by 1, 2, 3, 4""")
def e7_canonical_messages(spark: SparkSession, d: str) -> DataFrame:
    c = m.canonical_messages(_full_turns(spark, d), prompt="be brief")
    kind = F.when(F.col("role") == "tool", "result").when(F.col("tool_call_id").isNotNull(), "call").otherwise("text")
    shown = F.when(kind != "result", F.col("content"))
    return c.groupBy("session_id", "rank", "role", kind.alias("kind")).agg(F.count("*").alias("n"), F.min(shown).alias("first"))


@query("""select (user_id % 50)::varchar as session_id, 'assistant' as role, 'c' || event_id as tool_call_id, event_type as content from events
union all select (user_id % 50)::varchar, 'tool', 'c' || event_id, event_id::varchar from events""")
def e7_tool_messages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ident = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    calls = F.to_json(F.array(F.struct(ident.alias("id"), F.lit("function").alias("type"), F.struct(F.col("event_type").alias("name"), F.lit("{}").alias("arguments")).alias("function"))))
    results = F.to_json(F.array(F.struct(ident.alias("id"), F.col("event_id").cast("string").alias("data"))))
    t = e.select((F.col("user_id") % 50).cast("string").alias("session_id"), F.lit("tool").alias("role"), F.lit(None).cast("string").alias("content"), calls.alias("tool_calls"), results.alias("tool_eval_data"), F.col("ts").alias("created_at"))
    return m.canonical_messages(t).where("tool_call_id is not null").select("session_id", "role", "tool_call_id", "content")


@query(f"""with {_TOOLS}, n as (select session_id, count(*) as n from (select session_id from {_T} where (role = 'assistant' and content is not null) or role = 'user' union all select session_id from tools where side = 'result' or name is not null) group by 1),
l as (select * from (select session_id, role, updated_at, row_number() over (partition by session_id order by created_at desc, id desc) as rn from {_T.replace('created_at, model_name', 'created_at, updated_at, model_name')}) where rn = 1)
select l.session_id, coalesce(n, 0) + 1 as n, role as last_role, updated_at as last_updated_at from l left join n on n.session_id = l.session_id""")
def e7_messages_json(spark: SparkSession, d: str) -> DataFrame:
    j = m.conversation_state(_full_turns(spark, d))
    return j.select("session_id", F.json_array_length("messages").cast("long").alias("n"), "last_role", "last_updated_at")


@query(f"select id, case role when 'tool' then 'tool_result' else 'text' end as kind, content as body from {_T} where content is not null and role in ('user', 'assistant', 'tool')")
def e8_anthropic_parts(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).where("content is not null and role in ('user', 'assistant', 'tool')")
    p = t.select("id", m.anthropic_part(F.col("role"), F.col("content"), F.when(F.col("role") == "tool", F.col("id"))).alias("p"))
    return p.select("id", F.get_json_object("p", "$.type").alias("kind"), F.coalesce(F.get_json_object("p", "$.text"), F.get_json_object("p", "$.content")).alias("body"))


@query(f"select id, case role when 'tool' then 'functionResponse' else 'text' end as kind, content as body from {_T} where content is not null and role in ('user', 'assistant', 'tool')")
def e9_google_parts(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).where("content is not null and role in ('user', 'assistant', 'tool')")
    p = t.select("id", m.google_part(F.col("role"), F.col("content"), F.when(F.col("role") == "tool", F.col("id"))).alias("p"))
    return p.select("id", F.json_object_keys("p")[0].alias("kind"), F.coalesce(F.get_json_object("p", "$.text"), F.get_json_object("p", "$.functionResponse.response")).alias("body"))


@query(f"select session_id, coalesce(string_agg(content, ' ' order by created_at, content) filter (role = 'system' and content <> ''), '') as system, count(*) filter (role <> 'system') as n_other from {_T} where role in ('system', 'user', 'assistant') group by 1")
def e10_split_system(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).where("role in ('system', 'user', 'assistant')").withColumn("rank", F.lit(0))
    return m.split_system(t)


@query("""select event_id, 'said ' || event_type as msg, 't' || event_id as tool_id, event_type as tool_name, user_id as tokens_in, event_id % 50 as tokens_out, 'tool_use' as finish_reason from events""")
def e11_anthropic_response(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    part = "type string, text string, id string, name string, input struct<k:int>"
    text = F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.concat(F.lit("said "), "event_type").alias("text"))), part)
    use = F.from_json(F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("name"), F.struct(F.lit(1).alias("k")).alias("input"))), part)
    body = F.to_json(F.struct(F.array(text, use).alias("content"), F.struct(F.col("user_id").alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens")).alias("usage"), F.lit("tool_use").alias("stop_reason")))
    return m.anthropic_response(e.select("event_id", body.alias("body")), "body", "event_id").select("event_id", "msg", "tool_id", "tool_name", "tokens_in", "tokens_out", "finish_reason")


@query("""select event_id, event_type as tool_id, event_type as tool_name, user_id as tokens_in, event_id % 50 as tokens_out, 'stop' as finish_reason from events""")
def e12_google_response(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    call = F.struct(F.struct(F.col("event_type").alias("name"), F.struct(F.lit("x").alias("q")).alias("args")).alias("functionCall"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(call).alias("parts")).alias("content"), F.lit("STOP").alias("finishReason"))).alias("candidates"), F.struct(F.col("user_id").alias("promptTokenCount"), (F.col("event_id") % 50).alias("candidatesTokenCount")).alias("usageMetadata")))
    return m.google_response(e.select("event_id", body.alias("body")), "body", "event_id").select("event_id", "tool_id", "tool_name", "tokens_in", "tokens_out", "finish_reason")


@query(f"select session_id, id, model_name, status from (select *, row_number() over (partition by session_id order by created_at desc, id desc) as rn from {_T}) where rn = 1")
def e13_latest_response(spark: SparkSession, d: str) -> DataFrame:
    return m.latest_response(_turns(spark, d))


@query("select event_id, case when event_id % 2 = 0 then 'view,' || event_type || ',help' else event_type || ',help' end as stack from (select event_id, event_type from events where event_type not in ('view'))")
def h1_merge_function_stack(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type != 'view'")
    old = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("view"), F.col("event_type")))
    return e.select("event_id", F.array_join(entities.merged_stack(old, F.array(F.col("event_type"), F.lit("help"))), ",").alias("stack"))


@query(f"""select session_id, list_aggregate(list_sort(list_distinct(list_concat(coalesce(function_stack, []), ['help', 'search']))), 'string_agg', ',') as functions
from (select *, row_number() over (partition by session_id order by created_at desc, id desc) as rn from {_T}) where rn = 1""")
def h2_session_functions(spark: SparkSession, d: str) -> DataFrame:
    return m.session_functions(_turns(spark, d), ["help", "search"]).select("session_id", F.array_join(F.array_sort("functions"), ",").alias("functions"))


@query("""select id, string_agg(k, ',' order by k) as tools from (select id, unnest(json_keys(functions)) as k from """ + current("agents") + """ where json_valid(functions) and json_type(functions) = 'OBJECT') group by 1""")
def b12_tool_names(spark: SparkSession, d: str) -> DataFrame:
    a = frames.current(spark, d, "agents", ["functions"]).where(F.try_parse_json("functions").isNotNull() & F.col("functions").rlike(r"^\s*\{"))
    return a.select("id", entities.tool_names(F.col("functions"), False).alias("t")).where(F.size("t") > 0).select("id", F.array_join(F.array_sort("t"), ",").alias("tools"))


_S = "(select id, userid, lower(thread_id) as thread_id, query, created_at, updated_at from " + current("chat_sessions") + " where userid is not null and thread_id is not null)"


@query(f"""with l as (select userid, thread_id, row_number() over (partition by userid order by updated_at desc, thread_id desc) as rn from {_S})
select s.userid, s.thread_id, count(*) as n, coalesce(string_agg(s.query, '|' order by s.created_at, s.id), '') as questions from {_S} s join l on l.rn = 1 and s.userid = l.userid and s.thread_id = l.thread_id group by 1, 2""")
def h8_thread_questions(spark: SparkSession, d: str) -> DataFrame:
    s = frames.current(spark, d, "chat_sessions", ["userid", "thread_id", "query", "created_at", "updated_at"])
    return m.user_threads(s).select("userid", "thread_id", F.size("questions").cast("long").alias("n"), F.array_join("questions", "|").alias("questions"))


@query("""with me as (select min(userid) as u from resources), r as (select *, coalesce(case when json_valid(metadata) then json_extract_string(metadata, '$.source_file') end, uri) as source_file from """ + current("resources") + """ where userid = (select u from me))
select source_file, max(uri) as uri, count(*) as chunk_count, coalesce(string_agg(name, '|' order by ordinal, name), '') as chunks from r group by 1 order by min(created_at) desc, source_file limit 10""")
def client_recent_uploads(spark: SparkSession, d: str) -> DataFrame:
    me = table(spark, d, "resources").agg(F.min("userid")).first()[0]
    r = frames.current(spark, d, "resources", ["userid", "uri", "name", "ordinal", "metadata", "created_at", "updated_at"])
    return m.recent_uploads(r, me).select("source_file", "uri", "chunk_count", F.array_join("chunks", "|").alias("chunks"))


@query("""select user_id::varchar as audio_file_id, string_agg('[' || printf('%.1f', event_id % 100 + 0.5) || ' - ' || printf('%.1f', event_id % 100 + 1.5) || ']: ' || event_type, chr(10) || chr(10) order by event_id % 100, '[' || printf('%.1f', event_id % 100 + 0.5) || ' - ' || printf('%.1f', event_id % 100 + 1.5) || ']: ' || event_type) as content from events group by 1""")
def client_transcript(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = F.col("event_id") % 100
    return m.transcript(e.select(F.col("user_id").cast("string").alias("audio_file_id"), (t + 0.5).alias("start_time"), (t + 1.5).alias("end_time"), F.col("event_type").alias("transcription")))


# ---------------------------------------------------------------- streams


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = F.col("event_id") < 400
    return e.select(
        (F.col("user_id") % 40).cast("string").alias("stream_id"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 3).alias("call_index"),
        F.when(first, F.concat(F.lit("id"), F.col("event_id").cast("string"))).alias("id"),
        F.when(first, F.col("event_type")).alias("name"),
        F.substring("event_type", 1, 2).alias("arguments"),
        F.col("event_type").alias("content"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("tokens_in"),
        F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("tokens_out"),
        F.lit(None).cast("string").alias("finish_reason"),
    )


@query("""select (user_id % 40)::varchar as stream_id, event_id % 3 as call_index, arg_min('id' || event_id, event_id) filter (event_id < 400) as id, arg_min(event_type, event_id) filter (event_id < 400) as name,
string_agg(substring(event_type, 1, 2), '' order by event_id) as arguments from events group by 1, 2""")
def s2_fold_calls(spark: SparkSession, d: str) -> DataFrame:
    return m.fold_calls(_deltas(spark, d))


@query("select (user_id % 40)::varchar as stream_id, max(event_id) filter (event_id % 2 = 0) as tokens_in, arg_max(user_id, event_id) filter (event_id % 5 = 0) as tokens_out from events group by 1")
def s3_last_usage(spark: SparkSession, d: str) -> DataFrame:
    return m.last_usage(_deltas(spark, d), ["tokens_in", "tokens_out"])


@query("select (user_id % 40)::varchar as stream_id, string_agg(event_type, '' order by event_id) as content from events group by 1")
def s4_stream_content(spark: SparkSession, d: str) -> DataFrame:
    return m.fold_content(_deltas(spark, d))


def _scratch(spark: SparkSession) -> str:
    return shared_folder(spark, "streams")


def _memory(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    name = f"q{os.urandom(6).hex()}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", _scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("""select (user_id % 40)::varchar as stream_id, event_id % 3 as call_index, arg_min('id' || event_id, event_id) filter (event_id < 400) as id, arg_min(event_type, event_id) filter (event_id < 400) as name,
string_agg(substring(event_type, 1, 2), '' order by event_id) as arguments from events group by 1, 2""")
def s2_fold_calls_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stateful stream; the last delta of each stream finishes it."""
    folder = f"{_scratch(spark)}/deltas"
    last = _deltas(spark, d).groupBy("stream_id").agg(F.max("seq").alias("seq")).withColumn("end", F.lit(True))
    marked = _deltas(spark, d).join(last, ["stream_id", "seq"], "left").withColumn("finish_reason", F.when(F.col("end"), "tool_calls")).drop("end")
    marked.write.parquet(folder)
    stream = spark.readStream.schema(marked.schema).parquet(folder).select("stream_id", "seq", "call_index", "id", "name", "arguments", "finish_reason")
    return _memory(spark, streams.fold_call_stream(stream))


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def z_stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = _memory(spark, streams.tumbling(streams.event_stream(spark, d)), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""with w as (select unnest([0, 15, 30, 45]) as o), x as (select time_bucket(interval 15 minute, ts) - to_minutes(o) as window_start, event_type, value from events, w)
select window_start, event_type, count(*) as n, round(sum(value), 4) as total from x group by 1, 2""")
def z_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sliding(e).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
y as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from x)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from y group by user_id, s""")
def z_session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = streams.sessions(e)
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("select count(*) as n, count(distinct event_id) as ids from events")
def s1_incremental_index(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the incremental index over the same files: the second adds nothing."""
    base = _scratch(spark)
    out = f"{base}/index"

    def target() -> DataFrame | None:
        try:
            return spark.read.parquet(out)
        except AnalysisException:  # nothing is written yet
            return None

    for i in range(2):
        q = streams.incremental_index(streams.event_stream(spark, d), target, lambda df: df.write.mode("append").parquet(out), "event_id", lambda df: df.select("event_id", "event_type"), f"{base}/c{i}")
        q.awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("""select l_orderkey, l_linenumber, expected, expected = pos as accepted from (select l_orderkey, l_linenumber, l_partkey, l_linenumber * 10 as pos,
coalesce(sum(10) over (partition by l_orderkey order by l_linenumber * 10, l_partkey rows between unbounded preceding and 1 preceding), 0)::bigint as expected from (select distinct l_orderkey, l_linenumber, 0 as l_partkey from lineitem))""")
def s7_upload_offsets(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    ch = li.select(F.col("l_orderkey").alias("upload_id"), "l_linenumber", (F.col("l_linenumber") * 10).alias("chunk_offset"), F.lit(10).alias("chunk_size"))
    return m.next_offsets(ch).select(F.col("upload_id").alias("l_orderkey"), "l_linenumber", F.col("expected_offset").alias("expected"), "accepted")


@query("""select c_custkey, c_custkey * interval 1 hour + timestamp '2025-01-01' + (c_nationkey * interval 1 hour) as next_sync from customer where false
union all select o_orderkey, timestamp '1999-01-01' + (o_custkey % 48) * interval 1 hour from orders where o_orderstatus = 'O' and o_orderdate <= timestamp '1999-01-01'""")
def s8_due_syncs(spark: SparkSession, d: str) -> DataFrame:
    from weftline.sources.files import due_syncs

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("c_custkey"), (F.col("o_orderstatus") == "O").alias("enabled"), F.col("o_orderdate").cast("timestamp").alias("next_sync"), (F.col("o_custkey") % 48).cast("int").alias("interval_hours"))
    return due_syncs(o, F.lit("1999-01-01").cast("timestamp")).select("c_custkey", F.col("next_sync").cast("timestamp_ntz").alias("next_sync"))


@query("""with s as (select o_custkey as config_id, o_orderkey as remote_id, o_orderdate as modified from orders where o_orderkey % 3 > 0)
select l.o_orderkey as remote_id from orders l left join s on s.config_id = l.o_custkey and s.remote_id = l.o_orderkey where s.remote_id is null or s.modified < l.o_orderdate + (case when l.o_orderkey % 5 = 0 then interval 1 day else interval 0 day end)""")
def s8_changed_files(spark: SparkSession, d: str) -> DataFrame:
    from weftline.sources.files import changed_files

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("config_id"), F.col("o_orderkey").alias("remote_id"), F.col("o_orderdate").alias("modified"))
    later = o.withColumn("modified", F.when(F.col("remote_id") % 5 == 0, F.col("modified") + F.expr("interval 1 day")).otherwise(F.col("modified")))
    return changed_files(later, o.where("remote_id % 3 > 0")).select("remote_id")


@query("""with s as (select user_id as g, epoch_us(ts) / 1e6 - 1704067200 as start, epoch_us(ts) / 1e6 - 1704067200 + 600 as "end" from events),
r as (select *, case when lag("end") over w is null or start - lag("end") over w > 0.3 then 1 else 0 end as nw from s window w as (partition by g order by start, "end")),
q as (select *, sum(nw) over (partition by g order by start, "end" rows unbounded preceding) as run from r), t as (select g, run, min(start) as a, arg_max("end", (start, "end")) as b from q group by 1, 2),
n as (select *, case when b - a > 900 then floor((b - a) / 900)::int + 1 else 1 end as n from t), p as (select g, a + i * (b - a) / n as s, a + (i + 1) * (b - a) / n as e from n, range(0, n) x(i))
select g as user_id, (row_number() over (partition by g order by s) - 1)::bigint as segment, round(s, 6) as start, round(e, 6) as "end" from p""")
def s11_merge_segments(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    e = table(spark, d, "events").select("user_id", start.alias("start"), (start + 600).alias("end"))
    return m.merge_segments(e, "user_id", longest=900.0)
