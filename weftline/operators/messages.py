"""Chat turns to provider messages, provider responses to rows, stream deltas to calls; all JSON in, columns out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
ANTHROPIC = "struct<content:array<struct<type:string,text:string,id:string,name:string,input:string>>,usage:struct<input_tokens:bigint,output_tokens:bigint>,stop_reason:string,error:string>"
GOOGLE = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,functionCall:struct<name:string,args:string>>>>,finishReason:string>>,usageMetadata:struct<promptTokenCount:bigint,candidatesTokenCount:bigint>>"


# Spellings of the four speakers.
SPEAKERS = {
    "user": ["user", "human", "customer", "client", "end_user", "enduser", "person", "guest"],
    "assistant": ["assistant", "ai", "bot", "model", "agent", "chatbot", "gpt", "llm", "assistant_message"],
    "system": ["system", "developer", "sys", "instruction", "instructions"],
    "tool": ["tool", "function", "tool_result", "tool_response", "function_call_output", "function_response", "ipython", "observation"],
}


def speaker(col: Column) -> Column:
    """One of user, assistant, system, tool; null for anything else."""
    names = F.create_map(*[F.lit(x) for who, names in SPEAKERS.items() for n in names for x in (n, who)])
    return names[F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")]


def opened(value: object) -> object:
    """The value a string of JSON stands for, again and again."""
    while isinstance(value, str):
        try:
            inner = json.loads(value.strip())
        except ValueError:
            break
        if not isinstance(inner, (dict, list, str)):
            break
        value = inner
    return value


def _listed(text: str | None) -> list[dict]:
    """The objects of a JSON object or array; none where the text is not JSON."""
    if text is None:
        return []
    try:
        value = opened(json.loads(text.strip()))
    except ValueError:
        return []
    return [x for v in (value if isinstance(value, list) else [value]) if isinstance(x := opened(v), dict) and x]


def canonical_calls(text: str | None) -> str | None:
    """Calls of any provider's shape as JSON of the canonical one; the name serves where there is no id."""
    out = []
    for c in _listed(text):
        inner = next((x for k in ("function", "functionCall", "function_call") if isinstance(x := opened(c.get(k)), dict)), c)
        name, args = inner.get("name") or c.get("name"), next((inner[k] for k in ("arguments", "args", "input", "parameters") if k in inner), {})
        if name:
            out.append({"id": str(c.get("id") or inner.get("id") or name), "type": "function", "function": {"name": str(name), "arguments": args if isinstance(args, str) else json.dumps(args, ensure_ascii=False)}})
    return json.dumps(out, ensure_ascii=False) if out else None


def canonical_results(text: str | None) -> str | None:
    """Results of calls as JSON [{id, data}], data as text."""
    out = []
    for r in _listed(text):
        ident = next((r[k] for k in ("id", "tool_call_id", "tool_use_id") if r.get(k)), None)
        data = next((r[k] for k in ("data", "content", "output", "result") if k in r), None)
        out.append({"id": None if ident is None else str(ident), "data": data if isinstance(data, str) else json.dumps(data, ensure_ascii=False)})
    return json.dumps(out, ensure_ascii=False) if out else None


def canonical_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with ``tool_calls`` and ``tool_eval_data`` in the canonical shape, whatever provider they came from; text that is no JSON becomes null."""
    at = [turns.columns.index(c) for c in ("tool_calls", "tool_eval_data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            for i, f in zip(at, (canonical_calls, canonical_results), strict=True):
                columns[i] = pa.array([f(t) for t in columns[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return turns.mapInArrow(run, turns.schema)


def conversation_state(turns: DataFrame, question: str | None = None, prompt: str | None = None) -> DataFrame:
    """(session_id, messages, last_role, last_updated_at): the canonical messages of a session as JSON, and its last turn."""
    last = turns.groupBy(F.col("session_id").alias("_s")).agg(F.max_by(F.struct("role", "updated_at"), F.struct("created_at", "id")).alias("l"))
    j = messages_json(canonical_messages(turns, question, prompt))
    return j.join(last, F.col("session_id") == F.col("_s"), "left").select("session_id", "messages", F.col("l.role").alias("last_role"), F.col("l.updated_at").alias("last_updated_at"))


def canonical_messages(turns: DataFrame, question: str | None = None, prompt: str | None = None) -> DataFrame:
    """(session_id, rank, created_at, role, content, tool_call_id): system 0, user 1, then answers, calls and results 2.

    ``turns``: session_id, role, content, tool_calls (JSON of the canonical shape), tool_eval_data (JSON of results), created_at.
    """
    none = F.lit(None).cast("string")
    system = turns.select("session_id").distinct().select("session_id", F.lit(0).alias("rank"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit("system").alias("role"), F.lit(prompt or "").alias("content"), none.alias("tool_call_id"))
    user = turns.where("role = 'user'").select("session_id", F.lit(1).alias("rank"), "created_at", "role", F.lit(question) if question else F.col("content"), none.alias("tool_call_id")).toDF("session_id", "rank", "created_at", "role", "content", "tool_call_id")
    answers = turns.where("role = 'assistant' and content is not null").select("session_id", F.lit(2).alias("rank"), "created_at", "role", "content", none.alias("tool_call_id"))
    calls = turns.select("session_id", "created_at", F.explode(F.from_json("tool_calls", CALLS)).alias("c")).select("session_id", F.lit(2).alias("rank"), "created_at", F.lit("assistant").alias("role"), F.col("c.function.name").alias("content"), F.col("c.id").alias("tool_call_id"))
    results = turns.select("session_id", "created_at", F.explode(F.from_json("tool_eval_data", "array<struct<id:string,data:string>>")).alias("r")).select("session_id", F.lit(2).alias("rank"), "created_at", F.lit("tool").alias("role"), F.col("r.data").alias("content"), F.col("r.id").alias("tool_call_id"))
    return system.unionByName(user).unionByName(answers).unionByName(calls).unionByName(results)


def messages_json(messages: DataFrame) -> DataFrame:
    """(session_id, messages): the messages of a session in order, as JSON."""
    item = F.struct("rank", "created_at", "role", "content", "tool_call_id")
    return messages.groupBy("session_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["tool_call_id"].alias("tool_call_id")))).alias("messages"))


def anthropic_part(role: Column, content: Column, call_id: Column) -> Column:
    """Typed content part of a message: text, tool_use or tool_result, as JSON."""
    return F.when((role == "assistant") & call_id.isNotNull(), F.to_json(F.struct(F.lit("tool_use").alias("type"), call_id.alias("id"), content.alias("name")))).when(role == "tool", F.to_json(F.struct(F.lit("tool_result").alias("type"), call_id.alias("tool_use_id"), content.alias("content")))).otherwise(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))))


def google_part(role: Column, content: Column, call_id: Column) -> Column:
    return F.when((role == "assistant") & call_id.isNotNull(), F.to_json(F.struct(F.struct(content.alias("name")).alias("functionCall")))).when(role == "tool", F.to_json(F.struct(F.struct(call_id.alias("name"), content.alias("response")).alias("functionResponse")))).otherwise(F.to_json(F.struct(content.alias("text"))))


def split_system(messages: DataFrame) -> DataFrame:
    """(session_id, system, n_other): system contents joined by a space, and how many other messages there are."""
    sys_ = F.collect_list(F.when((F.col("role") == "system") & (F.col("content") != ""), F.struct("rank", "created_at", "content")))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(sys_), lambda x: x["content"]), " ").alias("system"), F.count(F.when(F.col("role") != "system", 1)).alias("n_other"))


def anthropic_response(df: DataFrame, body: str, key: str) -> DataFrame:
    """(key, msg, tool_id, tool_name, tool_input, tokens_in, tokens_out, finish_reason): text parts times tool parts, as the mapping has it."""
    r = df.select(F.col(key), F.from_json(body, ANTHROPIC).alias("r"))
    parts = lambda kind: F.filter(F.coalesce("r.content", F.array().cast("array<struct<type:string,text:string,id:string,name:string,input:string>>")), lambda p: p["type"] == kind)
    one = r.select(key, "r", F.explode_outer(parts("text")).alias("t")).select(key, "r", "t", F.explode_outer(parts("tool_use")).alias("u"))
    return one.select(key, F.col("t.text").alias("msg"), F.col("u.id").alias("tool_id"), F.col("u.name").alias("tool_name"), F.col("u.input").alias("tool_input"), F.col("r.usage.input_tokens").alias("tokens_in"), F.col("r.usage.output_tokens").alias("tokens_out"), F.col("r.stop_reason").alias("finish_reason"))


def google_response(df: DataFrame, body: str, key: str) -> DataFrame:
    """As :func:`anthropic_response` for the first part of the first candidate; the name serves as id, the reason in small letters."""
    r = df.select(F.col(key), F.from_json(body, GOOGLE).alias("r")).withColumn("p", F.col("r.candidates")[0]["content"]["parts"][0])
    return r.select(key, F.col("p.text").alias("msg"), F.col("p.functionCall.name").alias("tool_id"), F.col("p.functionCall.name").alias("tool_name"), F.col("p.functionCall.args").alias("tool_input"), F.col("r.usageMetadata.promptTokenCount").alias("tokens_in"), F.col("r.usageMetadata.candidatesTokenCount").alias("tokens_out"), F.lower(F.col("r.candidates")[0]["finishReason"]).alias("finish_reason"))


def canonical_delta(line: str) -> dict | None:
    """Canonical chunk of a stream line of one of three providers; None for blank, malformed and final lines."""
    line = line.strip()
    if line.startswith("data:"):
        line = line[5:].strip()
    if not line or line == "[DONE]":
        return None
    try:
        d = json.loads(line)
    except ValueError:
        return None
    if not isinstance(d, dict):
        return None
    if "choices" in d:
        c = (d["choices"] or [{}])[0]
        delta = c.get("delta") or {}
        return {"content": delta.get("content"), "tool_calls": delta.get("tool_calls") or [], "finish_reason": c.get("finish_reason"), "usage": d.get("usage")}
    kind = d.get("type")
    if kind in ("content_block_start", "content_block_delta", "message_delta", "message_start"):
        block, delta, i = d.get("content_block") or {}, d.get("delta") or {}, d.get("index", 0)
        calls = []
        if block.get("type") == "tool_use":
            calls = [{"index": i, "id": block.get("id"), "function": {"name": block.get("name"), "arguments": ""}}]
        elif delta.get("type") == "input_json_delta":
            calls = [{"index": i, "function": {"arguments": delta.get("partial_json", "")}}]
        reason = {"tool_use": "tool_calls", "end_turn": "stop", "max_tokens": "length"}.get(delta.get("stop_reason"), delta.get("stop_reason"))
        return {"content": delta.get("text") or block.get("text"), "tool_calls": calls, "finish_reason": reason, "usage": d.get("usage") or (d.get("message") or {}).get("usage")}
    if "candidates" in d:
        c = (d["candidates"] or [{}])[0]
        parts = (c.get("content") or {}).get("parts") or []
        calls = [{"index": i, "id": p["functionCall"]["name"], "function": {"name": p["functionCall"]["name"], "arguments": json.dumps(p["functionCall"].get("args", {}))}} for i, p in enumerate(parts) if "functionCall" in p]
        reason = c.get("finishReason")
        return {"content": "".join(p.get("text", "") for p in parts) or None, "tool_calls": calls, "finish_reason": "tool_calls" if calls and reason else reason.lower() if reason else None, "usage": d.get("usageMetadata")}
    return None


def fold_calls(deltas: DataFrame) -> DataFrame:
    """(stream_id, call_index, id, name, arguments) of (stream_id, seq, call_index, id, name, arguments): the first delta of a call opens it, later ones append."""
    item = F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a"))
    return deltas.groupBy("stream_id", "call_index").agg(
        F.min_by("id", F.when(F.col("id").isNotNull(), F.col("seq"))).alias("id"),
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["a"]), "").alias("arguments"),
    )


def fold_content(deltas: DataFrame) -> DataFrame:
    """(stream_id, content): the contents of a stream in order."""
    item = F.struct("seq", F.coalesce("content", F.lit("")).alias("c"))
    return deltas.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]), "").alias("content"))


def last_usage(deltas: DataFrame, fields: list[str]) -> DataFrame:
    """(stream_id, fields): the last value of each usage field, by seq."""
    return deltas.groupBy("stream_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])


def latest_response(turns: DataFrame) -> DataFrame:
    """The last turn of each session: (session_id, id, model_name, status)."""
    return turns.groupBy("session_id").agg(F.max_by(F.struct("id", "model_name", "status"), F.struct("created_at", "id")).alias("x")).select("session_id", "x.*")


def session_functions(turns: DataFrame, names: list[str]) -> DataFrame:
    """(session_id, functions): the stack of the last turn joined with ``names``, distinct; no stack counts as empty."""
    last = turns.groupBy("session_id").agg(F.max_by("function_stack", F.struct("created_at", "id")).alias("stack"))
    return last.select("session_id", F.array_union(F.coalesce("stack", F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("functions"))


def _tool(scheme: str) -> Column:
    """The specification of a function in the shape of a provider, as JSON."""
    get = lambda p: F.get_json_object("function_spec", p)
    params = F.coalesce(get("$.parameters"), get("$.input_schema"))
    base = [F.col("name"), F.coalesce(get("$.description"), F.col("description")).alias("description")]
    if scheme == "anthropic":
        return F.to_json(F.struct(*base, params.alias("input_schema")))
    if scheme == "google":
        return F.to_json(F.struct(F.array(F.struct(*base, params.alias("parameters"))).alias("function_declarations")))
    return F.to_json(F.struct(F.lit("function").alias("type"), F.struct(*base, params.alias("parameters")).alias("function")))


def tools_by_name(functions: DataFrame, names: list[str], scheme: str = "openai") -> DataFrame:
    """(name, tool): function specifications in the shape of a provider, as JSON."""
    f = functions.where(F.col("name").isin(*names)) if names else functions.where("false")
    return f.select("name", _tool(scheme).alias("tool"))


def tools_of(functions: DataFrame, wanted: DataFrame, scheme: str = "openai") -> DataFrame:
    """As :func:`tools_by_name` for the names in a frame, however many."""
    return functions.join(wanted.select("name").distinct(), "name", "left_semi").select("name", _tool(scheme).alias("tool"))


def agent_tools(agents: DataFrame, functions: DataFrame, key: str, column: str, scheme: str = "openai", add_defaults: bool = True) -> DataFrame:
    """(key, name, tool): the specifications of the functions that each agent names; names without a function have none."""
    from weftline.operators.entities import tool_names

    asked = agents.select(F.col(key), F.explode(F.array_distinct(tool_names(F.col(column), add_defaults))).alias("name"))
    return asked.join(functions.select("name", _tool(scheme).alias("tool")), "name").select(key, "name", "tool")


def user_threads(sessions: DataFrame) -> DataFrame:
    """(userid, thread_id, questions): the questions of each user's latest thread in order; thread ids without regard to case."""
    s = sessions.where("userid is not null and thread_id is not null").withColumn("_t", F.lower("thread_id"))
    last = s.groupBy("userid").agg(F.max_by("_t", F.struct("updated_at", "_t")).alias("_t"))
    mine = s.join(last, ["userid", "_t"])
    return mine.groupBy("userid", F.col("_t").alias("thread_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "query"))), lambda x: x["query"]).alias("questions"))


def recent_uploads(resources: DataFrame, user: str, limit: int = 10) -> DataFrame:
    """Uploads of a user, newest first: (source_file, uri, created_at, updated_at, chunk_count, chunks)."""
    r = resources.where(F.col("userid") == user).withColumn("source_file", F.coalesce(F.get_json_object("metadata", "$.source_file"), F.col("uri")))
    g = r.groupBy("source_file").agg(F.max("uri").alias("uri"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.count("*").alias("chunk_count"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("chunks"))
    return g.orderBy(F.desc("created_at"), "source_file").limit(limit)


def next_offsets(chunks: DataFrame, upload: str = "upload_id", offset: str = "chunk_offset", size: str = "chunk_size") -> DataFrame:
    """Each chunk with ``expected_offset`` (sum of the sizes before it) and ``accepted``: a chunk counts only where the upload stands."""
    w = Window.partitionBy(upload).orderBy(offset).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("expected_offset", F.coalesce(F.sum(size).over(w), F.lit(0))).withColumn("accepted", F.col("expected_offset") == F.col(offset))


def merge_segments(segments: DataFrame, group: str, gap: float = 0.3, longest: float = 30.0, shortest: float = 0.5) -> DataFrame:
    """(group, segment, start, end): speech segments merged over small gaps, long ones cut into equal parts, short ones dropped.

    A group whose segments are all too short keeps its first part.
    """
    w = Window.partitionBy(group).orderBy("start", "end")
    new = F.when(F.lag("end").over(w).isNull() | (F.col("start") - F.lag("end").over(w) > gap), 1).otherwise(0)
    runs = segments.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(group, "_run").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"))
    n = F.when(F.col("end") - F.col("start") > longest, F.floor((F.col("end") - F.col("start")) / longest) + 1).otherwise(F.lit(1))
    parts = merged.withColumn("_n", n.cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = (F.col("end") - F.col("start")) / F.col("_n")
    parts = parts.select(group, (F.col("start") + F.col("_i") * step).alias("s"), (F.col("start") + (F.col("_i") + 1) * step).alias("e"))
    order = Window.partitionBy(group).orderBy("s")
    kept = parts.withColumn("_ok", F.col("e") - F.col("s") >= shortest).withColumn("_any", F.max("_ok").over(Window.partitionBy(group))).withColumn("_rn", F.row_number().over(order))
    kept = kept.where("_ok or (not _any and _rn = 1)")
    return kept.select(group, (F.row_number().over(order) - 1).cast("long").alias("segment"), F.round("s", 6).alias("start"), F.round("e", 6).alias("end"))


def transcript(chunks: DataFrame, group: str = "audio_file_id") -> DataFrame:
    """(group, content): ``[start - end]: text`` lines in order of time, a blank line between them."""
    line = F.concat(F.lit("["), F.format_number("start_time", 1), F.lit(" - "), F.format_number("end_time", 1), F.lit("]: "), F.coalesce("transcription", F.lit("")))
    return chunks.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "end_time", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("content"))
