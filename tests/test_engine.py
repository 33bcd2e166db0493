import json

from pyspark.sql import functions as F

from weftline.engine import Engine, json_safe, upsert_web_results, user_facts
from weftline.operators.security import UserContext
from weftline.plans import agent as ag
from weftline.plans.schema import EntityType


def _engine(spark):
    rows = [("1", "tide table", "heights of the tide at noon", None, 100), ("2", "boat repairs", "how to mend a boat's hull", "u", 100), ("3", "bread", "", "v", 1)]
    df = spark.createDataFrame(rows, "id string, name string, content string, userid string, required_access_level int")
    e = Engine(spark)
    e.register(EntityType("public.Note", {"id": "UUID", "name": "TEXT", "content": "TEXT"}, embedded={"content": "m"}, description="Notes"), df)
    return e


def test_index_is_idempotent_and_search_has_both_legs(spark):
    e = _engine(spark)
    assert e.index("public.Note") == {"nodes": 3, "embeddings": 2}
    assert e.index("public.Note") == {"nodes": 0, "embeddings": 0}
    assert [a[1] for a in e.audit] == ["OK", "OK"]
    a = e.entity("public.Note").search("heights of the tide at noon")
    assert [r.id for r in a.relational.collect()] == ["1"] and [r.id for r in a.vector.collect()] == ["1"] and not a.errors
    a = e.entity("public.Note").search("boat's", semantic_only=True, threshold=None, limit=1)
    assert a.relational is None and a.confidence == 0 and a.vector.count() == 1
    e.planner = lambda q, t: ("no such column >", 0.9)
    assert e.entity("public.Note").search("x").errors


def test_repository(spark):
    e = _engine(spark)
    r = e.entity("public.Note", UserContext("u", 100))
    assert {x.id for x in r.rows.collect()} == {"1", "2"}
    assert r.get_by_name("boat repairs")["id"] == "2" and r.get_by_id("9") is None
    r.update_records(spark.createDataFrame([("2", "boat's", "it's", "u", 100)], "id string, name string, content string, userid string, required_access_level int"))
    assert r.get_by_id("2")["content"] == "it's"
    e.index("public.Note")
    r.delete_records(spark.createDataFrame([("1",)], "id string"))
    assert {x.id for x in e.frames["public.Note"].collect()} == {"2", "3"} and e.embeddings["public.Note"].where("source_record_id = '1'").count() == 0
    assert "| content | TEXT |" in r.prompt(["name"])
    assert set(e.get_entities(["bred", "bread"], user="v", fuzzy=True)) == {"public.Note"} and e.get_entities([""]) == {}
    assert [x.id for x in r.page(["-id"], 1).collect()] == ["2"]


def test_agent_loop():
    f = ag.Functions()

    def weather(city: str) -> dict:
        """Weather of a city."""
        return {"city": city}

    f.add(weather)
    f.add(lambda: 1, name="secret", level=1, spec={"name": "secret", "parameters": {}})
    answers = iter([{"tool_calls": [{"id": "c1", "function": {"name": "weather", "arguments": '{"city": "x"}'}}], "finish_reason": "tool_calls"}, {"content": "sunny", "finish_reason": "stop", "usage": {"prompt_tokens": 5, "completion_tokens": 2}}])
    turns = list(ag.run("?", lambda m, t: next(answers), f, level=100))
    assert [t.status for t in turns] == [ag.COMPLETED, ag.TOOL_CALL, ag.COMPLETED] and turns[-1].function_stack == ["weather"]
    assert json.loads(turns[1].tool_eval_data)[0]["data"] == {"city": "x"}
    assert [s["name"] for s in f.visible(100)] == ["weather"] and len(f.visible(None)) == 2
    loop = list(ag.run("?", lambda m, t: {"tool_calls": [{"function": {"name": "nope"}}]}, f, limit=2))
    assert [t.status for t in loop[1:]] == [ag.TOOL_ERROR, ag.TOOL_ERROR]
    assert list(ag.run("?", lambda m, t: 1 / 0, f))[-1].status == ag.ERROR


def test_cache_and_voice():
    now = [0.0]
    c = ag.Cache(2, 10, lambda: now[0])
    assert [c.get(k, lambda k=k: k) for k in "aab"] == ["a", "a", "b"] and c.hit_rate == 1 / 3
    now[0] = 11
    assert c.get("a", lambda: "new") == "new"
    c.get("c", lambda: "c")
    assert len(c.items) == 2
    assert ag.voice_segments([-90] * 10 + [-10] * 40 + [-90] * 60 + [-10] * 10) == [(0.1, 0.5)]
    assert ag.voice_segments([-90] * 100) == [(0.0, 1.0)]


def test_small_things(spark):
    res = spark.createDataFrame([], "id string, name string, category string, content string, summary string, ordinal int, uri string")
    links = spark.createDataFrame([], "id string, session_id string, resource_id string")
    hits = spark.createDataFrame([("http://a", "A", "s", "c", 0.5), ("http://a", "A", "s", "c", 0.5), (None, "x", "s", "c", 0.1)], "url string, title string, summary string, content string, score double")
    r, li = upsert_web_results(res, links, hits, "t")
    r, li = upsert_web_results(r, li, hits, "t")
    assert r.count() == 1 and li.count() == 1
    assert user_facts({"likes": "tea"}, "u", spark).select("id").distinct().count() == 1
    deep: dict = {}
    deep["x"] = {"y": deep}
    assert json.dumps(json_safe({"d": spark.range(1).select(F.current_date().alias("d")).first(), "s": {1, 2}, "deep": deep}))


def test_native_functions_plan_and_resume(spark):
    e, functions = _engine(spark), ag.Functions()
    e.index("public.Note")
    active = ag.add_native(functions, e, lambda messages, tools: {"content": messages[-2]["content"]})
    call = lambda name, **args: functions.evaluate({"function": {"name": name, "arguments": json.dumps(args)}})
    assert call("get_entities", keys=["bread"]) == {} and [r["id"] for r in call("get_entities", keys=["tide table"])["public.Note"]] == ["1"]
    assert call("search", question="heights of the tide at noon", entity_table_name="public.Note")["vector"][0]["id"] == "1"
    assert "get_entities" in call("help", question="how?") and call("announce_generate_large_output", estimated_length=9)["estimated_length"] == 9
    assert call("activate_functions_by_name", function_names=["search", "nothing"]) == ["search"] and active == {"search"}
    assert ag.plan("how?", lambda m, t: 1 / 0, functions).status == ag.ERROR
    state = json.dumps([{"role": "system", "content": "be brief"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": None}])
    seen = []
    turns = list(ag.resume(state, lambda m, t: seen.append(m) or {"content": "yes", "finish_reason": "stop"}, functions, "s"))
    assert [t.content for t in turns] == ["yes"] and [m["content"] for m in seen[0]] == ["be brief", "hi"]
    assert list(ag.resume("[]", lambda m, t: {}, functions, "s")) == []


def test_upload_report_has_all_columns(spark):
    import datetime as dt

    from weftline.operators.search import upload_report

    t = dt.datetime(2025, 1, 1)
    up = [("u1", "tide table.csv", "text/csv", 10, 10, "done", t, t, "s3://a", ["x"], None, "me"), ("u2", "bread.txt", "text/plain", 5, 2, "open", t, None, "s3://b", None, "r", None), ("u3", None, None, None, None, None, None, t, None, ["x"], None, "me")]
    uploads = spark.createDataFrame(up, "id string, filename string, content_type string, total_size long, uploaded_size long, status string, created_at timestamp_ntz, updated_at timestamp_ntz, s3_uri string, tags array<string>, resource_id string, userid string")
    chunks = spark.createDataFrame([("c1", "s3://a", "A", "four", t), ("c2", "s3://a", "B", None, t), ("c2", "s3://a", "B", None, t)], "id string, uri string, name string, content string, created_at timestamp_ntz")
    semantic = spark.createDataFrame([("s3://b", 0.4), ("s3://b", 0.5), ("s3://a", -1.0), (None, 0.9)], "uri string, semantic_score double")
    got = upload_report(uploads, chunks, semantic, "tide table").collect()
    assert len(got[0]) == 17 and [(r.upload_id, r.chunk_count, r.resource_size, r.resource_name) for r in got] == [("u1", 2, 4, "B"), ("u2", 0, 0, None)]
    assert got[1].semantic_score == 0.5 and {r.upload_id for r in upload_report(uploads, chunks, None, None, user="me", tags=["x"]).collect()} == {"u1", "u3"}
    assert upload_report(uploads.limit(0), chunks.limit(0), semantic.limit(0), "x").count() == 0
