from pyspark.sql import functions as F

from weftline.operators import sessions as s
from weftline.plans.providers import document_markdown, provider_request

def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def test_sessions(spark):
    req = spark.createDataFrame([("u", "q", "a"), ("u", "q", "a"), ("v", "r", None)], "userid string, query string, agent string")
    new = s.new_sessions(req, now())
    assert new.select("id").distinct().count() == 2
    done = s.complete_sessions(new.dropDuplicates(["id"]), new.where("userid = 'u'"), now())
    assert {r.userid: r.session_completed_at is not None for r in done.collect()} == {"u": True, "v": False}


def test_audit_and_memory(spark):
    have = spark.createDataFrame([("1", "{}", 1)], "id string, metadata string, updated_at int")
    turns = spark.createDataFrame([], "id string, created_at int, content string")
    a, t = s.audit(have, turns, spark.createDataFrame([("1", " {} ", 2)], have.schema), spark.createDataFrame([("t", 1, "x"), ("t", 2, "y")], turns.schema))
    assert a.first().metadata is None and t.first().content == "y"
    users = spark.createDataFrame([("1", "A@x.org"), ("2", None)], "id string, email string")
    assert s.user_memory(users, "a@X.org").count() == 1 and s.user_memory(users, "2").count() == 1


def test_listing_sync_and_sinks(spark):
    up = spark.createDataFrame([("1", "a.csv", ["x"], "DONE", "u", 1), ("2", "B.csv", ["y"], "DONE", "u", 2), ("3", "b.txt", None, "NEW", "v", 3)], "upload_id string, filename string, tags array<string>, status string, userid string, updated_at int")
    ids = lambda **k: [r.upload_id for r in s.list_uploads(up, **k).collect()]
    assert ids() == ["3", "2", "1"] and ids(user="u", tags=["y"]) == ["2"] and ids(text="b") == ["3", "2"] and ids(limit=1, offset=1) == ["2"]
    t = s.sync_keys(spark.createDataFrame([("k", None), ("z", "old")], "key string, token string"), "key", spark.createDataFrame([("k", "new")], "key string, token string"))
    assert {r.key: r.token for r in t.collect()} == {"k": "new", "z": "old"}
    got = []
    s.by_type({"a": lambda d: got.append(d.count())})(spark.createDataFrame([("a", 1), ("a", 2)], "kind string, v int"), 0)
    assert got == [2]


def test_requests_and_documents():
    msgs = [{"role": "system", "content": "s1"}, {"role": "system", "content": "s2"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": '{"a": 1}'}}]}, {"role": "tool", "tool_call_id": "c", "content": "r"}]
    tools = [{"name": "f", "description": "d", "parameters": {"type": "object"}}]
    a = provider_request(msgs, tools, "anthropic")
    assert a["system"] == "s1 s2" and a["messages"][1]["content"][0]["input"] == {"a": 1} and a["tools"][0]["input_schema"] == {"type": "object"}
    g = provider_request(msgs, tools, "google")
    assert g["contents"][1]["role"] == "model" and g["tools"][0]["function_declarations"] == tools
    assert len(provider_request(msgs, tools)["messages"]) == 5
    run = lambda t, **st: {"textRun": {"content": t, "textStyle": st}}
    doc = {"body": {"content": [{"paragraph": {"paragraphStyle": {"namedStyleType": "HEADING_2"}, "elements": [run("Head\n")]}}, {"paragraph": {"bullet": {"nestingLevel": 1}, "elements": [run("x", bold=True), run(" y\n")]}}, {"table": {"tableRows": [{"tableCells": [{"content": [{"paragraph": {"elements": [run("c")]}}]}]}]}}]}}
    assert document_markdown(doc) == "## Head\n\n  - **x** y\n\n| c |\n\n| --- |"
