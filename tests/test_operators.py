import datetime as dt
import json
import uuid
from typing import Any, Optional, Union

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import entities, security
from weftline.operators import graph as g
from weftline.operators import messages as m
from weftline.operators import search as s
from weftline.operators.components import connected_components
from weftline.operators.latest import latest_rows
from weftline.operators.numbering import number_rows
from weftline.plans.cypher import Cypher, CypherError
from weftline.plans.schema import EntityType, Registry, callable_spec, expand_plan, from_json_schema, openapi_functions, spark_type, sql_type
from weftline.streaming import streams


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n"), (None, 3, "m")], "id string, v int, t string")
    assert {tuple(r) for r in latest_rows(df, ["id"], ["v"]).select("id", "t").collect()} == {("a", "y"), ("b", "z"), (None, "m")}
    assert latest_rows(df.limit(0), ["id"], ["v"]).count() == 0


def test_number_rows_splits_groups(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").when(F.col("id") < 900, F.concat(F.lit("k"), F.col("id") % 7)).alias("g"), (F.col("id") * 37 % 1000).alias("o"))
    rows = number_rows(df, ["g"], ["o"], out="n", parts=8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.g, []).append((r.o, r.n))
    for v in by.values():
        assert [n for _, n in sorted(v)] == list(range(len(v)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (101, 102), (7, 7), (200, 200), (None, 3)] + [(300, x) for x in range(301, 340)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert all(got[i] == 0 for i in range(51))
    assert got[102] == 100 and got[200] == 200 and all(got[x] == 300 for x in range(300, 340))
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_components_of_all_lineitem_edges(spark, tmp_path):
    from weftline import queries

    rows = [(i % 7 if i < 40 else 100 + i, i % 11 if i < 40 else 200 + i // 2, float(i % 51)) for i in range(120)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    least = {n: n for s_, p, _ in rows for n in (f"s{s_}", f"p{p}")}
    for _ in least:  # brute force: the least name travels along every edge, whatever its quantity
        for s_, p, _ in rows:
            least[f"s{s_}"] = least[f"p{p}"] = min(least[f"s{s_}"], least[f"p{p}"])
    got = {r.node: r.component for r in queries.queries()["connected_components_of_all_edges"](spark, str(tmp_path)).collect()}
    assert got == least


def test_user_filter_three_cases(spark):
    me = "1111"
    nodes = g.nodes_from(spark.createDataFrame([("res_public", None), ("res_private", me)], "name string, userid string"), "public__Resources", "name", "userid")
    keys = lambda names, user: {r.key for r in g.nodes_by_key(nodes, names, user).collect()}
    assert keys(["res_public", "res_private"], None) == {"res_public"}
    assert keys(["res_public", "res_private"], me) == {"res_public", "res_private"}
    assert keys(["res_private"], me) == {"res_private"}


def test_memory_graph_compaction(spark):
    rows = [("Tom", "likes", f"l{i}") for i in range(5)] + [("Tom", "has_allergy", f"a{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "u string, t string, c string")
    nodes = g.nodes_from(df, "User", "u").unionByName(g.nodes_from(df, "Concept", "c"))
    req = df.select(F.lit("User").alias("source_label"), F.col("u").alias("source_name"), F.col("t").alias("rel_type"), F.col("c").alias("target_name"), F.lit(True).alias("activate"), F.lit(None).cast("string").alias("source_user_id"), F.lit("Concept").alias("target_label"), F.lit(None).cast("string").alias("target_user_id"), F.lit(None).cast("map<string,string>").alias("rel_props"))
    empty = spark.createDataFrame([], "id bigint, src bigint, dst bigint, rel_type string, created_at timestamp, terminated_at timestamp, props map<string,string>")
    edges = g.merge_relationships(empty, req, F.lit("2025-01-01").cast("timestamp"))
    assert edges.count() == 10
    n, e, groups = g.compact_hubs(nodes, edges, 4)
    assert groups.count() == 2 and e.count() == 12 and n.count() == 13
    off = g.merge_relationships(edges, req.withColumn("activate", F.lit(False)), F.lit("2025-02-01").cast("timestamp"))
    assert off.where("terminated_at is null").count() == 0 and off.count() == 10


def test_paths_and_cypher(spark):
    df = spark.createDataFrame([("page62/B/C",), ("'page47'/B/C",), ("TX/B/D",), ("bad/path",), (None,)], "path string")
    n, e, st = g.graph_from_paths(df)
    assert st.where("status = 'success'").count() == 3 and st.where("error_message is not null").count() == 2
    p = g.paths_between(n, e, ["page47"], "Chapter", 3)
    assert {r.target for r in p.collect()} >= {"page62"}
    rows = Cypher(n, e).run("MATCH p = (a:Chapter)-[:ref*1..2]->(c:Category) WHERE a.name = 'TX' RETURN c.name AS c, length(p) AS n ORDER BY n DESC LIMIT 5").collect()
    assert [(r.c, r.n) for r in rows][2] == ("B", 1) and {(r.c, r.n) for r in rows[:2]} == {("C", 2), ("D", 2)}
    got = Cypher(n, e).run("MATCH (b)<-[r:ref]-(a:Chapter) RETURN b.name AS b, count(a.id) AS n").collect()
    assert [(r.b, r.n) for r in got] == [("B", 3)]
    with pytest.raises(CypherError):
        Cypher(n, e).run("MATCH (a), (b) RETURN a.name AS x")


def test_weighted_edges_keep_parallel_ones(spark):
    df = spark.createDataFrame([("page127", [("page126", 0.5), ("page128", 0.8), ("page128", 0.8), ("page128", 0.9)])], "name string, edges array<struct<name:string,weight:double>>")
    n, e = g.weighted_edges(df)
    assert n.count() == 3 and e.count() == 3


def test_store(spark, tmp_path):
    st = entities.EntityStore(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int, t string")
    st.upsert("E", rows(("a", 1, "it's"), ("b", 1, "x")), "id", "v")
    st.upsert("E", rows(("a", 2, "y"), ("a", 3, "z"), ("c", 1, "w")), "id", "v")
    assert {tuple(r) for r in st.read("E").select("id", "t").collect()} == {("a", "z"), ("b", "x"), ("c", "w")}
    st.delete("E", rows(("b", 0, "")), "id")
    assert st.read("E").count() == 2


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    assert entities.select_with_predicates(df, {"s": None}).count() == 0
    assert entities.select_with_predicates(df, {"id": []}).count() == 0
    assert entities.select_with_predicates(df, {"id": [1, 2], "s": "a"}).count() == 1
    assert entities.records_by_keys(df, ["", None], "s").count() == 0


def test_security_levels(spark):
    df = spark.createDataFrame([("a", None, None, 1), ("b", "u", None, 1), ("c", None, "g", 1), ("d", None, None, 100), ("e", None, None, None)], "id string, userid string, groupid string, required_access_level int")
    see = lambda ctx, mode="or": {r.id for r in security.secured(df, ctx, mode).collect()}
    assert see(security.UserContext("u", 100)) == {"b", "d"}
    assert see(security.UserContext("x", 100, ("g",))) == {"c", "d"}
    assert see(security.UserContext(None, 1)) == {"a", "b", "c", "d", "e"}
    assert see(security.UserContext("x", 1), "and") == {"a", "c", "d", "e"}
    assert see(None) == {"a", "b", "c", "d", "e"}
    assert security.visible_levels([1, 10, 100], 10) == [10, 100] and security.visible_levels([1, 10], None) == [1, 10]
    users = spark.createDataFrame([("u", None, 5, ["g"])], "id string, role_level int, required_access_level int, groups array<string>")
    assert security.user_context(users, "u").role_level == 5 and security.user_context(users, "?").role_level == 100


def test_provider_responses(spark):
    a = '{"content":[{"type":"text","text":"hi"},{"type":"tool_use","id":"t1","name":"get_weather","input":{"city":"x"}}],"usage":{"input_tokens":431,"output_tokens":101},"stop_reason":"tool_use"}'
    b = '{"candidates":[{"content":{"parts":[{"functionCall":{"name":"get_weather","args":{"q":"x"}}}]},"finishReason":"STOP"}],"usageMetadata":{"promptTokenCount":83,"candidatesTokenCount":16}}'
    df = spark.createDataFrame([(1, a), (2, "not json"), (3, None)], "k int, body string")
    r = m.anthropic_response(df, "body", "k").where("k = 1").collect()
    assert len(r) == 1 and (r[0].msg, r[0].tool_name, r[0].tokens_in, r[0].tokens_out, r[0].finish_reason) == ("hi", "get_weather", 431, 101, "tool_use")
    r = m.google_response(spark.createDataFrame([(1, b)], "k int, body string"), "body", "k").first()
    assert (r.tool_id, r.tool_name, r.tokens_in, r.tokens_out, r.finish_reason) == ("get_weather", "get_weather", 83, 16, "stop")


def test_canonical_deltas():
    assert m.canonical_delta("data: [DONE]") is None and m.canonical_delta("data: {bad") is None and m.canonical_delta("") is None
    c = m.canonical_delta('data: {"choices":[{"delta":{"content":"x"},"finish_reason":null}],"usage":null}')
    assert c["content"] == "x" and c["tool_calls"] == []
    c = m.canonical_delta('{"type":"content_block_start","index":1,"content_block":{"type":"tool_use","id":"t","name":"f"}}')
    assert c["tool_calls"][0]["id"] == "t"
    assert m.canonical_delta('{"type":"message_delta","delta":{"stop_reason":"tool_use"}}')["finish_reason"] == "tool_calls"
    g_ = m.canonical_delta('{"candidates":[{"content":{"parts":[{"functionCall":{"name":"f","args":{"a":1}}}]},"finishReason":"STOP"}]}')
    assert g_["finish_reason"] == "tool_calls" and g_["tool_calls"][0]["function"]["name"] == "f"


def test_segments_and_offsets(spark):
    seg = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.2, 3.0), ("a", 10.0, 80.0), ("a", 90.0, 90.1), ("b", 0.0, 0.1)], "g string, start double, `end` double")
    rows = [tuple(r) for r in m.merge_segments(seg, "g").orderBy("g", "segment").collect()]
    assert rows[0] == ("a", 0, 0.0, 3.0) and len([r for r in rows if r[0] == "a"]) == 4 and ("b", 0, 0.0, 0.1) in rows
    ch = spark.createDataFrame([("u", 0, 10), ("u", 10, 5), ("u", 20, 5)], "upload_id string, chunk_offset long, chunk_size long")
    assert [r.accepted for r in m.next_offsets(ch).orderBy("chunk_offset").collect()] == [True, True, False]


def test_chunk_stream(spark, tmp_path):
    rows = [("u", 1, 0, 10, 20), ("u", 2, 5, 5, 20), ("u", 3, 10, 10, 20)]
    spark.createDataFrame(rows, "upload_id string, seq long, chunk_offset long, chunk_size long, total_size long").coalesce(1).write.parquet(str(tmp_path / "c"))
    st = spark.readStream.schema("upload_id string, seq long, chunk_offset long, chunk_size long, total_size long").parquet(str(tmp_path / "c"))
    out = streams.run_to_memory(streams.accept_chunks(st), "accepted_chunks").collect()
    assert [(r.accepted, r.status) for r in sorted(out, key=lambda r: (r.uploaded_size, r.chunk_offset))] == [(True, "IN_PROGRESS"), (False, "IN_PROGRESS"), (True, "COMPLETED")]


def test_search_edges(spark):
    e = spark.createDataFrame([(1, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0])], "id int, v array<float>")
    assert [(r.id, r.vdistance) for r in s.vector_search(e, [0.0, 0.0], "id", "v", 0.75, 3).collect()] == [(1, 0.0)]
    assert s.vector_search(e.limit(0), [0.0, 0.0], "id", "v").count() == 0
    assert s.fuzzy_entities(spark.createDataFrame([(None,)], "k string"), "k", ["a"]).count() == 0


def test_types():
    golden = {"id": (Union[uuid.UUID, str], "UUID"), "name": (str, "TEXT"), "items": (list[str], "TEXT[]"), "labels": (Union[list[str], str], "TEXT[]"), "created_at": (dt.datetime, "TIMESTAMP"), "metadata": (dict, "JSON"), "any": (Any, "TEXT"), "opt": (Optional[int], "INTEGER"), "f": (float, "REAL"), "b": (bool, "BOOLEAN")}
    for hint, want in golden.values():
        assert sql_type(hint) == want
    assert sql_type(str, 100) == "VARCHAR(100)" and sql_type(int, override="BIGINT") == "BIGINT"
    with pytest.raises(ValueError):
        sql_type(Union[int, str])
    assert spark_type("TEXT[]") == T.ArrayType(T.StringType()) and spark_type("VECTOR") == T.ArrayType(T.FloatType())
    h = from_json_schema({"properties": {"name": {"type": "string"}, "age": {"type": "integer"}, "height": {"type": "number"}, "is_active": {"type": "boolean"}}, "required": ["name", "age"]})
    assert h == {"name": str, "age": int, "height": Optional[float], "is_active": Optional[bool]}


def test_registry_only_grows(spark):
    r = Registry()
    assert r.register(EntityType("a.B", {"id": "UUID", "name": "TEXT"}), plan=True) and not r.entities
    r.register(EntityType("a.B", {"id": "UUID", "name": "TEXT"}, embedded={"name": "m"}))
    assert r.register(EntityType("a.B", {"extra": "INTEGER"})) == ["ALTER TABLE a.B ADD COLUMN extra bigint"]
    assert set(r.entities["a.B"].fields) == {"id", "name", "extra"} and r.entities["a.B"].key == "name"
    df = r.conform("a.B", spark.createDataFrame([("1", "z")], "id string, junk string"))
    assert "junk" not in df.columns and "userid" in df.columns


def test_openapi_and_plans():
    spec = {"paths": {"/a-b/{id}": {"get": {"summary": "s", "parameters": [{"$ref": "#/components/p"}]}, "post": {"operationId": "mk"}}}, "components": {"p": {"name": "id", "required": True, "schema": {"type": "integer"}}}}
    f = openapi_functions(spec, "get")
    assert [x["name"] for x in f] == ["get_a_b_id"] and f[0]["parameters"]["required"] == ["id"]
    assert len(openapi_functions(spec)) == 2

    def tool(a: int, b: list[str], c: str = "x") -> None:
        """Does it."""

    sp = callable_spec(tool)
    assert sp["parameters"]["required"] == ["a", "b"] and sp["parameters"]["properties"]["b"] == {"type": "array"}
    p = expand_plan({"name": "a", "depends": ["b", "c"]}, {"b": {"name": "b", "depends": ["c"]}, "c": {"name": "c"}})
    assert [d["name"] for d in p["depends"]] == ["b"] and p["depends"][0]["depends"][0]["name"] == "c"


def test_files(spark, tmp_path):
    from weftline.sources import files

    (tmp_path / "t" / "s").mkdir(parents=True)
    (tmp_path / "t" / "s" / "a.py").write_text("x" * 45_000)
    (tmp_path / "t" / "b.md").write_text("hello")
    (tmp_path / "t" / "c.bin").write_bytes(b"\x00\xff\xfe")
    tree = files.source_tree(spark, str(tmp_path / "t"))
    assert tree.count() == 4 and tree.select("id").distinct().count() == 4
    kinds = {r.k for r in files.read_any(spark, str(tmp_path / "t"), "binary", pathGlobFilter="c.bin").select(files.file_type(F.col("content")).alias("k")).collect()}
    assert kinds == {"application/octet-stream"}
    for kind in ("csv", "json", "parquet", "orc"):
        files.write_any(spark.range(3).select(F.col("id").cast("string")), str(tmp_path / kind), kind)
        assert files.read_any(spark, str(tmp_path / kind), kind).count() == 3


def test_calls_and_results_of_any_provider():
    load = lambda t: json.loads(t) if t else None
    assert load(m.canonical_calls('"[{\\"functionCall\\": {\\"name\\": \\"f\\", \\"args\\": {\\"k\\": 1}}}]"')) == [{"id": "f", "type": "function", "function": {"name": "f", "arguments": '{"k": 1}'}}]
    assert load(m.canonical_calls('{"type": "tool_use", "id": "t1", "name": "g", "input": {}}'))[0]["id"] == "t1"
    for nothing in (None, "", "null", "[]", "{", "3", '"x"', "[{}]", '[{"id": "a"}]'):
        assert m.canonical_calls(nothing) is None
    assert load(m.canonical_results('{"tool_use_id": "t1", "data": {"n": 1}}')) == [{"id": "t1", "data": '{"n": 1}'}]
    assert load(m.canonical_results('[{"content": "x"}]')) == [{"id": None, "data": "x"}] and m.canonical_results("not json") is None


def test_components_say_when_they_are_not_finished(spark):
    chain = spark.range(64).selectExpr("id as src", "id + 1 as dst")
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=1)
    assert connected_components(chain).select("component").distinct().count() == 1


def test_components_of_many_edges_compare_without_overflow(spark):
    from weftline.operators.components import _mark

    n = 20_000_000  # a sum of hashes of 40 bits passes 2^63 from 17 million edges on
    many = spark.range(n).selectExpr("id + 1 as u", "id as v")
    assert _mark(many)[0] == n and _mark(many) != _mark(many.selectExpr("if(u = 5, 0, u) as u", "v"))


def test_local_stars_keep_components(monkeypatch):
    from weftline.operators import components

    def least(edges):
        of = {n: n for e in edges for n in e}
        for _ in of:
            for a, b in edges:
                of[a] = of[b] = min(of[a], of[b])
        return of

    monkeypatch.setattr(components, "CHUNK", 8)
    edges = [(f"n{i * i % 23}", f"n{i * 7 % 31}") for i in range(40)] + [("x", "x"), ("n1", "n1"), ("y", "z")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*edges[i : i + 3], strict=True)], names=["u", "v"]) for i in range(0, len(edges), 3)]
    stars = [(r["u"], r["v"]) for b in components._local_stars(iter(batches)) for r in b.to_pylist()]
    assert least(stars) == least(edges)
    one = [(r["u"], r["v"]) for r in next(components._local_stars(iter([pa.RecordBatch.from_arrays([pa.array(["a"] * 7), pa.array(["b"] * 7)], names=["u", "v"])]))).to_pylist()]
    assert len(one) == 1


def test_three_legs_on_nothing(spark):
    rows = spark.createDataFrame([], "id string, content string, graph_paths array<string>, userid string")
    e = spark.createDataFrame([], "source string, v array<float>")
    legs = s.three_legs(rows, e, [1.0, 0.0], "source", "v", F.col("content").isNotNull(), user="u")
    assert legs.count() == 0 and s.merged_legs(legs).count() == 0 and s.search_entities({"a": legs}, stats=True).count() == 0
    one = s.entity_search(legs, "q", 0.2).first()
    assert (one.relational_result, one.hybrid_score) == ("[]", 0.0) and "below" in one.error_message
