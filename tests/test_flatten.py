import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators.flatten import flatten_batch, flatten_members, flatten_objects


def _open(v):
    while isinstance(v, str):
        try:
            x = json.loads(v.strip(), parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            break
        if not isinstance(x, (dict, list, str)):
            break
        v = x
    return v


def brute(text):
    out = set()

    def walk(v, path, parent, outer):
        v = _open(v)
        if isinstance(v, dict):
            if not outer:
                out.add((path, parent))
            for k, x in v.items():
                walk(x, f"{path}.{k}", path, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", parent, False)

    try:
        v = json.loads(text.strip(), parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return out
    walk(v, "$", "$", True)
    return out


def found(texts):
    f = flatten_batch(pa.array(texts, pa.string()))
    got = [set() for _ in texts]
    for r, p, o in zip(f["row"].to_pylist(), f["path"].to_pylist(), f["owner"].to_pylist(), strict=True):
        got[r].add((p, o))
    return got


leaf = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.floats(allow_nan=False, allow_infinity=False, width=16), st.text("ab\"\\{}[]:, \n\té", max_size=6))
tree = st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text("ab.\\\"é", max_size=3), x, max_size=3), x.map(json.dumps)), max_leaves=12)


@settings(max_examples=250, deadline=None)
@given(st.lists(tree.flatmap(lambda v: st.tuples(st.just(json.dumps(v)), st.integers(0, 40), st.sampled_from(["", "{", "]", ",", '"', "\\", " "])))))
def test_against_parsing(items):
    texts = []
    for text, at, put in items:
        texts += [text, text[:at] + put + text[at:], text[:at]]
    assert found(texts) == [brute(t) for t in texts]


def test_edges():
    texts = [None, "", "   ", "{}", "[{}]", '"{\\"a\\": {}}"', "{'a': {}}", '{"a": {}', "[1,]", "nul", '{"a":{"b":[{},[{"c":{}}]]}}', "NaN", '{"k":"' + "x" * 200_000 + '","o":{}}']
    want = [brute(t) if t else set() for t in texts]
    assert found(texts) == want
    assert ("$.a.b[1][0].c", "$.a.b[1][0]") in want[10]
    assert found([]) == []


def test_frames(spark):
    df = spark.createDataFrame([("r1", '{"a": {"x": 1}, "b": [{"y": "t"}]}', "clash"), ("r2", None, None), (None, '{"a": {}}', "z")], "id string, spec string, node_path string")
    rows = {tuple(r) for r in flatten_objects(df, "id", [("spec", "t.spec")]).select("record_id", "node_path", "parent_path").collect()}
    assert rows == {("r1", "$.a", "$"), ("r1", "$.b[0]", "$"), (None, "$.a", "$")}
    cells = {(r.node_path, r.member_path, r.kind, r.value) for r in flatten_members(df, "id", [("spec", "t.spec")]).where("record_id = 'r1'").collect()}
    assert cells == {("$.a", "$.a.x", "number", "1"), ("$.b[0]", "$.b[0].y", "string", "t")}
    assert flatten_objects(df.limit(0), "id", [("spec", "t.spec")]).count() == 0


def test_batches_are_sliced_by_bytes():
    from weftline.operators.flatten import slices

    texts = pa.array(["x" * 10, None, "y" * 50, "z", "", "w" * 9])
    assert list(slices(texts, 20)) == [(0, 2), (2, 3), (3, 6)] and list(slices(texts.slice(3), 20)) == [(0, 3)] and list(slices(texts.slice(0, 0))) == []
