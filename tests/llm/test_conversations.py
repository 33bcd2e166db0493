import datetime as dt
import random

from weftline.llm import conversations as c

SCHEMA = "id string, session_id string, role string, content string, tool_calls string, tool_eval_data string, created_at timestamp_ntz, updated_at timestamp_ntz, userid string, conversation string, visible string"
T0 = dt.datetime(2025, 1, 1)


def _rows(*items):
    out = []
    for i, (sid, t, role, content, calls, results) in enumerate(items):
        at = None if t is None else T0 + dt.timedelta(seconds=t)
        out.append((f"M{i:03d}", sid, role, content, calls, results, at, at, "u", "clash", "clash"))
    return out


def _judge(spark, rows):
    return {r.conversation: r.reason for r in c.judge(c.messages(spark.createDataFrame(rows, SCHEMA))).collect()}


CALL = '[{"id": "c1", "type": "function", "function": {"name": "f", "arguments": "{}"}}]'


def test_reasons(spark):
    r = _judge(
        spark,
        _rows(
            ("GOOD", 1, "System", "s", None, None), ("good", 2, "human", "hi", "null", None), ("good", 3, "bot", "yes", "[]", None),
            ("empty", 1, "user", "​ 　", None, None), ("empty", 2, "assistant", None, None, None), ("empty", 3, "tool", "x", None, None),
            ("first", 1, "assistant", "yes", None, None), ("first", 2, "user", "hi", None, None), ("first", 3, "ai", "yo", None, None),
            ("badjson", 1, "user", "hi", None, None), ("badjson", 2, "ai", "yo", '[{"id": "c1"', None),
            ("noresult", 1, "user", "hi", None, None), ("noresult", 2, "ai", "yo", CALL, None),
            ("nocall", 1, "user", "hi", None, None), ("nocall", 2, "ai", "yo", None, None), ("nocall", 3, "tool", "r", None, '{"id": "zz"}'),
            ("paired", 1, "user", "hi", None, None), ("paired", 2, "function", "r", None, '[{"tool_call_id": "c1", "data": 1}]'), ("paired", 2, "ai", "yo", '"' + CALL.replace('"', '\\"') + '"', None), ("paired", 3, "ai", "done", None, None),
            ("byname", 1, "user", "hi", None, None), ("byname", 2, "ai", "", '[{"functionCall": {"name": "f", "args": {}}}]', None), ("byname", 3, "tool", "r", None, '{"id": "f"}'), ("byname", 4, "model", "ok", None, None),
            ("late", 1, "user", "hi", None, None), ("late", 2, "user", "again", None, None), ("late", 3, "ai", "yo", None, None),
            ("open", 1, "user", "hi", None, None), ("open", 2, "ai", " ", None, None),
            ("odd", None, "user", "hi", None, None), ("odd", 5, "ai", "yo", None, "not json"),
        ),
    )
    assert r == {"good": None, "empty": "empty", "first": "broken", "badjson": "broken", "noresult": "broken", "nocall": "broken", "paired": None, "byname": None, "late": "missing_reply", "open": "missing_reply", "odd": None}


def test_redelivery_counts_once_and_empty_table(spark):
    rows = _rows(("s", 1, "user", "hi", None, None), ("s", 2, "ai", "yo", None, None))
    old = list(rows[1])
    old[3], old[7] = "", T0 - dt.timedelta(days=1)
    rows += [tuple(old), rows[1], (None, None, None, None, None, None, None, None, None, None, None)]
    assert _judge(spark, rows) == {"s": None}
    empty = spark.createDataFrame([], SCHEMA)
    assert c.judge(c.messages(empty)).count() == 0 and c.conversations(empty).count() == 0


def test_long_sessions_against_a_plain_fold(spark):
    rnd = random.Random(4)
    items = []
    for s in range(40):
        for t in range(2500 if s == 0 else rnd.randint(1, 12)):
            items.append((f"s{s}", t, rnd.choice(["user", "assistant", "assistant", "system", "tool"]), rnd.choice(["x", "x", "x", "", None]), None, None))
    items += [("fine", t, ["user", "assistant"][t % 2], "x", None, None) for t in range(3000)]
    got = _judge(spark, _rows(*items))
    for s in {i[0] for i in items}:
        ms = [(i[2], bool(i[3])) for i in items if i[0] == s]
        if not any(r in ("user", "assistant") and v for r, v in ms):
            want = "empty"
        elif [r for r, _ in ms if r != "system"][0] != "user":
            want = "broken"
        else:
            want, open_ = None, False
            for r, v in ms:
                if r == "user":
                    want = "missing_reply" if open_ else want
                    open_ = True
                elif r == "assistant" and v:
                    open_ = False
            want = "missing_reply" if open_ else want
        assert got[s] == want, s


def test_messages_without_ids_are_linked(spark):
    rows = _rows(
        (None, 1, "user", "please look up the tide", None, None),
        (None, 2, "assistant", "> please look up the tide\nhere it is", CALL.replace("c1", "k9"), None),
        (None, 3, "tool", "r", None, '{"id": "k9"}'),
        (None, 4, "assistant", "tide is high", None, None),
        ("s", 1, "user", "hello there friend", None, None), ("s", 2, "assistant", "good morning to you", None, None),
        (None, 5, "user", "> good morning to you\nthanks", None, None),
    )
    m = c.messages(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: r.conversation for r in c.linked_conversations(m).collect()}
    assert got == {"m000": "m000", "m001": "m000", "m002": "m000", "m003": "m003", "m006": "s"}
    full = c.conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("conversation", "position").collect()
    assert [(r.conversation, r.position, r.speaker) for r in full] == [("m000", 0, "user"), ("m000", 1, "assistant"), ("m000", 2, "tool")]


def test_names_of_functions_and_strangers_link_nothing(spark):
    named = '[{"function": {"name": "search"}}]'
    rows = _rows(
        (None, 1, "assistant", "a", named, None), (None, 2, "assistant", "b", named, None), ("s9", 3, "assistant", "c", named, None),
        (None, 4, "user", "> said by somebody else", None, None), ("s9", 1, "user", "said by somebody else", None, None),
        (None, 2, "user", "> said only later on", None, None), ("s9", 9, "user", "said only later on", None, None),
    )
    rows[3] = (*rows[3][:8], "stranger", *rows[3][9:])
    got = {r.id: r.conversation for r in c.assigned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"m000": "m000", "m001": "m001", "m002": "s9", "m003": "m003", "m004": "s9", "m005": "m005", "m006": "s9"}


def test_ids_in_mixed_case_and_rows_without_an_id(spark):
    rows = _rows(("s", 1, "user", "hi", None, None), ("s", 2, "ai", "yo", None, None))
    rows = [("X1", *rows[0][1:]), ("x1", *rows[0][1:])] + [(None, *rows[1][1:])] * 2 + [(None, "t", *rows[0][2:])]
    m = c.messages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.session_id, r.turn) for r in m) == [("s", 1), ("s", 2), ("t", 1)]
    assert {tuple(r) for r in c.left_out(spark.createDataFrame(rows, SCHEMA)).collect()} == {("t", "missing_reply")}
