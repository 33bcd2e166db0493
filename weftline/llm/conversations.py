"""Conversations from message rows: who belongs together, in which order, and which conversations to leave out.

Messages with a session id form one conversation each. Messages without one are linked by the calls they make or
answer (by the id of the call, never by the name of a function) and by the texts they quote, both among the messages of one user;
a quote belongs to the first earlier message that said the text. Their conversations are the connected components of
those links, found with alternating large-star and small-star joins; a component that links to sessions joins the least of
them. Every conversation is then checked as a fold over its ordered messages: rows are range partitioned by
(conversation, time), each partition gives one summary for each conversation, and the summaries are merged in order.
No conversation is ever gathered in one task, however long it is.

One scan makes narrow rows (ids, flags, keys and hashes); contents are moved once, for the conversations that are kept.

Edge cases: ids compare in lower case; repeated deliveries of an id count once (latest updated_at); a row without an id is a
message of its own, known by a hash of what it holds, so that it counts once too; null roles and unknown ones are nobody's
turn; null times come first; equal times are ordered system, user, assistant, tool, then id; null content is not
visible; messages without a session id and without links are conversations of one; an empty table gives empty results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.operators.latest import latest_rows
from weftline.operators.numbering import number_rows
from weftline.session import cut, parallelism

# Spellings of the four speakers.
SPEAKERS = {
    "user": ["user", "human", "customer", "client", "end_user", "enduser", "person", "guest"],
    "assistant": ["assistant", "ai", "bot", "model", "agent", "chatbot", "gpt", "llm", "assistant_message"],
    "system": ["system", "developer", "sys", "instruction", "instructions"],
    "tool": ["tool", "function", "tool_result", "tool_response", "function_call_output", "function_response", "ipython", "observation"],
}
TURN = {"system": 0, "user": 1, "assistant": 2, "tool": 3}
#: at least one character that is neither white space of any script nor of zero width
VISIBLE = r"[^\s\p{Z}\p{Cf}\x{85}\x{1c}-\x{1f}\x{34f}\x{180e}]"


def visible(col: Column) -> Column:
    return F.coalesce(col.rlike(VISIBLE), F.lit(False))


def speaker(col: Column) -> Column:
    """One of user, assistant, system, tool; null for anything else."""
    names = F.create_map(*[F.lit(x) for who, names in SPEAKERS.items() for n in names for x in (n, who)])
    return names[F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")]


def _opened(value: object) -> object:
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


def _first(d: dict, *names: str) -> str | None:
    for n in names:
        v = d.get(n)
        if v is not None and not isinstance(v, (dict, list)) and str(v).strip():
            return str(v)
    return None


def call_keys(text: str | None) -> tuple[bool, list[tuple[str, bool]]]:
    """(valid JSON, keys of the calls): the id of a call, or its function name if it has none; and whether it is an id."""
    if text is None:
        return True, []
    try:
        value = _opened(json.loads(text.strip()))
    except ValueError:
        return False, []
    if isinstance(value, dict) and isinstance(_opened(value.get("tool_calls")), list):
        value = _opened(value["tool_calls"])
    keys = []
    for call in value if isinstance(value, list) else [value]:
        call = _opened(call)
        if not isinstance(call, dict) or not call:
            continue
        inner = next((x for n in ("function", "functionCall", "function_call") if isinstance(x := _opened(call.get(n)), dict)), {})
        ident = _first(call, "id", "tool_call_id", "call_id") or _first(inner, "id")
        keys.append((ident or _first(inner, "name") or _first(call, "name", "function") or "", ident is not None))
    return True, keys


def result_keys(text: str | None) -> list[str]:
    """Keys of the calls that results answer; text that is not JSON holds none."""
    if text is None:
        return []
    try:
        value = _opened(json.loads(text.strip()))
    except ValueError:
        return []
    keys = []
    for r in value if isinstance(value, list) else [value]:
        r = _opened(r)
        if isinstance(r, dict) and r:
            keys.append(_first(r, "tool_call_id", "tool_use_id", "id") if "id" not in r else _first(r, "id", "tool_call_id", "tool_use_id"))
    return [k or "" for k in keys]


#: a call (with an id or only a name) or a result
_KEYS = "array<struct<key:string,is_call:boolean,is_id:boolean>>"
_PASSED = ["id", "version", "h", "session_id", "userid", "turn", "visible", "created_at", "said", "quotes"]


def _identified(raw: DataFrame) -> DataFrame:
    """Rows with ``id`` in small letters (a hash where there is none), ``version`` and ``h``, the hash of what the row holds."""
    held = F.xxhash64("session_id", "role", "content", "tool_calls", "tool_eval_data", "created_at", "userid")
    return raw.withColumn("h", held).withColumn("id", F.coalesce(F.lower("id"), F.concat(F.lit("no id "), F.hex("h")))).withColumn("version", F.col("updated_at"))


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "))


def messages(raw: DataFrame) -> DataFrame:
    """Narrow current messages: (id, h, session_id, userid, turn, visible, created_at, said, quotes, keys, bad).

    ``said`` and ``quotes`` are hashes of the whole text and of the quoted texts (of 8 characters or more), ``keys`` the calls and results.
    """
    rows = _identified(raw)
    turn = _ordered_rank(speaker(F.col("role"))).cast("int")
    quoted = F.regexp_extract_all("content", F.lit(r"(?:^|\n)((?:[ \t]*>[^\n]*(?:\n|$))+)"), F.lit(1))
    quoted = F.transform(quoted, lambda q: _plain(F.regexp_replace(q, r"(?m)^[ \t]*>+[ \t]?", "")))
    quotes = F.when(F.col("content").rlike(r"(?m)^[ \t]*>"), F.transform(F.filter(quoted, lambda q: F.length(q) >= 8), lambda q: F.xxhash64(q)))
    said = F.when(F.length("content") >= 8, F.xxhash64(_plain(F.col("content"))))
    narrow = rows.select("id", "version", "h", F.lower("session_id").alias("session_id"), "userid", turn.alias("turn"), visible(F.col("content")).alias("visible"), "created_at", said.alias("said"), quotes.alias("quotes"), "tool_calls", "tool_eval_data")
    schema = narrow.select(*_PASSED, F.lit(None).cast(_KEYS).alias("keys"), F.lit(False).alias("bad")).schema
    kind = pa.list_(pa.struct([("key", pa.string()), ("is_call", pa.bool_()), ("is_id", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(_PASSED)
        for b in batches:
            keys, bad = [], []
            for c, r in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True):
                ok, calls = call_keys(c) if c is not None else (True, [])
                found = [{"key": k, "is_call": True, "is_id": i} for k, i in calls] + [{"key": k, "is_call": False, "is_id": True} for k in result_keys(r)]
                keys.append(found or None)
                bad.append(not ok)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(keys, kind), pa.array(bad, pa.bool_())], names=[*_PASSED, "keys", "bad"])

    keyed = narrow.mapInArrow(run, schema)
    return latest_rows(keyed, ["id"], ["version", "h"])


def tool_keys(m: DataFrame, conversation: str = "session_id") -> DataFrame:
    """(conversation, id, userid, key, is_call, is_id, bad) for the messages that carry calls or results."""
    rows = m.where(F.col("keys").isNotNull() | F.col("bad"))
    rows = rows.select(F.col(conversation).alias("conversation"), "id", "userid", "bad", F.explode_outer("keys").alias("k"))
    return rows.select("conversation", "id", "userid", "k.key", "k.is_call", "k.is_id", "bad")


class _Fold:
    """Summary of consecutive messages of one conversation; two of them merge in order."""

    __slots__ = ("first", "seen", "lead", "user", "missing", "open")

    def __init__(self) -> None:
        self.first, self.seen, self.lead, self.user, self.missing, self.open = None, False, False, False, False, False


_SUMMARY = "conversation string, seq long, first int, seen boolean, lead boolean, user boolean, missing boolean, open boolean"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now, f, seq = None, None, 0

    def flush() -> None:
        if f is not None:
            out.append((now, seq, f.first, f.seen, f.lead, f.user, f.missing, f.open))

    for b in batches:
        conv = b.column(0).to_pylist()
        role = b.column(1).fill_null(-1).to_numpy(zero_copy_only=False).tolist()
        vis = b.column(2).to_numpy(zero_copy_only=False).tolist()
        if len(conv):
            seq = b.column(3)[0].as_py()
        for c, r, v in zip(conv, role, vis, strict=True):
            if c != now or f is None:
                flush()
                now, f = c, _Fold()
            if r == 0:
                continue
            if f.first is None:
                f.first = r
            if r == 1:
                f.missing |= f.open
                f.open = f.user = True
                f.seen |= v
            elif r == 2 and v:
                f.seen = True
                f.open = False
                f.lead |= not f.user
        if len(out) > 50_000:
            yield _rows(out)
            out = []
    flush()
    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.bool_()] * 5]
    cols = list(zip(*out, strict=True)) if out else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _SUMMARY.split(", ")])


def _ordered_rank(col: Column) -> Column:
    return F.when(col == "system", 0).when(col == "user", 1).when(col == "assistant", 2).when(col == "tool", 3)


def judge(m: DataFrame, conversation: str = "session_id") -> DataFrame:
    """(conversation, reason) for every conversation; reason is null for those to keep."""
    spark = m.sparkSession
    narrow = m.where(F.col(conversation).isNotNull()).select(F.col(conversation).alias("conversation"), "turn", "visible", "created_at", "id")
    placed = narrow.repartitionByRange(parallelism(spark), "conversation", "created_at", "turn", "id").sortWithinPartitions("conversation", "created_at", "turn", "id")
    parts = placed.select("conversation", "turn", "visible", F.spark_partition_id().cast("long").alias("seq")).mapInArrow(_summaries, _SUMMARY)
    folded = parts.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("seq", "first", "seen", "lead", "user", "missing", "open"))).alias("parts"))
    folded = folded.withColumn(
        "s",
        F.expr(
            """aggregate(parts, named_struct('first', cast(null as int), 'seen', false, 'missing', false, 'open', false),
            (a, p) -> named_struct('first', coalesce(a.first, p.first), 'seen', a.seen or p.seen,
              'missing', a.missing or p.missing or (a.open and p.user and not p.lead),
              'open', if(p.user, p.open, a.open and not p.lead)))"""
        ),
    ).select("conversation", "s.*")
    keys = tool_keys(m.where(F.col(conversation).isNotNull()), conversation)
    matched = keys.groupBy("conversation", "key").agg(F.max("is_call").alias("c"), F.max(~F.col("is_call")).alias("r"), F.max("bad").alias("bad"))
    wrong = matched.where("bad or key = '' or (key is not null and not (coalesce(c, false) and coalesce(r, false)))").select(F.col("conversation").alias("_c")).distinct().withColumn("wrong", F.lit(True))
    j = folded.join(wrong, F.col("conversation") == F.col("_c"), "left")
    reason = F.when(~F.col("seen"), "empty").when((F.col("first") != 1) | F.col("first").isNull() | F.coalesce("wrong", F.lit(False)), "broken").when(F.col("missing") | F.col("open"), "missing_reply")
    return j.select("conversation", reason.alias("reason"))


def linked_conversations(m: DataFrame) -> DataFrame:
    """(id, conversation, adopted: by a session) of the messages without a session id, by links over calls, results and quotes of their user.

    A component that links to messages of a session joins the least such session; otherwise its least message id
    names it. Messages without any link are conversations of one.
    """
    who = F.coalesce("userid", F.lit("")).alias("who")
    lost = m.where(F.col("session_id").isNull())
    # calls and results by the id of the call: all of a call's messages link to the least of them without a session
    keys = tool_keys(m).where("is_id and key != ''").select("id", F.col("conversation").alias("session"), who, "key").distinct()
    hubs = keys.where("session is null").groupBy("who", "key").agg(F.min("id").alias("hub"))
    by_call = keys.join(hubs, ["who", "key"]).select("id", "session", "hub")
    # a quote belongs to the first message that said the text; one of the two must be without a session
    quotes = m.where("quotes is not null").select("id", "session_id", who, "created_at", F.explode("quotes").alias("said"))
    first = m.where("said is not null").select("id", "session_id", who, "created_at", "said").join(quotes.select("who", "said").distinct(), ["who", "said"], "left_semi")
    first = first.groupBy("who", "said").agg(F.min_by(F.struct("id", "session_id", "created_at"), F.struct("created_at", "id")).alias("f"))
    pairs = quotes.join(first, ["who", "said"]).where("f.created_at < created_at and f.id != id and (session_id is null or f.session_id is null)")
    from_quote = pairs.where("session_id is null").select(F.col("f.id").alias("id"), F.col("f.session_id").alias("session"), F.col("id").alias("hub"))
    to_quote = pairs.where("session_id is not null").select("id", F.col("session_id").alias("session"), F.col("f.id").alias("hub"))
    links = cut(by_call.unionByName(from_quote).unionByName(to_quote))  # hubs have no session
    comp = connected_components(links.where("session is null").select(F.col("id").alias("src"), F.col("hub").alias("dst")))
    comp = comp.select(F.col("node").alias("id"), "component")
    adopt = links.where("session is not null").select(F.col("hub").alias("id"), "session").join(comp, "id", "left").groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("session").alias("adopted"))
    lone = lost.select("id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return lone.join(adopt, "component", "left").select("id", F.coalesce("adopted", "component").alias("conversation"), F.col("adopted").isNotNull().alias("adopted"))


def assigned(raw: DataFrame) -> DataFrame:
    """Narrow current messages with their ``conversation``."""
    m = cut(messages(raw))
    lost = m.where(F.col("session_id").isNull()).join(linked_conversations(m), "id")
    return m.where(F.col("session_id").isNotNull()).withColumn("conversation", F.col("session_id")).withColumn("adopted", F.lit(True)).unionByName(lost)


def left_out(raw: DataFrame) -> DataFrame:
    """(session_id, reason) of the sessions to leave out."""
    m = assigned(raw)
    sessions = judge(m, "conversation").where("reason is not null")
    lone = m.where("not adopted").select("conversation").distinct()  # these are no sessions
    return sessions.join(lone, "conversation", "left_anti").select(F.col("conversation").alias("session_id"), "reason")


def conversations(raw: DataFrame) -> DataFrame:
    """Ordered messages of the conversations worth keeping: (conversation, position, id, speaker, content, tool_calls, created_at)."""
    m = assigned(raw)
    good = judge(m, "conversation").where("reason is null").select("conversation")
    kept = m.join(good, "conversation", "left_semi").select("conversation", "created_at", "turn", "id", "h")
    placed = number_rows(kept, ["conversation"], ["created_at", "turn", "id"], out="position")
    wide = _identified(raw).select(F.col("id").alias("_i"), F.col("h").alias("_h"), "content", "tool_calls")
    both = placed.join(wide, (F.col("id") == F.col("_i")) & (F.col("h") == F.col("_h"))).dropDuplicates(["id"])
    who = F.element_at(F.array(*[F.lit(x) for x in TURN]), F.col("turn") + 1)
    return both.select("conversation", "position", "id", F.when(F.col("turn").isNotNull(), who).alias("speaker"), "content", "tool_calls", "created_at")
