"""Queries of the training-data operators over whole tables, and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import conversations as conv
from weftline.llm import garbled, mix, pack, pii, similar, split, tokens
from weftline.session import cut, table


# 1 -- similar vectors


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    a = similar.usable_vectors(table(spark, d, "resource_embeddings"), "resource_embeddings", "embedding_vector")
    b = similar.usable_vectors(table(spark, d, "embedding_records"), "embedding_records", "embedding")
    return a.unionByName(b)


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_vectors(_vectors(spark, d)).select("vec_table", F.col("model").alias("embedding_name"), "id", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = similar.similar_vectors(_vectors(spark, d), least=0.92)
    return near.select("vec_table", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


# 2 -- conversations


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conv.left_out(table(spark, d, "ai_responses"))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conv.conversations(table(spark, d, "ai_responses"))


# 3 -- splitting


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "split_limits")
    a = split.split_oversized(table(spark, d, "resources"), "resources", limits, "updated_at")
    return a.unionByName(split.split_oversized(table(spark, d, "markdown_chunks"), "markdown_chunks", limits, None))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("pieces > 1").select("item_table", "item_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p3_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per table: items that were cut, pieces over the limit, places where the overlap is not exact, items not covered to their end."""
    limits = table(spark, d, "split_limits")
    p = _pieces(spark, d).where("pieces > 1").withColumn("n", F.length("content"))
    before = F.lag("end").over(Window.partitionBy("item_table", "item_id").orderBy("piece"))
    p = p.withColumn("gap", F.coalesce(before - F.col("start"), F.lit(-1))).join(F.broadcast(limits), "item_table")  # a fixed table
    wrong = (F.col("n") > F.col("max_chars")).cast("long"), ((F.col("piece") > 0) & (F.col("gap") != F.col("overlap_chars")) | (F.col("piece") == 0) & (F.col("start") != 0) | (F.col("n") != F.col("end") - F.col("start"))).cast("long")
    return p.groupBy("item_table").agg(F.countDistinct("item_id").alias("items"), F.sum(wrong[0]).alias("too_long"), F.sum(wrong[1]).alias("gaps"))


def p3_ordinals(spark: SparkSession, d: str) -> DataFrame:
    pieces = cut(_pieces(spark, d).select("item_table", "item_id", "piece"))
    a = split.renumbered(table(spark, d, "resources"), pieces.where("item_table = 'resources'"), "uri", "updated_at")
    b = split.renumbered(table(spark, d, "markdown_chunks"), pieces.where("item_table = 'markdown_chunks'"), "resource_id", None, ["path"])
    return a.withColumn("item_table", F.lit("resources")).unionByName(b.withColumn("item_table", F.lit("markdown_chunks")))


# 4 -- personal information


def _pii_tables(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str | None]]:
    return [("resources", table(spark, d, "resources"), "updated_at"), ("memory_requests", table(spark, d, "memory_requests"), None), ("ai_responses", table(spark, d, "ai_responses"), "updated_at")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tables = _pii_tables(spark, d)
    finder, model = pii.train(tables, table(spark, d, "known_names"))
    return pii.find_pii(pii.current_contents(tables), finder, model).select("src_table", "record_id", "pii_type", "nth")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    tables = _pii_tables(spark, d)
    finder, model = pii.train(tables, table(spark, d, "known_names"))
    return pii.redact_contents(pii.current_contents(tables), finder, model)


# 6 -- containers


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.with_tokens(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"], out="size")
    return pack.pack_items(sizes, table(spark, d, "pack_capacities"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per container: bins over capacity, items of which tokens are lost or packed twice, items cut though they fit."""
    sizes = cut(tokens.with_tokens(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"], out="size"))
    packed = cut(pack.pack_items(sizes, table(spark, d, "pack_capacities")))
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("size").alias("used")).groupBy("container").agg(F.sum((F.col("used") > F.col("capacity")).cast("long")).alias("over_full"))
    got = packed.groupBy("container", "capacity", "doc_id").agg(F.sum("size").alias("got"), F.count("*").alias("parts"), F.countDistinct("piece").alias("pieces"))
    all_ = F.broadcast(table(spark, d, "pack_capacities").select("container", F.col("capacity_tokens").alias("capacity")))  # a fixed table
    want = sizes.where("size is not null").crossJoin(all_)
    both = want.join(got, ["container", "capacity", "doc_id"], "full")
    lost = (~F.col("size").eqNullSafe(F.col("got")) | (F.col("parts") != F.col("pieces"))).cast("long")
    items = both.groupBy("container").agg(F.sum(lost).alias("lost"), F.sum(((F.col("parts") > 1) & (F.col("size") <= F.col("capacity"))).cast("long")).alias("cut"))
    return bins.join(items, "container")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_report(_packed(spark, d))


# 7 -- mixture


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "source", "text")
    wanted = docs.join(F.broadcast(targets.select("source")), "source", "left_semi")  # a fixed table of a few sources
    keyed = wanted.withColumn("key", F.sha2("text", 256))
    return mix.mix_sources(tokens.with_tokens(keyed, "text", ["doc_id", "source", "key"]), targets)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per target: texts used too often, and uses of texts that the source does not have."""
    targets, drawn = table(spark, d, "mix_targets"), cut(_mixed(spark, d))
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("home"))
    strange = drawn.join(docs, "doc_id", "left").groupBy("source").agg(F.sum((~F.col("home").eqNullSafe(F.col("source"))).cast("long")).alias("strange"))
    often = drawn.groupBy("source", "doc_id").count().join(F.broadcast(targets), "source").groupBy("source").agg(F.sum((F.col("count") > F.col("max_repeats")).cast("long")).alias("too_often"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return targets.select("source").join(strange, "source", "left").join(often, "source", "left").select("source", zero("too_often"), zero("strange"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_report(_mixed(spark, d), table(spark, d, "mix_targets"))


# 8 -- garbled text


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_documents(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restored_documents(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = ["p1_found", "p1_neighbours", "p2_found", "p2_conversations", "p3_found", "p3_pieces", "p3_ordinals", "p3_sound", "p4_found", "p4_redacted", "p6_packed", "p6_fill", "p6_sound", "p7_mix", "p7_shares", "p7_sound", "p8_found", "p8_restored"]
    return {n: globals()[n] for n in names}


_CURRENT = "select {cols} from (select *, row_number() over (partition by lower(id) order by {order}) as rn from {t} where id is not null) where rn = 1"

P1 = """
with v as (
  select 'resource_embeddings' as vec_table, embedding_name as m, lower(id) as id, embedding_vector::double[] as v from resource_embeddings
  union all select 'embedding_records', embedding_name, lower(id), embedding::double[] from embedding_records),
ok as (select * from v where v is not null and len(v) > 0 and id is not null),
usual as (select t, n, dim from (select *, row_number() over (partition by t, n order by k desc, dim) as rn from (select vec_table as t, m as n, len(v) as dim, count(*) as k from ok group by 1, 2, 3)) where rn = 1),
good as (select distinct vec_table, m, id, v from ok join usual on vec_table = t and m is not distinct from n and len(v) = dim
  where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0)
select a.vec_table, a.id as id_a, b.id as id_b from good a join good b on a.vec_table = b.vec_table and a.m is not distinct from b.m and a.id < b.id
where list_cosine_similarity(a.v, b.v) >= 0.92
"""

P1_NEAR = (
    P1[: P1.index("select a.vec_table")]
    + """, s as (select a.vec_table, a.m as embedding_name, a.id, b.id as neighbour, list_cosine_similarity(a.v, b.v) as x from good a join good b on a.vec_table = b.vec_table and a.m is not distinct from b.m and a.id <> b.id),
t as (select *, row_number() over (partition by vec_table, embedding_name, id order by round(x, 12) desc, neighbour) as rank from s)
select vec_table, embedding_name, id, neighbour, round(x, 6) as similarity, rank from t where rank <= 10"""
)

P3 = (
    "with r as ("
    + _CURRENT.format(cols="lower(id) as id, content", order="updated_at desc nulls last", t="resources")
    + "), m as ("
    + _CURRENT.format(cols="lower(id) as id, content", order="length(content) desc nulls last", t="markdown_chunks")
    + """)
select 'resources' as item_table, id as item_id from r where length(content) > (select max_chars from split_limits where item_table = 'resources')
union all select 'markdown_chunks', id from m where length(content) > (select max_chars from split_limits where item_table = 'markdown_chunks')"""
)


#: a JSON string that is itself JSON of an object, array or string stands for that
_OPEN = "case when json_type({j}) = 'VARCHAR' and json_valid(trim({j} ->> '$')) and json_type(trim({j} ->> '$')) in ('OBJECT', 'ARRAY', 'VARCHAR') then trim({j} ->> '$')::json else {j} end"
_NOW = "(select * from (select *, row_number() over (partition by lower(id) order by updated_at desc nulls last) as _rn from ai_responses where id is not null) where _rn = 1)"

_P2 = f"""
with m as (select lower(id) as id, lower(session_id) as sid, created_at, content, tool_calls, tool_eval_data,
    case when trim(lower(role)) in ('user', 'human', 'customer', 'client', 'guest', 'person') then 'user' when trim(lower(role)) in ('assistant', 'ai', 'bot', 'model', 'agent') then 'assistant'
      when trim(lower(role)) in ('system', 'developer') then 'system' when trim(lower(role)) in ('tool', 'function', 'tool_result') then 'tool' end as who,
    coalesce(regexp_matches(content, '[^\\s\\p{{Z}}\\p{{Cf}}\\x{{85}}\\x{{1c}}-\\x{{1f}}\\x{{34f}}\\x{{180e}}\\x{{0b}}]'), false) as seen
  from {_NOW} where session_id is not null),
o as (select *, row_number() over (partition by sid order by created_at nulls first, case who when 'system' then 0 when 'user' then 1 when 'assistant' then 2 else 3 end, id) as n from m),
t0 as (select sid, id, 'call' as side, trim(tool_calls) as t from m where tool_calls is not null union all select sid, id, 'result', trim(tool_eval_data) from m where tool_eval_data is not null),
bad as (select distinct sid from t0 where side = 'call' and not json_valid(t)),
t1 as (select sid, side, t::json as j from t0 where json_valid(t)),
t2 as (select sid, side, {_OPEN.format(j='j')} as j from t1), t3 as (select sid, side, {_OPEN.format(j='j')} as j from t2), t4 as (select sid, side, {_OPEN.format(j='j')} as j from t3),
e as (select sid, side, unnest(case when json_type(j) = 'ARRAY' then from_json(j, '["json"]') else [j] end) as x from t4),
k as (select sid, side, case when side = 'call' then coalesce(nullif(x ->> '$.id', ''), x ->> '$.function.name', x ->> '$.functionCall.name', x ->> '$.name', '') else coalesce(x ->> '$.id', x ->> '$.tool_call_id', x ->> '$.tool_use_id', '') end as key from e where json_type(x) = 'OBJECT' and x::varchar <> '{{}}'),
odd as (select sid from k group by sid, key having count(distinct side) < 2 or key = ''),
f as (select sid, bool_or(who in ('user', 'assistant') and seen) as talks, arg_min(who, n) filter (who is null or who <> 'system') as opener from o group by sid),
g as (select sid, sum(case when who = 'user' then 1 else 0 end) over (partition by sid order by n) as turn, who, seen from o),
r as (select distinct sid from (select sid, turn from g where turn > 0 group by sid, turn having not bool_or(who = 'assistant' and seen))),
v as (select * from (select sid, case when not talks then 'empty' when opener is distinct from 'user' or sid in (select sid from bad) or sid in (select sid from odd) then 'broken' when sid in (select sid from r) then 'missing_reply' end as reason from f))"""

def oracle_sql() -> dict[str, str]:
    found = _P2 + "select sid as session_id, reason from v where reason is not null"
    kept = _P2 + "select sid as conversation, n - 1 as position, id, who as speaker, content, tool_calls, created_at from o where sid in (select sid from v where reason is null)"
    sound = "select item_table, count(*) as items, 0::bigint as too_long, 0::bigint as gaps from (" + P3 + ") group by 1"
    packed, mixed = "select container, 0::bigint as over_full, 0::bigint as lost, 0::bigint as cut from pack_capacities", "select source, 0::bigint as too_often, 0::bigint as strange from mix_targets"
    return {"p1_found": P1, "p1_neighbours": P1_NEAR, "p2_found": found, "p2_conversations": kept, "p3_found": P3, "p3_sound": sound, "p6_sound": packed, "p7_sound": mixed}
