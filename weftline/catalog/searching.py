"""Vector, fuzzy, hybrid and upload search over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import frames
from weftline.catalog.frames import UPLOADS_SQL, similarity_sql
from weftline.catalog.registry import current, query
from weftline.functions import vector as vec
from weftline.operators import search as s
from weftline.operators.embedding import embedding_records, hashing_embedder
from weftline.session import table


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_Q = "(select embedding::double[] from embeddings where vec_id = 0)"


@query(f"select vec_id % 300 as id, round(min(list_distance(embedding::double[], {_Q})), 6) as vdistance from embeddings where list_distance(embedding::double[], {_Q}) <= 1.3 group by 1 order by min(list_distance(embedding::double[], {_Q})), 1 limit 20")
def c1_vector_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("source", F.col("vec_id") % 300)
    return s.vector_search(e, _query_vector(spark, d), "source", "embedding", 1.3, 20).select("id", F.round("vdistance", 6).alias("vdistance"))


@query(f"select vec_id as id from embeddings where list_distance(embedding::double[], {_Q}) <= 1.25 order by list_distance(embedding::double[], {_Q}), vec_id limit 5")
def c2_ids_by_description(spark: SparkSession, d: str) -> DataFrame:
    return s.vector_search(table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id", "embedding", 1.25, 5).select("id")


@query(f"""select d.doc_id, d.source, round(h.x, 6) as vdistance from documents d join (select vec_id, list_distance(embedding::double[], {_Q}) as x from embeddings
where vec_id in (select doc_id from documents where lower(lang) = 'en') and list_distance(embedding::double[], {_Q}) <= 1.4 order by 2, 1 limit 8) h on d.doc_id = h.vec_id""")
def c3_entity_vector_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    hits = s.entity_vector_search(docs, table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id", "embedding", "doc_id", 1.4, 8, where=F.lower("lang") == "en")
    return hits.select("doc_id", "source", F.round("vdistance", 6).alias("vdistance"))


@query(f"select label, round(max(list_cosine_similarity(embedding::double[], {_Q})), 6) as semantic_score, count(*) as chunk_count from embeddings group by 1")
def c4_semantic_groups(spark: SparkSession, d: str) -> DataFrame:
    g = s.group_similarity(table(spark, d, "embeddings"), _query_vector(spark, d), "embedding", ["label"])
    return g.select("label", F.round("semantic_score", 6).alias("semantic_score"), "chunk_count")


@query(f"""select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as product from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def c4_dot_products(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    return e.withColumnRenamed("vec_id", "a").join(n, "a").select("a", (F.col("a") + 1).alias("b"), F.round(vec.dot(F.col("embedding"), F.col("y")), 6).alias("product"))


_CURRENT_RES = current("resources")


@query(f"""select id as source_id, 'summary' as column_name, 'quill-embed-64' as embedding_name, substring(summary, 1, 10000) as description from {_CURRENT_RES} r
where summary is not null and summary <> '' and not exists (select 1 from resource_embeddings e where e.source_record_id = r.id and e.column_name = 'summary' and e.embedding_name = 'quill-embed-64')""")
def c8_pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    r = frames.current(spark, d, "resources", ["summary"])
    return s.pending_embeddings(r, table(spark, d, "resource_embeddings"), "id", "summary", "quill-embed-64").drop("bid")


@query()
def c9_generate_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return embedding_records(c8_pending_embeddings(spark, d), hashing_embedder(64))


@query(f"select count(*) as n, count(distinct id) as ids, 64::bigint as dim from {_CURRENT_RES} r where summary is not null and summary <> '' and not exists (select 1 from resource_embeddings e where e.source_record_id = r.id and e.column_name = 'summary' and e.embedding_name = 'quill-embed-64')")
def c10_insert_embeddings_count(spark: SparkSession, d: str) -> DataFrame:
    return c9_generate_embeddings(spark, d).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max(F.size("embedding_vector")).cast("long").alias("dim"))


@query(f"select e.id, e.column_name, r.category from resource_embeddings e join {_CURRENT_RES} r on e.source_record_id = r.id")
def c_embedding_join(spark: SparkSession, d: str) -> DataFrame:
    r = frames.current(spark, d, "resources", ["category"]).withColumnRenamed("id", "source_record_id")
    return table(spark, d, "resource_embeddings").select("id", "column_name", "source_record_id").join(r, "source_record_id").select("id", "column_name", "category")


_SIM_NAME = similarity_sql("c_name", "'customer 0000012'")


@query(f"select c_custkey, round({_SIM_NAME}, 6) as score from customer where {_SIM_NAME} > 0.6")
def d1_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    return s.fuzzy_match(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "customer 0000012", 0.6).select("c_custkey", F.round("score", 6).alias("score"))


_SIM_T = similarity_sql("k.key", "t.term")


@query(f"""with t as (select unnest(['red widgit', 'small rings', 'economy']) as term), k as (select distinct p_name as key from part where p_name is not null),
x as (select term, key, {_SIM_T} as score from t, k where {_SIM_T} > 0.3)
select term, key, round(score, 6) as score, rank from (select *, row_number() over (partition by term order by score desc, key) as rank from x) where rank <= 5""")
def d2_fuzzy_entities(spark: SparkSession, d: str) -> DataFrame:
    return s.fuzzy_entities(table(spark, d, "part"), "p_name", ["red widgit", "small rings", "economy"], 0.3, 5).select("term", "key", F.round("score", 6).alias("score"), "rank")


@query("""select s_name as name, coalesce(p, '') as related from supplier left join (select n_nationkey, n_name || '>' || r_name as p from nation join region on n_regionkey = r_regionkey) on s_nationkey = n_nationkey and n_nationkey < 15""")
def d3_deep_search(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey < 15")
    paths = j.select(F.col("n_nationkey").alias("origin"), F.array("n_name", "r_name").alias("trail"))
    hits = table(spark, d, "supplier").select(F.col("s_name").alias("name"), "s_nationkey")
    return s.deep_search(hits, paths, "s_nationkey").select("name", F.array_join("related_paths", ",").alias("related"))


_LEGS = f"""sql_leg as (select c_custkey as id, row_number() over (order by c_acctbal desc, c_custkey) as pos from customer),
vec_leg as (select vec_id as id, vdistance, row_number() over (order by vdistance, vec_id) as pos from (select vec_id, list_distance(embedding::double[], {_Q}) as vdistance from embeddings)),
gr_leg as (select s_suppkey as id, s_nationkey % 4 + 1 as path_length, row_number() over (order by s_nationkey, s_suppkey) as pos from supplier)"""


@query(f"""with {_LEGS}, u as (select id, 0.4::double as s, 'sql' as source from sql_leg where pos <= 10 union all select id, 0.4 * (1 - coalesce(vdistance, 0.5)), 'vector' from vec_leg where pos <= 10
union all select id, 0.2 * (1 - path_length / 10.0), 'graph' from gr_leg where pos <= 10), b as (select id, round(sum(s), 9) as score, string_agg(source, ',' order by source) as source from u group by 1),
t as (select * from b order by score desc, id limit 10)
select id, round(score, 6) as score, source, rank() over (order by score desc) as rank from t""")
def d4_merge_search(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    pos = lambda *o: F.row_number().over(Window.orderBy(*o)).alias("pos")
    sql = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select(F.col("c_custkey").alias("id"), pos(F.desc("c_acctbal"), "c_custkey"))
    v = s.vector_search(table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id", "embedding", None, 10)
    v = v.select("id", "vdistance", pos("vdistance", "id"))
    gr = table(spark, d, "supplier").orderBy("s_nationkey", "s_suppkey").limit(10).select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 4 + 1).alias("path_length"), pos("s_nationkey", "s_suppkey"))
    return s.merge_search_results(sql, v, gr, max_results=10).select("id", F.round("score", 6).alias("score"), "source", "rank")


@query("""select event_id, round(least(case when event_id % 7 > 0 then value / 1000 * 0.4 + least(event_id % 7, 5) * 0.02 else 0 end + case when user_id % 5 > 0 then (1 - value / 100) * 0.4 + least(user_id % 5, 5) * 0.02 else 0 end
+ case when event_id % 2 > 0 then 0.2 else 0 end, 1.0), 6) as score from events""")
def d5_hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    c = s.hybrid_score(F.col("value") / 1000, F.col("event_id") % 7, F.col("value") / 100, F.col("user_id") % 5, F.col("event_id") % 2)
    return e.select("event_id", F.round(c, 6).alias("score"))


@query(f"""with u as (select 'Customer' as entity_type, c_custkey::varchar as id, c_acctbal / 20000 as score from customer union all select 'Supplier', s_suppkey::varchar, s_acctbal / 20000 from supplier),
t as (select * from u order by score desc, entity_type, id limit 15) select entity_type, id, round(score, 6) as score, row_number() over (order by score desc, entity_type, id) as rank from t""")
def d6_parallel_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 20000).alias("score"))
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 20000).alias("score"))
    return s.parallel_search({"Customer": c, "Supplier": p}, 15).select("entity_type", "id", F.round("score", 6).alias("score"), "rank")


def _documents_as_resources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("d/"), "source").alias("uri"), F.lower("lang").alias("userid"), F.col("text").alias("content"), F.col("created_at").alias("ts"), "category")


@query("""select 'd/' || source as uri, lower(lang) as userid, count(*) as chunk_count, sum(length(text))::bigint as total_chunk_size, round(avg(length(text)), 4) as avg_chunk_size, max(created_at) as max_date,
coalesce(string_agg(distinct category, ',' order by category), '') as categories from documents group by 1, 2 order by max_date desc nulls last, chunk_count desc, uri, userid nulls last limit 20""")
def d7_resource_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = s.resource_metrics(_documents_as_resources(spark, d), limit=20)
    return m.select("uri", "userid", "chunk_count", "total_chunk_size", F.round("avg_chunk_size", 4).alias("avg_chunk_size"), "max_date", "categories")


_SIM_SRC = similarity_sql("source", "'wiki'")


@query(f"""with e as (select 'd/' || source as uri, lower(lang) as userid, 1 - min(1 - list_cosine_similarity(embedding::double[], {_Q})) as ss from documents join embeddings on vec_id = doc_id group by 1, 2),
f as (select 'd/' || source as uri, lower(lang) as userid, max(case when {_SIM_SRC} > 0.3 then 0.7 + 0.3 * {_SIM_SRC} else 0.0 end) as fs from documents where instr(lower(source), 'wiki') > 0 or {_SIM_SRC} > 0.3 group by 1, 2)
select coalesce(e.uri, f.uri) as uri, coalesce(e.userid, f.userid) as userid, round(greatest(coalesce(ss, 0), coalesce(fs, 0)), 6) as score from e full join f on e.uri = f.uri and e.userid = f.userid""")
def d7_resource_search_full_outer(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("d/"), "source").alias("uri"), F.lower("lang").alias("userid"))
    e = docs.join(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    sem = s.group_similarity(e, _query_vector(spark, d), "embedding", ["uri", "userid"])
    names = s.filename_match(docs, "source", "wiki")
    return s.resource_search(sem, names).select("uri", "userid", F.round("score", 6).alias("score"))


_SIM_FILE = similarity_sql("filename", "'urgent report 12'")


@query(f"select upload_id, round(case when {_SIM_FILE} > 0.3 then 0.7 + 0.3 * {_SIM_FILE} else 0.0 end, 6) as score from {UPLOADS_SQL} where instr(lower(filename), 'urgent report 12') > 0 or {_SIM_FILE} > 0.3")
def filename_match(spark: SparkSession, d: str) -> DataFrame:
    return s.filename_match(frames.uploads(spark, d), "filename", "urgent report 12").select("upload_id", F.round("filename_score", 6).alias("score"))


@query(f"""with up as (select * from {UPLOADS_SQL} where tag in ('F', 'O')), sem as (select 's3://u/' || vec_id as uri, list_cosine_similarity(embedding::double[], {_Q}) as semantic_score from embeddings),
ch as (select 's3://u/' || l_orderkey as uri, count(*) as chunk_count, sum(l_quantity)::bigint as resource_size from lineitem group by 1),
b as (select up.*, semantic_score as score, 'semantic' as match_type from up join sem on up.uri = sem.uri where semantic_score > 0
union all select up.*, case when {_SIM_FILE} > 0.3 then 0.7 + 0.3 * {_SIM_FILE} else 0.0 end, 'filename' from up where instr(lower(filename), 'urgent report 12') > 0 or {_SIM_FILE} > 0.3),
o as (select * from (select *, row_number() over (partition by upload_id order by score desc, match_type) as rn from b) where rn = 1)
select upload_id, filename, round(score, 6) as score, match_type, coalesce(chunk_count, 0) as chunk_count, coalesce(resource_size, 0) as resource_size from o left join ch on o.uri = ch.uri order by o.score desc, updated_at desc, upload_id limit 20""")
def d8_file_upload_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = vec.literal_vector(_query_vector(spark, d))
    sem = e.select(F.concat(F.lit("s3://u/"), F.col("vec_id").cast("string")).alias("uri"), (1 - vec.cosine_distance(F.col("embedding"), q)).alias("semantic_score"))
    ch = table(spark, d, "lineitem").select(F.concat(F.lit("s3://u/"), F.col("l_orderkey").cast("string")).alias("uri"), F.col("l_quantity").cast("long").alias("size"))
    out = s.file_upload_search(frames.uploads(spark, d), sem, ch, "urgent report 12", ["F", "O"], 20)
    return out.select("upload_id", "filename", F.round("score", 6).alias("score"), "match_type", "chunk_count", "resource_size")


@query(f"""with h as (select vec_id, list_distance(embedding::double[], {_Q}) as x from embeddings where list_distance(embedding::double[], {_Q}) <= 1.35 order by 2, 1 limit 30),
v as (select doc_id as id, x as vdistance, row_number() over (order by x, doc_id) as pos from h join documents on doc_id = vec_id),
q as (select doc_id as id, row_number() over (order by n_chars desc, doc_id) as pos from (select doc_id, n_chars from documents where lower(text) like '%tide%' and n_chars is not null order by n_chars desc, doc_id limit 10)),
u as (select id, 0.4::double as s, 'sql' as source from q union all select id, 0.4 * (1 - vdistance), 'vector' from v where pos <= 10), b as (select id, round(sum(s), 9) as score, string_agg(source, ',' order by source) as source from u group by 1),
t as (select * from b order by score desc, id limit 10)
select t.id, d.source as doc_source, round(score, 6) as score, t.source, rank() over (order by score desc) as rank from t join documents d on d.doc_id = t.id""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: documents by content and by vector, merged and ranked, with their rows."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents")
    pos = lambda *o: F.row_number().over(Window.orderBy(*o)).alias("pos")
    found = docs.where(F.contains(F.lower("text"), F.lit("tide")) & F.col("n_chars").isNotNull()).select(F.col("doc_id").alias("id"), "n_chars").orderBy(F.desc("n_chars"), "id").limit(10)
    sql = found.select("id", pos(F.desc("n_chars"), "id"))
    near = s.vector_search(table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id", "embedding", 1.35, 30)
    near = docs.select(F.col("doc_id").alias("id")).join(F.broadcast(near), "id").select("id", "vdistance", pos("vdistance", "id"))  # at most 30 rows
    top = s.merge_search_results(sql, near, None, max_results=10)
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("doc_source")).join(F.broadcast(top), "id").select("id", "doc_source", F.round("score", 6).alias("score"), "source", "rank")


# ---------------------------------------------------------------- searches with three legs

_QR = "(select embedding_vector::double[] from resource_embeddings where embedding_name = 'quill-embed-64' and len(embedding_vector) = 64 and not list_contains(list_transform(embedding_vector, lambda v: v is null or isnan(v)), true) and list_contains(list_transform(embedding_vector, lambda v: v <> 0), true) order by id limit 1)"
_OK = "embedding_name = 'quill-embed-64' and len({0}) = 64 and len(list_filter({0}, lambda v: v is null or isnan(v))) = 0"


def _question(spark: SparkSession, d: str) -> list[float]:
    e = table(spark, d, "resource_embeddings")
    v = F.col("embedding_vector")
    ok = (F.col("embedding_name") == "quill-embed-64") & (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return e.where(ok).orderBy("id").select("embedding_vector").first()[0]


def _usable(spark: SparkSession, d: str, name: str, vector: str) -> DataFrame:
    v = F.col(vector)
    ok = (F.col("embedding_name") == "quill-embed-64") & (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return table(spark, d, name).where(ok).select("source_record_id", vector)


def _legs(spark: SparkSession, d: str) -> DataFrame:
    r = frames.current(spark, d, "resources", ["content", "graph_paths", "userid", "ordinal"])
    return s.three_legs(r, _usable(spark, d, "resource_embeddings", "embedding_vector"), _question(spark, d), "source_record_id", "embedding_vector", F.contains(F.lower("content"), F.lit("tide")), ["-ordinal"], threshold=1.2, limit=8)


def _memory_legs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memory_requests").where("id is not null").dropDuplicates(["id"])
    return s.three_legs(m, _usable(spark, d, "embedding_records", "embedding"), _question(spark, d), "source_record_id", "embedding", F.contains(F.lower("content"), F.lit("tide")), [], paths=None, threshold=1.2, limit=8)


_LEGS_SQL = f"""r as (select id, content, graph_paths, ordinal from {_CURRENT_RES} x),
rv as (select source_record_id as id, min(list_distance(embedding_vector::double[], {_QR})) as vdistance from resource_embeddings where {_OK.format('embedding_vector')} group by 1 having min(list_distance(embedding_vector::double[], {_QR})) <= 1.2 order by 2, 1 limit 8),
vec as (select 'vector' as leg, r.id, row_number() over (order by vdistance, r.id) as pos, vdistance, content from rv join r on r.id = rv.id),
sq as (select 'sql' as leg, id, row_number() over (order by ordinal desc nulls last, id) as pos, null::double as vdistance, content from (select * from r where lower(content) like '%tide%' order by ordinal desc nulls last, id limit 8)),
con as (select distinct id, concept from (select id, unnest(string_split(p, '/')) as concept from (select id, unnest(graph_paths) as p from r)) where concept <> ''),
gn as (select id, count(distinct concept) as n from con where concept in (select concept from con where id in (select id from vec)) and id not in (select id from rv) group by 1 order by 2 desc, 1 limit 8),
gr as (select 'graph' as leg, r.id, row_number() over (order by n desc, r.id) as pos, null::double as vdistance, content from gn join r on r.id = gn.id),
rl as (select * from vec union all select * from sq union all select * from gr)"""
_MEM_SQL = f"""m as (select * from (select *, row_number() over (partition by id order by content) as rn from memory_requests where id is not null) where rn = 1),
mv as (select source_record_id as id, min(list_distance(embedding::double[], {_QR})) as vdistance from embedding_records where {_OK.format('embedding')} group by 1 having min(list_distance(embedding::double[], {_QR})) <= 1.2 order by 2, 1 limit 8),
ml as (select 'vector' as leg, m.id, row_number() over (order by vdistance, m.id) as pos, vdistance, content from mv join m on m.id = mv.id
union all select 'sql', id, row_number() over (order by id), null, content from (select * from m where lower(content) like '%tide%' order by id limit 8))"""
_MERGED_SQL = "select id, round(sum(case leg when 'sql' then 0.4 when 'vector' then 0.4 * (1 - vdistance) else 0.2 * 0.9 end), 9) as score, max(content) as content, string_agg(leg, ',' order by leg) as source from {} where pos <= 10 group by 1"


@query(f"with {_LEGS_SQL} select leg, id, pos, round(vdistance, 6) as vdistance, length(content) as size from rl")
def d5_three_legs(spark: SparkSession, d: str) -> DataFrame:
    return _legs(spark, d).select("leg", "id", "pos", F.round("vdistance", 6).alias("vdistance"), F.length("content").cast("long").alias("size"))


@query(f"""with {_LEGS_SQL}, n as (select count(*) filter (leg = 'sql') as s, count(*) filter (leg = 'vector') as v, count(*) filter (leg = 'graph') as g, min(vdistance) as b from rl)
select 'tide' as query_text, 0.8::double as confidence, s as n_relational, v as n_vector, g as n_graph, round(least(case when s > 0 then 0.8 * 0.4 + least(s, 5) * 0.02 else 0 end + case when v > 0 then (1 - b) * 0.4 + least(v, 5) * 0.02 else 0 end + case when g > 0 then 0.2 else 0 end, 1.0)::double, 6) as hybrid_score from n""")
def d5_entity_search(spark: SparkSession, d: str) -> DataFrame:
    a = s.entity_search(_legs(spark, d), "tide", 0.8)
    n = lambda c: F.json_array_length(c).cast("long")
    return a.select("query_text", "confidence", n("relational_result").alias("n_relational"), n("vector_result").alias("n_vector"), n("graph_result").alias("n_graph"), F.round("hybrid_score", 6).alias("hybrid_score"))


@query(f"with {_LEGS_SQL}, b as ({_MERGED_SQL.format('rl')}), t as (select * from b order by score desc, id limit 10) select id, round(score, 6) as score, content, source, rank() over (order by score desc) as rank from t")
def d4_merged_legs(spark: SparkSession, d: str) -> DataFrame:
    return s.merged_legs(_legs(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""with {_LEGS_SQL}, {_MEM_SQL}, b as (select 'resources' as entity_type, * from (select * from ({_MERGED_SQL.format('rl')}) order by score desc, id limit 10) union all select 'memory_requests', * from (select * from ({_MERGED_SQL.format('ml')}) order by score desc, id limit 10)),
t as (select * from b order by score desc, entity_type, id limit 10),
st as (select 'resources' as e, count(*) filter (leg = 'sql') as s, count(*) filter (leg = 'vector') as v, count(*) filter (leg = 'graph') as g from rl union all select 'memory_requests', count(*) filter (leg = 'sql'), count(*) filter (leg = 'vector'), 0 from ml)
select entity_type, id, round(score, 6) as score, content, row_number() over (order by score desc, entity_type, id) as rank, '{{"sql":' || s || ',"vector":' || v || ',"graph":' || g || '}}' as stats from t join st on e = entity_type""")
def d6_search_entities(spark: SparkSession, d: str) -> DataFrame:
    found = s.search_entities({"resources": _legs(spark, d), "memory_requests": _memory_legs(spark, d)}, stats=True)
    return found.withColumn("score", F.round("score", 6))


_SIM_RES = f"greatest({similarity_sql('name', repr('seed catalogues'))}, {similarity_sql('uri', repr('seed catalogues'))})"


@query(f"""with r as (select * from {_CURRENT_RES} x), sem as (select r.uri, r.userid, 1 - min(1 - list_cosine_similarity(embedding_vector::double[], {_QR})) as ss from r join resource_embeddings e on e.source_record_id = r.id where {_OK.format('embedding_vector')} group by 1, 2),
f as (select uri, userid, max(case when {_SIM_RES} > 0.3 then 0.7 + 0.3 * {_SIM_RES} else 0.0 end) as fs from r where instr(lower(name), 'seed catalogues') > 0 or instr(lower(uri), 'seed catalogues') > 0 or {_SIM_RES} > 0.3 group by 1, 2),
c as (select coalesce(sem.uri, f.uri) as uri, coalesce(sem.userid, f.userid) as userid, greatest(coalesce(ss, 0), coalesce(fs, 0)) as score from sem full join f on sem.uri = f.uri and sem.userid = f.userid),
g as (select uri, userid, max(name) as resource_name, count(*) as chunk_count, sum(length(content))::bigint as total_chunk_size, avg(length(content)) as avg_chunk_size, max(resource_timestamp) as max_date, coalesce(string_agg(distinct category, ',' order by category), '') as categories from r group by 1, 2),
b as (select uri, userid, max(score) as score from c group by 1, 2)
select g.uri, resource_name, chunk_count, total_chunk_size, round(avg_chunk_size, 4) as avg_chunk_size, max_date, categories, round(score, 6) as semantic_score, g.userid as user_id from g join b on g.uri = b.uri and g.userid = b.userid order by score desc, max_date desc nulls last, g.uri, g.userid limit 20""")
def d7_resource_report(spark: SparkSession, d: str) -> DataFrame:
    r = frames.current(spark, d, "resources", ["uri", "name", "userid", "content", "category", "resource_timestamp"])
    e = _usable(spark, d, "resource_embeddings", "embedding_vector").join(r.select(F.col("id").alias("source_record_id"), "uri", "userid"), "source_record_id")
    sem = s.group_similarity(e, _question(spark, d), "embedding_vector", ["uri", "userid"])
    both = r.select("uri", "userid", F.explode(F.array("name", "uri")).alias("label"))
    scores = s.resource_search(sem, s.filename_match(both, "label", "seed catalogues"))
    out = s.resource_report(r, scores)
    return out.withColumn("avg_chunk_size", F.round("avg_chunk_size", 4)).withColumn("categories", F.array_join("categories", ",")).withColumn("semantic_score", F.round("semantic_score", 6))
