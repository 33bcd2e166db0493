"""Selection, storage, joins, aggregates and security over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.catalog import frames
from weftline.catalog.registry import current, query
from weftline.functions import ids, text
from weftline.operators import entities, security
from weftline.operators.numbering import number_rows
from weftline.session import table


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus in ('F', 'P') and o_orderpriority = '1-URGENT'")
def select_with_predicates(spark: SparkSession, d: str) -> DataFrame:
    return entities.select_with_predicates(table(spark, d, "orders"), {"o_orderstatus": ["F", "P"], "o_orderpriority": "1-URGENT"}, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1998-06-01'")
def select_since(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    return entities.select_with_predicates(table(spark, d, "orders"), {}, ["o_orderkey", "o_orderdate"], since=dt.datetime(1998, 6, 1), since_column="o_orderdate")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    return entities.select_with_predicates(table(spark, d, "orders"), {}, ["o_orderkey", "o_totalprice"], ["-o_totalprice", "o_orderkey"], 25, 50)


@query("select count(*) as n, count(distinct c_nationkey) as nations, round(sum(c_acctbal), 2) as total from customer")
def scan_entity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("nations"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("select n_nationkey, n_name as name, n_regionkey::bigint as region from nation")
def project_row_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows to JSON and scalars back from it."""
    n = table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("*")).alias("j"))
    return n.select("n_nationkey", F.get_json_object("j", "$.n_name").alias("name"), F.get_json_object("j", "$.n_regionkey").cast("long").alias("region"))


@query("select n_nationkey, n_name as name from nation where n_name in ('NATION_3', 'NATION_7', 'NATION_12')")
def b7_get_records_by_keys(spark: SparkSession, d: str) -> DataFrame:
    r = entities.records_by_keys(table(spark, d, "nation"), ["NATION_3", "NATION_7", None, "", "NATION_12"], "n_name")
    return r.select(F.get_json_object("record", "$.n_nationkey").cast("int").alias("n_nationkey"), F.get_json_object("record", "$.n_name").alias("name"))


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)")
def semi_join_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return entities.semi_join_keys(table(spark, d, "customer").select("c_custkey", "c_name"), keys, "c_custkey")


@query("select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def delete_antijoin(spark: SparkSession, d: str) -> DataFrame:
    doomed = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return entities.delete_where(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), doomed, "c_custkey")


@query("""with last as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders)
select c_custkey, c_name, coalesce(o_totalprice, c_acctbal) as c_acctbal from customer left join last on c_custkey = o_custkey and rn = 1""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    o = table(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    changes = o.select(F.col("o_custkey").alias("c_custkey"), "c_name", F.col("o_totalprice").alias("c_acctbal"), F.struct("o_orderdate", "o_orderkey").alias("v"))
    return entities.upsert(c, changes, "c_custkey", "v").drop("v")


@query("select n_nationkey, n_name from nation union all select c.k, 'new' from (select distinct c_custkey::int as k from customer) c where c.k not in (select n_nationkey from nation)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("n_nationkey"), F.lit("new").alias("n_name"))
    return entities.insert_if_absent(n, rows, "n_nationkey")


@query("select id, name, category, ordinal from " + current("resources"))
def latest_resources(spark: SparkSession, d: str) -> DataFrame:
    return frames.current(spark, d, "resources", ["name", "category", "ordinal"])


@query("select id, uri from " + current("resources") + " where userid is null or userid = (select min(userid) from resources)")
def public_or_owned(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.search import visible_to

    r = frames.current(spark, d, "resources", ["uri", "userid"])
    me = table(spark, d, "resources").agg(F.min("userid")).first()[0]
    return r.where(visible_to(me)).select("id", "uri")


@query("select c as column_name, v as value from (select 'o_orderstatus' as c, o_orderstatus as v from orders union select 'o_orderpriority', o_orderpriority from orders) where v is not null")
def b10_enum_values(spark: SparkSession, d: str) -> DataFrame:
    return entities.enum_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_orderkey"])


@query("""select replace(k, '__', '.') as entity_type, string_agg(id, ',' order by id) as ids from (
  select distinct 'public__' || o_orderstatus as k, o_custkey::varchar as id from orders where o_totalprice > 400000) group by 1""")
def b6_group_ids_by_type(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(F.concat(F.lit("public__"), "o_orderstatus").alias("entity_type"), F.col("o_custkey").alias("id"))
    return entities.group_ids(o).select("entity_type", F.array_join("ids", ",").alias("ids"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events where json_exists(props, '$.k')")
def json_has_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where(F.array_contains(F.json_object_keys("props"), "k")).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select l_orderkey, count(*) as lines, string_agg(l_linenumber::varchar, ',' order by l_linenumber, l_partkey) as numbers from lineitem group by 1")
def json_unnest(spark: SparkSession, d: str) -> DataFrame:
    """Lines packed into a JSON array a key and unnested again."""
    packed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))).alias("j"))
    un = packed.select("l_orderkey", F.posexplode(F.from_json("j", "array<struct<l_linenumber:int,l_partkey:bigint>>")).alias("pos", "x"))
    return un.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x.l_linenumber").alias("n")))), lambda y: y["n"].cast("string")), ",").alias("numbers"))


@query("select o_orderkey, o_orderstatus from orders where list_has_any([o_orderstatus], ['O', 'P'])")
def tags_overlap(spark: SparkSession, d: str) -> DataFrame:
    return frames.uploads(spark, d).where(F.arrays_overlap("tags", F.array(F.lit("O"), F.lit("P")))).select(F.col("upload_id").cast("long").alias("o_orderkey"), F.col("tags")[0].alias("o_orderstatus"))


@query("""select event_id, case when regexp_full_match(v, '\\s*[0-9]*\\.?[0-9]+\\s*') then trim(v)::double else 0.5 end as confidence
from (select event_id, case when event_id % 3 = 0 then 'high' when event_id % 3 = 1 then ' 0.' || (event_id % 97) || ' ' else (event_id % 7)::varchar end as v from events)""")
def d9_confidence_parse(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.search import parsed_confidence

    e = table(spark, d, "events")
    m = lambda n: (F.col("event_id") % n).cast("string")
    v = F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, F.concat(F.lit(" 0."), m(97), F.lit(" "))).otherwise(m(7))
    return e.select("event_id", parsed_confidence(v).alias("confidence"))


# ---------------------------------------------------------------- security

_USERS = "id string, role_level int, required_access_level int, groups array<string>"


@query("""select id, required_access_level from (select * from """ + current("resources") + """)
where 10 <= coalesce(required_access_level, 5) or userid = (select min(userid) from resources) or groupid in ('ops')""")
def g1_row_filter(spark: SparkSession, d: str) -> DataFrame:
    r = frames.current(spark, d, "resources", ["userid", "groupid", "required_access_level"])
    me = table(spark, d, "resources").agg(F.min("userid")).first()[0]
    users = spark.createDataFrame([(me, 10, None, ["ops"])], _USERS)
    return security.secured(r, security.user_context(users, me)).select("id", "required_access_level")


@query("""select id, required_access_level from (select * from """ + current("resources") + """)
where 100 <= coalesce(required_access_level, 5) and (userid is null or userid = (select max(userid) from resources))""")
def g1_row_filter_and(spark: SparkSession, d: str) -> DataFrame:
    r = frames.current(spark, d, "resources", ["userid", "groupid", "required_access_level"])
    me = table(spark, d, "resources").agg(F.max("userid")).first()[0]
    return security.secured(r, security.UserContext(me, 100), "and").select("id", "required_access_level")


@query("select id, name from " + current("api_functions") + " where 10 <= coalesce(required_access_level, 100)")
def g6_function_gating(spark: SparkSession, d: str) -> DataFrame:
    return security.allowed_functions(frames.current(spark, d, "api_functions", ["name", "required_access_level"]), 10).select("id", "name")


# ---------------------------------------------------------------- ids and texts


@query("""select c_custkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) as id
from (select c_custkey, md5('{"key": ' || c_custkey || ', "name": "' || c_name || '", "nation": ' || c_nationkey || '}') as h from customer)""")
def h10_jsonb_uuid(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", ids.jsonb_uuid({"nation": (F.col("c_nationkey"), "number"), "key": (F.col("c_custkey"), "number"), "name": (F.col("c_name"), "string")}).alias("id"))


@query("""with p as (select o_custkey, o_orderstatus as k, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as v from orders group by 1, 2)
select o_custkey, string_agg(k || '=' || v, '&' order by length(k), k) as q from p group by 1""")
def h6_encode_url_query(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("v"))
    m = p.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("m"))
    return m.select("o_custkey", text.encode_url_query(F.col("m")).alias("q"))


@query("""select doc_id, i::bigint as ordinal, substring(text, (i * 1000 + 1)::int, 1000) as chunk from documents, range(0, (length(text) + 999) // 1000) r(i) where length(text) > 0""")
def client_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"), "text", 1000).select("doc_id", "ordinal", "chunk")


@query()
def client_overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.overlap_chunks(table(spark, d, "documents"), "doc_id", "text")


@query()
def client_markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return text.markdown_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("select p_partkey, p_name || ' [' || p_brand || '] & ' || p_type as txt from part")
def client_html_to_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    html = F.concat(F.lit("<div><style>b {x}</style><p>"), "p_name", F.lit("</p>\n <b>["), "p_brand", F.lit("]</b> &amp; "), "p_type", F.lit("</div>"))
    return p.select("p_partkey", text.html_to_text(html).alias("txt"))


@query("select n_nationkey, n_nationkey || ' | ' || n_name || ' | ' || n_regionkey as line from nation")
def client_row_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", text.row_text(None, ["n_nationkey", "n_name", "n_regionkey"]).alias("line"))


@query("select o_orderkey, o_orderpriority as filename, o_orderstatus as filetype from orders")
def client_upload_metadata(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    b = lambda c: F.base64(F.encode(F.col(c), "UTF-8"))
    o = o.withColumn("h", F.concat(F.lit("filename "), b("o_orderpriority"), F.lit(", filetype "), b("o_orderstatus"), F.lit(",empty")))
    m = text.upload_metadata(F.col("h"))
    return o.select("o_orderkey", m["filename"].alias("filename"), m["filetype"].alias("filetype"))


@query("""select n_nationkey, case n_nationkey % 4 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'application/gzip' else 'text/plain' end as kind from nation""")
def client_file_type(spark: SparkSession, d: str) -> DataFrame:
    from weftline.sources.files import file_type

    n = table(spark, d, "nation")
    k = F.col("n_nationkey") % 4
    head = F.when(k == 0, F.unhex(F.lit("255044462D"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(k == 2, F.unhex(F.lit("1F8B0800"))).otherwise(F.encode("n_name", "UTF-8"))
    return n.select("n_nationkey", file_type(head).alias("kind"))


@query("select id, case when uri like '%.md' or uri like '%.txt' or uri like '%.html' then 'text' when uri like '%.csv' then 'csv' when uri like '%.json' then 'json' when uri like '%.pdf' then 'pdf' when uri like '%.wav' or uri like '%.mp3' or uri like '%.m4a' then 'audio' when uri like '%.docx' or uri like '%.xlsx' or uri like '%.pptx' then 'office' when uri like '%.png' or uri like '%.jpg' then 'image' when uri is null then null else 'binary' end as kind from " + current("resources"))
def client_extension_type(spark: SparkSession, d: str) -> DataFrame:
    from weftline.sources.files import extension_type

    r = frames.current(spark, d, "resources", ["uri"])
    return r.select("id", F.when(F.col("uri").isNotNull(), extension_type(F.col("uri"))).alias("kind"))


@query("""with recursive f as (select p_partkey as id, case when p_partkey > 0 then p_partkey // 5 end as parent_id, p_name as name from part),
t as (select id, name as path, 0::bigint as depth from f where parent_id is null union all select f.id, t.path || '/' || f.name, t.depth + 1 from t join f on f.parent_id = t.id)
select id, path, depth from t""")
def client_folder_tree(spark: SparkSession, d: str) -> DataFrame:
    from weftline.sources.files import folder_paths

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 5)).alias("parent_id"), F.col("p_name").alias("name"))
    return folder_paths(p)


@query("""select resource_id, id, (row_number() over (partition by resource_id order by ordinal, id) - 1)::bigint as n from """ + current("markdown_chunks", "content"))
def number_rows_in_groups(spark: SparkSession, d: str) -> DataFrame:
    m = frames.current(spark, d, "markdown_chunks", ["resource_id", "ordinal"])
    return number_rows(m, ["resource_id"], ["ordinal", "id"], out="n").select("resource_id", "id", "n")


# ---------------------------------------------------------------- breadth beyond the reference


@query("""select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)""")
def z_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""select o_orderkey, o_custkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as moving from orders""")
def z_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w), 2).alias("moving"))


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def z_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '2001-06-01' group by 1, 2""")
def z_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
