"""Graph construction, traversal, compaction and the Cypher subset over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import frames
from weftline.catalog.frames import TRADE_SQL
from weftline.catalog.registry import current, query
from weftline.operators import graph as g
from weftline.plans.cypher import Cypher, cypher_query
from weftline.session import cut, table


@query("select n_name as nation, r_name as region from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA' or r_name = 'EUROPE'")
def a1_cypher_match(spark: SparkSession, d: str) -> DataFrame:
    return Cypher(*frames.trade_graph(spark, d)).run("MATCH (n:Nation)-[:in]->(r:Region) WHERE r.name IN ['ASIA', 'EUROPE'] RETURN n.name AS nation, r.name AS region")


@query("select r_name as region, c_mktsegment as segment, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2 having count(*) > 3")
def a1_cypher_grouped(spark: SparkSession, d: str) -> DataFrame:
    return Cypher(*frames.trade_graph(spark, d)).run(
        "MATCH (c:Customer)-[:lives]->(n:Nation), (n)-[:in]->(r:Region) WITH r.name AS region, c.c_mktsegment AS segment, count(c.id) AS n WHERE n > 3 RETURN region, segment, n"
    )


@query("select s_name as supplier from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1 order by s_name limit 7")
def a1_cypher_json(spark: SparkSession, d: str) -> DataFrame:
    q = "MATCH (s:Supplier)-[:based]->(n:Nation)-[:in]->(r:Region {name: 'AMERICA'}) RETURN s.name AS supplier ORDER BY supplier LIMIT 7"
    return cypher_query(*frames.trade_graph(spark, d), q).select(F.get_json_object("result", "$.supplier").alias("supplier"))


@query("select c_name as source_name, c_mktsegment as target_name, c_acctbal >= 0 as active, 'v' || c_nationkey as v from customer")
def a3_add_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Customers are linked to segments twice over; those in debt are then terminated."""
    c = table(spark, d, "customer")
    req = lambda act, p: c.select(F.lit("Customer").alias("source_label"), F.col("c_name").alias("source_name"), F.lit("buys").alias("rel_type"), F.col("c_mktsegment").alias("target_name"), act.alias("activate"), F.lit(None).cast("string").alias("source_user_id"), F.lit("Segment").alias("target_label"), F.lit(None).cast("string").alias("target_user_id"), p.alias("rel_props"))
    empty = spark.createDataFrame([], "id bigint, src bigint, dst bigint, rel_type string, created_at timestamp, terminated_at timestamp, props map<string,string>")
    now = F.lit("2025-01-01").cast("timestamp")
    first = g.merge_relationships(empty, req(F.lit(True), F.create_map(F.lit("v"), F.lit("old"))), now)
    edges = g.merge_relationships(first, req(F.col("c_acctbal") >= 0, F.create_map(F.lit("v"), F.concat(F.lit("v"), F.col("c_nationkey")))), now)
    nodes = g.nodes_from(c, "Customer", "c_name").unionByName(g.nodes_from(c, "Segment", "c_mktsegment"))
    n = nodes.select("id", "key")
    out = edges.join(n.select(F.col("id").alias("src"), F.col("key").alias("source_name")), "src").join(n.select(F.col("id").alias("dst"), F.col("key").alias("target_name")), "dst")
    return out.select("source_name", "target_name", F.col("terminated_at").isNull().alias("active"), F.col("props")["v"].alias("v"))


@query("select s_name as source_name, 'based' as rel_type, n_name as target_name from supplier join nation on s_nationkey = n_nationkey where n_name = 'NATION_4'")
def a4_get_relationships(spark: SparkSession, d: str) -> DataFrame:
    return g.relationships(*frames.trade_graph(spark, d), source_label="Supplier", rel_type="based", target_label="Nation", target_name="NATION_4").select("source_name", "rel_type", "target_name")


@query("""select distinct r.r_name as hub, b.n_name as target from nation a join region r on a.n_regionkey = r.r_regionkey join nation b on b.n_regionkey = r.r_regionkey and b.n_name <> a.n_name where a.n_name = 'NATION_6'
union select null, b.n_name from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name where a.n_name = 'NATION_6'""")
def a5_connected_entities(spark: SparkSession, d: str) -> DataFrame:
    return g.connected_entities(*frames.trade_graph(spark, d), "Nation", "NATION_6", "Region", "Nation")


@query("""select 2::bigint as path_length, a.n_name as origin, b.n_name as target from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name
where a.n_name in ('NATION_2', 'NATION_9') order by 1, 2, 3 limit 6""")
def a6_graph_paths(spark: SparkSession, d: str) -> DataFrame:
    return g.paths_between(*frames.trade_graph(spark, d), ["NATION_2", "NATION_9"], "Nation", 3, 6, "in").select("path_length", "origin", "target")


@query("with recursive " + TRADE_SQL + """,
p as (select b as node, 1::bigint as path_length, [eid] as used from steps where a = 'NNATION_3'
  union all select s.b, p.path_length + 1, list_append(p.used, s.eid) from p join steps s on s.a = p.node and not list_contains(p.used, s.eid) where p.path_length < 3)
select substring(node, 2) as name, path_length, count(*) as paths from p where node like 'N%' or node like 'R%' or node like 'S%' group by 1, 2""")
def a7_connected_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = g.connected_nodes(*frames.trade_graph(spark, d), "Nation", "NATION_3", max_length=3).where("label in ('Nation', 'Region', 'Supplier')")
    return n.groupBy("name", "path_length").agg(F.count("*").alias("paths"))


@query("select distinct 'hour_' || hour(ts) as concept from events where user_id = 8 and event_type = 'view'")
def a8_user_concept_links(spark: SparkSession, d: str) -> DataFrame:
    return g.concept_links(*frames.memory_graph(spark, d), "user_8", "view", select_hub=False, depth=2).select("concept").distinct()


@query("select 'user_' || user_id as user_key, event_type as rel_type, count(distinct hour(ts)) as n from events group by 1, 2 having count(distinct hour(ts)) > 4")
def a9_compact_candidates(spark: SparkSession, d: str) -> DataFrame:
    return g.compact_hubs(*frames.memory_graph(spark, d), threshold=4)[2].select("user_key", "rel_type", "n")


@query("""with e as (select distinct user_id, event_type, hour(ts) as h from events), c as (select user_id, event_type, count(*) as n from e group by 1, 2)
select event_type as rel_type, (sum(n) + count(*) filter (n > 4))::bigint as edges, (count(*) filter (n > 4))::bigint as hubs from c group by 1""")
def a9_compact_memory(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each type after compaction (twice, which must change nothing), and how many go to hubs."""
    nodes, edges = frames.memory_graph(spark, d)
    n, e, _ = g.compact_hubs(nodes, cut(edges), threshold=4)
    n2, e2, _ = g.compact_hubs(cut(n), cut(e), threshold=4)
    hubs = n2.where(F.col("props")["is_hub"] == "true").select(F.col("id").alias("dst"), F.lit(1).alias("h"))
    return e2.join(hubs, "dst", "left").groupBy("rel_type").agg(F.count("*").alias("edges"), F.count("h").alias("hubs"))


_PATHS = "(select p_name || '/' || p_brand || '/' || p_type || case when p_partkey % 10 = 0 then '/x' else '' end as path from part)"


@query(f"select path, case when len(string_split(path, '/')) = 3 then 'success' else 'failure' end as status, case when len(string_split(path, '/')) <> 3 then 'Invalid path format' end as error_message from {_PATHS}")
def a10_path_status(spark: SparkSession, d: str) -> DataFrame:
    return g.graph_from_paths(_part_paths(spark, d))[2]


@query(f"""with p as (select string_split(path, '/') as x from {_PATHS} where len(string_split(path, '/')) = 3)
select distinct x[1] as source, x[2] as target from p union select distinct x[2], x[3] from p""")
def a10_graph_from_paths(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = g.graph_from_paths(_part_paths(spark, d))
    return _named(n, e).select("source", "target")


def _part_paths(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 10 == 0, "/x").otherwise("")
    return table(spark, d, "part").select(F.concat("p_name", F.lit("/"), "p_brand", F.lit("/"), "p_type", tail).alias("path"))


def _named(n: DataFrame, e: DataFrame) -> DataFrame:
    k = n.select("id", "key")
    return e.join(k.select(F.col("id").alias("src"), F.col("key").alias("source")), "src").join(k.select(F.col("id").alias("dst"), F.col("key").alias("target")), "dst")


@query("select name || '/' || p as path from (select name, unnest(graph_paths) as p from " + current("resources") + " where name is not null) where p is not null")
def a11_build_graph_index(spark: SparkSession, d: str) -> DataFrame:
    return g.entity_paths(frames.current(spark, d, "resources", ["name", "graph_paths"]))


@query("select distinct s_name as source, p_brand as target, l_discount as weight from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey")
def a12_weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    li, s, p = (table(spark, d, x) for x in ("lineitem", "supplier", "part"))
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey).select("s_name", F.struct(F.col("p_brand").alias("name"), F.col("l_discount").alias("weight")).alias("e")).distinct()
    n, e = g.weighted_edges(j.groupBy(F.col("s_name").alias("name")).agg(F.collect_list("e").alias("edges")))
    return _named(n, e).select("source", "target", F.col("props")["weight"].cast("double").alias("weight"))


@query("select n_nationkey, n_name || '>' || r_name as names from nation join region on n_regionkey = r_regionkey")
def a13_path_names(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.to_json(F.array(F.struct(F.struct(F.col("n_name").alias("name")).alias("properties")), F.struct(F.struct(F.col("r_name").alias("name")).alias("properties"))))
    nodes = F.from_json(text, "array<struct<properties:struct<name:string>>>")
    return j.select("n_nationkey", F.array_join(g.path_names(nodes), ">").alias("names"))


@query("select c_custkey, c_nationkey < 20 as indexed from customer")
def b1_graph_watermark_view(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = frames.trade_graph(spark, d)
    seen = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_name").alias("key"))
    nodes = nodes.where("label = 'Customer'").join(seen, "key", "left_semi")
    return g.watermark_view(table(spark, d, "customer"), nodes, "c_name", "Customer").select("c_custkey", F.col("gid").isNotNull().alias("indexed"))


@query("select c_custkey from customer where c_nationkey >= 20 order by c_custkey limit 40")
def b2_pending_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = frames.trade_graph(spark, d)
    seen = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_name").alias("key"))
    return g.pending_nodes(table(spark, d, "customer").select("c_custkey", "c_name"), nodes.join(seen, "key", "left_semi"), "c_name", "Customer").select("c_custkey").orderBy("c_custkey").limit(40)


@query("""select name as key, userid as user_id from (select distinct name, userid from """ + current("resources") + """ where name is not null) where name in ('Bicycle parts', 'Bicycle parts notes', 'Seed catalogues overview')
and (userid is null or userid = (select max(userid) from resources))""")
def b4_graph_nodes_by_key(spark: SparkSession, d: str) -> DataFrame:
    r = frames.current(spark, d, "resources", ["name", "userid"])
    nodes = g.nodes_from(r, "public__Resources", "name", "userid")
    me = table(spark, d, "resources").agg(F.max("userid")).first()[0]
    return g.nodes_by_key(nodes, ["Bicycle parts", "Bicycle parts notes", "", "Seed catalogues overview"], me).select("key", "user_id")


@query("select n_name as key from nation where n_nationkey in (1, 5)")
def b5_graph_nodes_by_id(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = frames.trade_graph(spark, d)
    ids = [r.id for r in nodes.where("label = 'Nation' and key in ('NATION_1', 'NATION_5')").select("id").collect()]
    return g.nodes_by_id(nodes, ids).select("key")


@query("""select 'Customer' as entity_type, count(*) as n, min(c_name) as first from customer union all select 'Nation', count(*), min(n_name) from nation
union all select 'Region', count(*), min(r_name) from region union all select 'Supplier', count(*), min(s_name) from supplier""")
def b8_cypher_entity_match(spark: SparkSession, d: str) -> DataFrame:
    k = g.group_keys_by_label(frames.trade_graph(spark, d)[0])
    return k.select("entity_type", F.size("node_keys").cast("long").alias("n"), F.col("node_keys")[0].alias("first"))


@query("""with recursive e as (select l_suppkey as a, l_partkey as b from (select distinct l_suppkey, l_partkey from lineitem where l_quantity > 49) ),
x as (select distinct 's' || a as n from e union select distinct 'p' || b from e),
st as (select 's' || a as a, 'p' || b as b from e union all select 'p' || b, 's' || a from e),
r as (select n as o, n from x union select r.o, st.b from r join st on st.a = r.n)
select o as node, min(n) as component from r group by 1""")
def connected_components_of_edges(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.components import connected_components

    li = table(spark, d, "lineitem").where("l_quantity > 49")
    return connected_components(li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")))


@query()
def connected_components_of_all_edges(spark: SparkSession, d: str) -> DataFrame:
    """As above over every row of lineitem; the closure of the SQL is too large for that, so it has none."""
    from weftline.operators.components import connected_components

    li = table(spark, d, "lineitem")
    return connected_components(li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")))
