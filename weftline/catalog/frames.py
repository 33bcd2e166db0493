"""Frames that several queries share: graphs, users, uploads and current rows of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.graph import EMPTY_PROPS, edge_id, node_id, nodes_from
from weftline.operators.latest import latest_rows
from weftline.session import table


def current(spark: SparkSession, d: str, name: str, keep: list[str]) -> DataFrame:
    t = table(spark, d, name)
    order = ["updated_at"] if "updated_at" in t.columns else [F.lit(0)]
    cols = dict.fromkeys(["id", *[c for c in ("updated_at",) if c in t.columns], *keep])
    return latest_rows(t.where("id is not null").select(*cols), ["id"], order, [c for c in keep if c != "id"])


def _edges(pairs: DataFrame, src_label: str, dst_label: str, rel: str) -> DataFrame:
    no = F.lit(None).cast("timestamp")
    e = pairs.select(node_id(F.lit(src_label), F.col("s")).alias("src"), node_id(F.lit(dst_label), F.col("t")).alias("dst")).distinct()
    return e.select(edge_id(F.col("src"), F.lit(rel), F.col("dst")).alias("id"), "src", "dst", F.lit(rel).alias("rel_type"), no.alias("created_at"), no.alias("terminated_at"), F.expr(EMPTY_PROPS).alias("props"))


def trade_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Region <-in- Nation <-based- Supplier, Nation <-lives- Customer."""
    r, n, s, c = (table(spark, d, x) for x in ("region", "nation", "supplier", "customer"))
    nodes = nodes_from(r, "Region", "r_name").unionByName(nodes_from(n, "Nation", "n_name")).unionByName(nodes_from(s, "Supplier", "s_name", props=["s_acctbal"])).unionByName(nodes_from(c, "Customer", "c_name", props=["c_mktsegment"]))
    rn = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("s"), F.col("r_name").alias("t"))
    sn = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("s"), F.col("n_name").alias("t"))
    cn = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("s"), F.col("n_name").alias("t"))
    return nodes, _edges(rn, "Nation", "Region", "in").unionByName(_edges(sn, "Supplier", "Nation", "based")).unionByName(_edges(cn, "Customer", "Nation", "lives"))


def memory_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """User -event_type-> Concept: what each user of the events table did, concepts being the hours of the day."""
    e = table(spark, d, "events").select(F.concat(F.lit("user_"), F.col("user_id")).alias("s"), F.concat(F.lit("hour_"), F.hour("ts")).alias("t"), "event_type").distinct()
    nodes = nodes_from(e, "User", "s").unionByName(nodes_from(e, "Concept", "t"))
    no = F.lit(None).cast("timestamp")
    edges = e.select(node_id(F.lit("User"), F.col("s")).alias("src"), node_id(F.lit("Concept"), F.col("t")).alias("dst"), F.col("event_type").alias("rel_type"))
    return nodes, edges.select(edge_id(F.col("src"), F.col("rel_type"), F.col("dst")).alias("id"), "src", "dst", "rel_type", no.alias("created_at"), no.alias("terminated_at"), F.expr(EMPTY_PROPS).alias("props"))


TRADE_SQL = """
edges as (
  select 'r' || n_nationkey as eid, 'N' || n_name as a, 'R' || r_name as b, 'in' as rel from nation join region on n_regionkey = r_regionkey
  union all select 's' || s_suppkey, 'S' || s_name, 'N' || n_name, 'based' from supplier join nation on s_nationkey = n_nationkey
  union all select 'c' || c_custkey, 'C' || c_name, 'N' || n_name, 'lives' from customer join nation on c_nationkey = n_nationkey),
steps as (select eid, a, b, rel from edges union all select eid, b, a, rel from edges)"""


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Orders as file uploads: named after priority and key, tagged by status."""
    o = table(spark, d, "orders")
    name = F.concat(F.lower(F.substring("o_orderpriority", 3, 20)), F.lit(" report "), F.col("o_orderkey").cast("string"), F.lit(".csv"))
    return o.select(F.col("o_orderkey").cast("string").alias("upload_id"), name.alias("filename"), F.concat(F.lit("s3://u/"), F.col("o_orderkey").cast("string")).alias("uri"), F.array("o_orderstatus").alias("tags"), F.col("o_orderdate").alias("updated_at"), F.col("o_custkey").cast("string").alias("userid"))


UPLOADS_SQL = "(select o_orderkey::varchar as upload_id, lower(substring(o_orderpriority, 3, 20)) || ' report ' || o_orderkey || '.csv' as filename, 's3://u/' || o_orderkey as uri, o_orderstatus as tag, o_orderdate as updated_at, o_custkey::varchar as userid from orders)"

TRIGRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def similarity_sql(a: str, b: str) -> str:
    ta, tb = TRIGRAMS.format(x=a), TRIGRAMS.format(x=b)
    return f"(len(list_intersect({ta}, {tb}))::double / nullif(len(list_distinct(list_concat({ta}, {tb}))), 0))"
