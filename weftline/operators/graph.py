"""A property graph as two frames and its operators as joins.

nodes: id BIGINT, label STRING, key STRING, user_id STRING, props MAP<STRING,STRING>
edges: id BIGINT, src BIGINT, dst BIGINT, rel_type STRING, created_at, terminated_at TIMESTAMP, props MAP<STRING,STRING>

Edge ids are hashes of (src, type, dst, ...), so that building is idempotent. Paths never use an edge twice; depths are
small and sources are filtered first, since the number of paths grows exponentially with the depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY_PROPS = "cast(map() as map<string,string>)"


def node_id(label: Column, key: Column, user: Column | None = None) -> Column:
    """Id of the node with this (label, key, user)."""
    return F.xxhash64(label, key, F.coalesce(user, F.lit("")) if user is not None else F.lit(""))


def edge_id(src: Column, rel_type: Column, dst: Column, *more: Column) -> Column:
    return F.xxhash64(src, rel_type, dst, *more)


def nodes_from(df: DataFrame, label: str, key: str, user: str | None = None, props: Sequence[str] = ()) -> DataFrame:
    """One node for each distinct non-null key."""
    u = F.col(user).cast("string") if user else F.lit(None).cast("string")
    p = F.map_from_arrays(F.array(*[F.lit(c) for c in props]), F.array(*[F.col(c).cast("string") for c in props])) if props else F.expr(EMPTY_PROPS)
    rows = df.where(F.col(key).isNotNull()).select(F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), u.alias("user_id"), p.alias("props"))
    return rows.select(node_id(F.col("label"), F.col("key"), F.col("user_id")).alias("id"), "label", "key", "user_id", "props").dropDuplicates(["id"])


def merge_relationships(edges: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Edges after idempotent requests (source_label, source_name, rel_type, target_name, activate, source_user_id, target_label, target_user_id, rel_props).

    Requests without a label, name, type or target are skipped. An edge keeps its first created_at; terminated_at is
    cleared if activated and set to ``now`` if not; new properties are laid over old ones.
    """
    r = requests.where("source_label is not null and source_name is not null and rel_type is not null and target_name is not null")
    src = node_id(F.col("source_label"), F.col("source_name"), F.col("source_user_id"))
    dst = node_id(F.coalesce("target_label", F.lit("Concept")), F.col("target_name"), F.col("target_user_id"))
    new = r.select(src.alias("src"), dst.alias("dst"), "rel_type", F.coalesce("activate", F.lit(True)).alias("activate"), F.coalesce("rel_props", F.expr(EMPTY_PROPS)).alias("np"))
    new = new.withColumn("id", edge_id(F.col("src"), F.col("rel_type"), F.col("dst")))
    new = new.groupBy("id", "src", "dst", "rel_type").agg(F.max_by("activate", F.col("activate").cast("int")).alias("activate"), F.max_by("np", F.size("np")).alias("np"))
    o = edges.select(*[F.col(c).alias(f"o_{c}") for c in ("id", "src", "dst", "rel_type", "created_at", "terminated_at", "props")])
    j = o.join(new, F.col("o_id") == F.col("id"), "full")
    touched = F.col("id").isNotNull()
    old_props = F.coalesce("o_props", F.expr(EMPTY_PROPS))
    kept = F.map_filter(old_props, lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("np", F.expr(EMPTY_PROPS))), k))
    return j.select(
        F.coalesce("id", "o_id").alias("id"),
        F.coalesce("src", "o_src").alias("src"),
        F.coalesce("dst", "o_dst").alias("dst"),
        F.coalesce("rel_type", "o_rel_type").alias("rel_type"),
        F.coalesce("o_created_at", now).alias("created_at"),
        F.when(~touched, F.col("o_terminated_at")).when(~F.col("activate"), now).alias("terminated_at"),
        F.when(touched, F.map_concat(kept, F.coalesce("np", F.expr(EMPTY_PROPS)))).otherwise(old_props).alias("props"),
    )


def relationships(nodes: DataFrame, edges: DataFrame, source_label: str | None = None, source_name: str | None = None, rel_type: str | None = None, target_label: str | None = None, target_name: str | None = None, source_user: str | None = None, target_user: str | None = None, include_inactive: bool = False) -> DataFrame:
    """Edges with both ends. Names and users of an end are compared only where its label is given; without a user the end is public."""

    def end(label: str | None, name: str | None, user: str | None, prefix: str) -> DataFrame:
        n = nodes
        if label is not None:
            n = n.where(F.col("label") == label)
            if name is not None:
                n = n.where(F.col("key") == name)
            n = n.where(F.col("user_id").isNull() if user is None else F.col("user_id") == user)
        return n.select(F.col("id").alias(f"{prefix}_id"), F.col("label").alias(f"{prefix}_label"), F.col("key").alias(f"{prefix}_name"), F.col("user_id").alias(f"{prefix}_user_id"))

    e = edges if include_inactive else edges.where("terminated_at is null")
    if rel_type is not None:
        e = e.where(F.col("rel_type") == rel_type)
    e = e.select(F.col("id").alias("edge_id"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "rel_type", "created_at", "terminated_at")
    return e.join(end(source_label, source_name, source_user, "source"), "source_id").join(end(target_label, target_name, target_user, "target"), "target_id")


def steps(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(eid, a, b): the edges as steps, both ways unless directed."""
    one = edges.select(F.col("id").alias("eid"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return one if directed else one.unionByName(one.select("eid", F.col("b").alias("a"), F.col("a").alias("b")))


def expand(edges: DataFrame, sources: DataFrame, max_length: int = 3, directed: bool = False, source: str = "id") -> DataFrame:
    """(origin, node, path_length, used, trail): every path of 1..max_length steps from the sources; no edge twice in a path."""
    st = steps(edges, directed)
    front = sources.select(F.col(source).alias("origin")).distinct()
    front = front.select("origin", F.col("origin").alias("node"), F.lit(0).cast("long").alias("path_length"), F.array().cast("array<bigint>").alias("used"), F.array("origin").alias("trail"))
    out = None
    for _ in range(max_length):
        front = front.join(st, F.col("node") == F.col("a")).where(~F.array_contains("used", F.col("eid")))
        front = front.select("origin", F.col("b").alias("node"), (F.col("path_length") + 1).alias("path_length"), F.concat("used", F.array("eid")).alias("used"), F.concat("trail", F.array("b")).alias("trail"))
        out = front if out is None else out.unionByName(front)
    return out


def _names(paths: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    n = nodes.select(F.col("id").alias("_n"), F.col("label").alias("node_label"), F.col("key").alias("node_key"))
    return paths.join(n, F.col(column) == F.col("_n")).drop("_n")


def paths_between(nodes: DataFrame, edges: DataFrame, names: Sequence[str], label: str, max_length: int = 3, max_paths: int | None = 10, rel_type: str = "ref") -> DataFrame:
    """(path_length, origin, target, target_id): undirected paths between nodes of a label, from the named ones; ordered, so that a limit is stable."""
    mine = nodes.where((F.col("label") == label) & F.col("key").isin(*names))
    p = _names(expand(edges.where(F.col("rel_type") == rel_type), mine, max_length), nodes).where(F.col("node_label") == label)
    o = nodes.select(F.col("id").alias("_o"), F.col("key").alias("origin_key"))
    p = p.join(o, F.col("origin") == F.col("_o")).select("path_length", F.col("origin_key").alias("origin"), F.col("node_key").alias("target"), F.col("node").alias("target_id"), "trail")
    p = p.orderBy("path_length", "origin", "target", "trail")
    return p if max_paths is None else p.limit(max_paths)


def connected_nodes(nodes: DataFrame, edges: DataFrame, label: str, name: str, target_label: str | None = None, max_length: int = 3, rel_type: str | None = None) -> DataFrame:
    """(node_id, label, name, path_length): one row for each path from the named node."""
    e = edges if rel_type is None else edges.where(F.col("rel_type") == rel_type)
    p = _names(expand(e, nodes.where((F.col("label") == label) & (F.col("key") == name)), max_length), nodes)
    if target_label is not None:
        p = p.where(F.col("node_label") == target_label)
    return p.select(F.col("node").alias("node_id"), F.col("node_label").alias("label"), F.col("node_key").alias("name"), "path_length")


def connected_entities(nodes: DataFrame, edges: DataFrame, label: str, name: str, hub_label: str, target_label: str) -> DataFrame:
    """(hub, target): targets two steps away over a hub, and targets one or two steps away in any way with a null hub; distinct."""
    src = nodes.where((F.col("label") == label) & (F.col("key") == name))
    two = expand(edges, src, 2)
    hub = nodes.where(F.col("label") == hub_label).select(F.col("id").alias("_h"), F.col("key").alias("hub"))
    target = nodes.where(F.col("label") == target_label).select(F.col("id").alias("_t"), F.col("key").alias("target"))
    over = two.where("path_length = 2").withColumn("_mid", F.col("trail")[1]).join(hub, F.col("_mid") == F.col("_h")).join(target, F.col("node") == F.col("_t")).select("hub", "target")
    any_ = two.join(target, F.col("node") == F.col("_t")).select(F.lit(None).cast("string").alias("hub"), "target")
    return over.unionByName(any_).distinct()


def concept_links(nodes: DataFrame, edges: DataFrame, user: str, rel_type: str | None = None, select_hub: bool | None = None, depth: int = 2, user_label: str = "User", concept_label: str = "Concept") -> DataFrame:
    """Directed paths from a user to concepts; the type holds on every step; hubs: None all, True only hubs, False none."""
    e = edges if rel_type is None else edges.where(F.col("rel_type") == rel_type)
    p = expand(e, nodes.where((F.col("label") == user_label) & (F.col("key") == user)), depth, directed=True)
    c = nodes.where(F.col("label") == concept_label).select(F.col("id").alias("_c"), F.col("key").alias("concept"), F.coalesce(F.col("props")["is_hub"] == "true", F.lit(False)).alias("is_hub"))
    p = p.join(c, F.col("node") == F.col("_c"))
    if select_hub is not None:
        p = p.where(F.col("is_hub") == select_hub)
    return p.select("concept", "is_hub", "path_length", "trail", "used")


def compact_hubs(nodes: DataFrame, edges: DataFrame, threshold: int = 7, user_label: str = "User", concept_label: str = "Concept") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, groups): each (user, type) with more than ``threshold`` edges to concepts goes over a hub.

    The hub ``has_<type>`` of the user takes the edges with their properties; the direct ones are removed. Edges to
    hubs are not counted, so compacting twice changes nothing.
    """
    u = nodes.where(F.col("label") == user_label).select(F.col("id").alias("_u"), F.col("key").alias("user_key"))
    c = nodes.where((F.col("label") == concept_label) & ~F.coalesce(F.col("props")["is_hub"] == "true", F.lit(False))).select(F.col("id").alias("_c"))
    direct = edges.join(u, F.col("src") == F.col("_u")).join(c, F.col("dst") == F.col("_c"))
    groups = direct.groupBy("src", "user_key", "rel_type").agg(F.count("*").alias("n")).where(F.col("n") > threshold)
    hub_key = F.concat(F.lit("has_"), F.col("rel_type"))
    g = groups.select(F.col("src").alias("_s"), F.col("rel_type").alias("_t"), node_id(F.lit(concept_label), hub_key, F.col("user_key")).alias("hub"), hub_key.alias("hub_key"), F.col("user_key").alias("hub_user"))
    moved = direct.join(g, (F.col("src") == F.col("_s")) & (F.col("rel_type") == F.col("_t")))
    no = F.lit(None).cast("timestamp")
    to_hub = g.select(edge_id(F.col("_s"), F.col("_t"), F.col("hub")).alias("id"), F.col("_s").alias("src"), F.col("hub").alias("dst"), F.col("_t").alias("rel_type"), no.alias("created_at"), no.alias("terminated_at"), F.expr(EMPTY_PROPS).alias("props"))
    from_hub = moved.select(edge_id(F.col("hub"), F.col("rel_type"), F.col("dst"), F.col("id")).alias("id"), F.col("hub").alias("src"), "dst", "rel_type", "created_at", "terminated_at", "props")
    left = edges.join(moved.select(F.col("id").alias("_m")), F.col("id") == F.col("_m"), "left_anti")
    cols = ["id", "src", "dst", "rel_type", "created_at", "terminated_at", "props"]
    hubs = g.select(F.col("hub").alias("id"), F.lit(concept_label).alias("label"), F.col("hub_key").alias("key"), F.col("hub_user").alias("user_id"), F.create_map(F.lit("is_hub"), F.lit("true")).alias("props"))
    hubs = hubs.join(nodes.select(F.col("id").alias("_n")), F.col("id") == F.col("_n"), "left_anti")
    return nodes.unionByName(hubs.select(*nodes.columns)), left.select(*cols).unionByName(to_hub).unionByName(from_hub), groups


def path_status(paths: DataFrame, path: str = "path") -> DataFrame:
    """``path`` with its parts, status (success, failure) and error_message; a path has exactly three parts."""
    parts = F.split(F.col(path), "/")
    ok = F.size(parts) == 3
    return paths.select(F.col(path).alias("path"), parts.alias("parts"), F.when(ok, "success").otherwise("failure").alias("status"), F.when(~F.coalesce(ok, F.lit(False)), "Invalid path format").alias("error_message"))


def graph_from_paths(paths: DataFrame, path: str = "path", source_label: str = "Chapter", relation: str = "ref", category: str = "Category") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, status) of A/B/C paths: A is a source, B and C are categories, A to B to C. Quotes around A are dropped."""
    st = path_status(paths, path)
    good = st.where("status = 'success'").select(F.regexp_replace(F.col("parts")[0], "[\"']", "").alias("a"), F.col("parts")[1].alias("b"), F.col("parts")[2].alias("c"))
    labels = F.array(F.struct(F.lit(source_label).alias("label"), F.col("a").alias("key")), F.struct(F.lit(category).alias("label"), F.col("b").alias("key")), F.struct(F.lit(category).alias("label"), F.col("c").alias("key")))
    n = good.select(F.explode(labels).alias("n")).select("n.*").distinct()
    n = n.select(node_id(F.col("label"), F.col("key")).alias("id"), "label", "key", F.lit(None).cast("string").alias("user_id"), F.expr(EMPTY_PROPS).alias("props"))
    a, b, c = node_id(F.lit(source_label), F.col("a")), node_id(F.lit(category), F.col("b")), node_id(F.lit(category), F.col("c"))
    e = good.select(F.explode(F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), c.alias("dst")))).alias("e")).select("e.*").distinct()
    no = F.lit(None).cast("timestamp")
    e = e.select(edge_id(F.col("src"), F.lit(relation), F.col("dst")).alias("id"), "src", "dst", F.lit(relation).alias("rel_type"), no.alias("created_at"), no.alias("terminated_at"), F.expr(EMPTY_PROPS).alias("props"))
    return n, e, st.drop("parts")


def entity_paths(entity: DataFrame, name: str = "name", paths: str = "graph_paths") -> DataFrame:
    """name/path for each graph path of each row; null names and paths give none."""
    return entity.where(F.col(name).isNotNull()).select(F.explode(paths).alias("p"), F.col(name).alias("n")).where("p is not null").select(F.concat_ws("/", "n", "p").alias("path"))


def weighted_edges(node_data: DataFrame, edge_type: str = "semref", label: str = "Chapter") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (name, edges ARRAY<STRUCT<name, weight>>); the weight is part of an edge's identity: another weight is another edge."""
    e = node_data.where("name is not null").select("name", F.explode("edges").alias("e")).select("name", F.col("e.name").alias("target"), F.col("e.weight").cast("double").alias("weight")).where("target is not null").distinct()
    names = e.select("name").unionByName(e.select(F.col("target").alias("name"))).distinct()
    n = names.select(node_id(F.lit(label), F.col("name")).alias("id"), F.lit(label).alias("label"), F.col("name").alias("key"), F.lit(None).cast("string").alias("user_id"), F.expr(EMPTY_PROPS).alias("props"))
    src, dst = node_id(F.lit(label), F.col("name")), node_id(F.lit(label), F.col("target"))
    no = F.lit(None).cast("timestamp")
    out = e.select(edge_id(src, F.lit(edge_type), dst, F.col("weight")).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(edge_type).alias("rel_type"), no.alias("created_at"), no.alias("terminated_at"), F.create_map(F.lit("weight"), F.col("weight").cast("string")).alias("props"))
    return n, out


def path_names(path: Column) -> Column:
    """Names along an array of node structs with ``properties``, in order."""
    return F.transform(path, lambda n: n["properties"]["name"])


def pending_nodes(entity: DataFrame, nodes: DataFrame, key: str, label: str, limit: int | None = None) -> DataFrame:
    """Rows of the entity that are not in the graph yet."""
    out = entity.join(nodes.where(F.col("label") == label).select(F.col("key").alias("_k")), F.col(key).cast("string") == F.col("_k"), "left_anti")
    return out if limit is None else out.orderBy(key).limit(limit)


def watermark_view(entity: DataFrame, nodes: DataFrame, key: str, label: str) -> DataFrame:
    """The entity with ``gid``, the id of its node; null means not indexed yet."""
    n = nodes.where(F.col("label") == label).select(F.col("key").alias("_k"), F.col("id").alias("gid"))
    return entity.join(n, F.col(key).cast("string") == F.col("_k"), "left").drop("_k")


def nodes_by_key(nodes: DataFrame, keys: Sequence[str], user: str | None = None) -> DataFrame:
    """Nodes with one of the keys that the user may see: public ones and the user's own."""
    clean = [k for k in keys if k]
    seen = F.col("user_id").isNull() if user is None else F.col("user_id").isNull() | (F.col("user_id") == user)
    return nodes.where(F.col("key").isin(*clean) & seen) if clean else nodes.where("false")


def nodes_by_id(nodes: DataFrame, ids: Sequence[int]) -> DataFrame:
    return nodes.where(F.col("id").isin(*ids)) if ids else nodes.where("false")


def group_keys_by_label(nodes: DataFrame) -> DataFrame:
    """(entity_type, node_keys): keys of each label, sorted; ``__`` in a label is written as a dot, null and empty keys are left out."""
    n = nodes.where("key is not null and key != ''")
    return n.groupBy(F.regexp_replace("label", "__", ".").alias("entity_type")).agg(F.array_sort(F.collect_set("key")).alias("node_keys"))
