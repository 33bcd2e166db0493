"""Vector, fuzzy, hybrid and upload search over entity frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import contains_ci, overlap, trigrams, trigrams_of
from weftline.functions.vector import cosine_distance, l2, literal_vector

Vector = Sequence[float] | Column


def _vec(q: Vector) -> Column:
    return q if isinstance(q, Column) else literal_vector(q)


def visible_to(user: str | int | None, column: str = "userid", mode: str = "public_or_own") -> Column:
    """Owner filter. public_or_own: rows without an owner and the user's; own: the user's only; without a user public rows."""
    c = F.col(column)
    if user is None:
        return c.isNull()
    return c == F.lit(user) if mode == "own" else c.isNull() | (c == F.lit(user))


def vector_search(embeddings: DataFrame, query: Vector, source: str, vector: str, threshold: float | None = 0.75, limit: int | None = 3) -> DataFrame:
    """(id, vdistance): nearest records by L2, the least distance of each source record, within ``threshold``.

    One pass, partial minimum before the shuffle, top-k without a full sort. Null vectors and such of another length
    match nothing; ties go to the smaller id.
    """
    d = embeddings.select(F.col(source).alias("id"), l2(F.col(vector), _vec(query)).alias("vdistance")).where("vdistance is not null")
    if threshold is not None:
        d = d.where(F.col("vdistance") <= threshold)
    d = d.groupBy("id").agg(F.min("vdistance").alias("vdistance"))
    return d if limit is None else d.orderBy("vdistance", "id").limit(limit)


def entity_vector_search(entity: DataFrame, embeddings: DataFrame, query: Vector, source: str, vector: str, key: str = "id", threshold: float | None = 0.75, limit: int = 3, where: Column | None = None, post_filter: bool = False) -> DataFrame:
    """Rows of the entity nearest to the query, with ``vdistance``.

    A filter ``where`` is applied before the limit (so that ``limit`` rows come back), with ``post_filter`` after it.
    """
    if where is not None and not post_filter:
        keys = entity.where(where).select(F.col(key).alias("_k"))
        embeddings = embeddings.join(keys, F.col(source) == F.col("_k"), "left_semi")
    hits = vector_search(embeddings, query, source, vector, threshold, limit).withColumnRenamed("id", "_hit")
    out = entity.join(hits, F.col(key) == F.col("_hit")).drop("_hit")
    return out.where(where) if where is not None and post_filter else out


def group_similarity(embeddings: DataFrame, query: Vector, vector: str, group: Sequence[str]) -> DataFrame:
    """``group`` columns, semantic_score (1 - least cosine distance) and the number of chunks."""
    d = embeddings.withColumn("_d", cosine_distance(F.col(vector), _vec(query)))
    return d.groupBy(*group).agg((1 - F.min("_d")).alias("semantic_score"), F.count("*").alias("chunk_count"))


def fuzzy_match(df: DataFrame, key: str, term: str, threshold: float = 0.4) -> DataFrame:
    """Rows whose key is more similar to ``term`` than ``threshold`` by trigrams, with ``score``."""
    once = F.transform(F.array(overlap(trigrams(F.col(key)), trigrams_of(term))), lambda s: F.when(s > threshold, s))[0]
    return df.withColumn("score", F.explode(F.filter(F.array(once), lambda s: s.isNotNull())))  # a filter would work it out again


def fuzzy_entities(df: DataFrame, key: str, terms: Sequence[str], threshold: float = 0.5, max_per_term: int = 5) -> DataFrame:
    """(term, key, score, rank): the best distinct keys of each term.

    Candidates come from an equi-join on shared trigrams, not from a product of terms and keys: a pair above any
    threshold shares a trigram. The list of terms is an argument, so its side is bounded and broadcast.
    """
    spark = df.sparkSession
    t = spark.createDataFrame([(x,) for x in dict.fromkeys(terms) if x], "term string").withColumn("tg", trigrams(F.col("term")))
    tg = t.select("term", F.col("tg"), F.explode("tg").alias("g"))
    keys = df.select(F.col(key).alias("key")).where("key is not null").distinct().withColumn("kg", trigrams(F.col("key")))
    shared = keys.select("key", F.size("kg").alias("nk"), F.explode("kg").alias("g")).join(F.broadcast(tg.withColumn("nt", F.size("tg")).drop("tg")), "g")
    score = shared.groupBy("term", "key").agg(F.count("*").alias("n"), F.first("nk").alias("nk"), F.first("nt").alias("nt"))
    score = score.withColumn("score", F.col("n") / (F.col("nk") + F.col("nt") - F.col("n"))).where(F.col("score") > threshold)
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "key"))
    return score.withColumn("rank", rank.cast("long")).where(F.col("rank") <= max_per_term).select("term", "key", "score", "rank")


def merge_search_results(sql: DataFrame | None, vector: DataFrame | None, graph: DataFrame | None, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), max_results: int = 10) -> DataFrame:
    """(id, score, source, rank): three ranked lists in one.

    Inputs have (id, pos) with pos from 1, the vector list ``vdistance`` too and the graph list ``path_length``. Only
    the first ``max_results`` of each list count; missing distances count 0.5.
    """
    legs = []
    if sql is not None:
        legs.append(sql.where(F.col("pos") <= max_results).select("id", F.lit(float(weights[0])).alias("s"), F.lit("sql").alias("source")))
    if vector is not None:
        legs.append(vector.where(F.col("pos") <= max_results).select("id", (weights[1] * (1 - F.coalesce("vdistance", F.lit(0.5)))).alias("s"), F.lit("vector").alias("source")))
    if graph is not None:
        legs.append(graph.where(F.col("pos") <= max_results).select("id", (weights[2] * (1 - F.col("path_length") / 10)).alias("s"), F.lit("graph").alias("source")))
    if not legs:
        raise ValueError("nothing to merge")
    rows = legs[0]
    for leg in legs[1:]:
        rows = rows.unionByName(leg)
    by = rows.groupBy("id").agg(F.round(F.sum("s"), 9).alias("score"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("source"))
    top = by.orderBy(F.desc("score"), "id").limit(max_results)
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))).cast("long"))  # at most max_results rows


def hybrid_score(confidence: Column, n_sql: Column, best_distance: Column, n_vector: Column, n_graph: Column, use_sql: bool = True) -> Column:
    """Score of a three-leg search, at most 1."""
    w_sql, w_vec, w_graph = (0.4, 0.4, 0.2) if use_sql else (0.0, 0.8, 0.2)
    s = F.when(n_sql > 0, confidence * w_sql + F.least(n_sql, F.lit(5)) * 0.02).otherwise(0.0) if use_sql else F.lit(0.0)
    v = F.when(n_vector > 0, (1 - best_distance) * w_vec + F.least(n_vector, F.lit(5)) * 0.02).otherwise(0.0)
    return F.least(s + v + F.when(n_graph > 0, w_graph).otherwise(0.0), F.lit(1.0))


def deep_search(hits: DataFrame, paths: DataFrame, name: str, origin: str = "origin", trail: str = "trail") -> DataFrame:
    """Each hit with ``related_paths``: the trails that start at its name, sorted; an empty array where there are none."""
    mine = paths.join(hits.select(F.col(name).alias("_n")).distinct(), F.col(origin) == F.col("_n"), "left_semi")
    grouped = mine.groupBy(F.col(origin).alias("_o")).agg(F.array_sort(F.collect_list(F.array_join(trail, ">"))).alias("related_paths"))
    return hits.join(grouped, F.col(name) == F.col("_o"), "left").withColumn("related_paths", F.coalesce("related_paths", F.array().cast("array<string>"))).drop("_o")


def parallel_search(entities: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """(entity_type, id, score, rank): searches of several entities ranked together. Inputs have (id, score)."""
    parts = [df.select(F.lit(n).alias("entity_type"), F.col("id").cast("string").alias("id"), "score") for n, df in entities.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    top = rows.orderBy(F.desc("score"), "entity_type", "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "entity_type", "id")).cast("long"))


def resource_metrics(resources: DataFrame, user: str | None = None, limit: int = 20) -> DataFrame:
    """Chunk counts and sizes of each (uri, userid): latest and largest first."""
    rows = resources if user is None else resources.where(F.col("userid") == user)
    agg = rows.groupBy("uri", "userid").agg(
        F.count("*").alias("chunk_count"),
        F.sum(F.length("content")).alias("total_chunk_size"),
        F.avg(F.length("content")).alias("avg_chunk_size"),
        F.max("ts").alias("max_date"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )
    return agg.orderBy(F.desc_nulls_last("max_date"), F.desc("chunk_count"), "uri", F.asc_nulls_last("userid")).limit(limit)


def filename_match(df: DataFrame, name: str, query: str, least: float = 0.3) -> DataFrame:
    """Rows whose name contains the query or is similar to it by more than ``least``, with ``filename_score``: 0.7 + 0.3 x similarity, or 0 where it is not."""
    c = F.col(name)
    similar = overlap(trigrams(c), trigrams_of(query))
    once = F.transform(F.array(similar), lambda s: F.when(s > least, 0.7 + 0.3 * s).when(contains_ci(c, query), F.lit(0.0)))[0]
    return df.withColumn("filename_score", F.explode(F.filter(F.array(once), lambda s: s.isNotNull())))  # a filter would work it out again


def resource_search(semantic: DataFrame, names: DataFrame, null_safe: bool = False) -> DataFrame:
    """(uri, userid, score): the better of the semantic and the file name score of each (uri, userid), from either side.

    By default null owners match no one, as in an SQL join; ``null_safe`` lets them match each other.
    """
    eq = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    s = semantic.groupBy("uri", "userid").agg(F.max("semantic_score").alias("semantic_score"))
    n = names.groupBy(F.col("uri").alias("_uri"), F.col("userid").alias("_userid")).agg(F.max("filename_score").alias("filename_score"))
    both = s.join(n, eq(F.col("uri"), F.col("_uri")) & eq(F.col("userid"), F.col("_userid")), "full")
    zero = F.lit(0.0)
    return both.select(F.coalesce("uri", "_uri").alias("uri"), F.coalesce("userid", "_userid").alias("userid"), F.greatest(F.coalesce("semantic_score", zero), F.coalesce("filename_score", zero)).alias("score"))


def file_upload_search(uploads: DataFrame, semantic: DataFrame, chunks: DataFrame, query: str | None, tags: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
    """Uploads found by the content of their chunks or by their file name, the best way of each; without a query all of them.

    uploads (upload_id, filename, uri, tags, updated_at), semantic (uri, semantic_score), chunks (uri, size).
    """
    if tags:
        uploads = uploads.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    totals = chunks.groupBy(F.col("uri").alias("_c")).agg(F.count("*").alias("chunk_count"), F.sum("size").alias("resource_size"))
    if query is None:
        out = uploads.withColumn("score", F.lit(0.0)).withColumn("match_type", F.lit("all"))
    else:
        by_content = uploads.join(semantic.where("semantic_score > 0").select(F.col("uri").alias("_s"), F.col("semantic_score").alias("score")), F.col("uri") == F.col("_s")).drop("_s").withColumn("match_type", F.lit("semantic"))
        by_name = filename_match(uploads, "filename", query).withColumnRenamed("filename_score", "score").withColumn("match_type", F.lit("filename"))
        both = by_content.unionByName(by_name)
        best = F.row_number().over(Window.partitionBy("upload_id").orderBy(F.desc("score"), "match_type"))
        out = both.withColumn("_b", best).where("_b = 1").drop("_b")
    out = out.join(totals, F.col("uri") == F.col("_c"), "left").drop("_c")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("upload_id", "filename", "uri", "score", "match_type", zero("chunk_count"), zero("resource_size"), "updated_at").orderBy(F.desc("score"), F.desc("updated_at"), "upload_id").limit(limit)


def parsed_confidence(c: Column) -> Column:
    """A confidence given as text if it is a number, else 0.5."""
    return F.when(c.rlike(r"^\s*[0-9]*\.?[0-9]+\s*$"), F.trim(c).try_cast("double")).otherwise(F.lit(0.5))


def pending_embeddings(entity: DataFrame, embeddings: DataFrame, key: str, column: str, model: str, max_length: int = 10_000, per_model: bool = True) -> DataFrame:
    """Rows whose column has no embedding yet: (source_id, column_name, embedding_name, description, bid).

    ``bid`` is the id that the embedding will have. Requests need no running number, since embeddings are made beside their rows.
    Empty and null texts need none; of longer texts the first ``max_length`` characters are embedded. With ``per_model`` an embedding of another
    model does not count; without it any does.
    """
    done = embeddings.where(F.col("column_name") == column)
    if per_model:
        done = done.where(F.col("embedding_name") == model)
    todo = entity.where(F.col(column).isNotNull() & (F.col(column) != "")).join(done.select(F.col("source_record_id").alias("_s")), F.col(key) == F.col("_s"), "left_anti")
    from weftline.functions.ids import jsonb_uuid

    text = lambda c: (c, "string")
    bid = jsonb_uuid({"column_name": text(F.lit(column)), "embedding_id": text(F.lit(model)), "source_record_id": text(F.col(key).cast("string"))})
    return todo.select(F.col(key).alias("source_id"), F.lit(column).alias("column_name"), F.lit(model).alias("embedding_name"), F.substring(F.col(column), 1, max_length).alias("description"), bid.alias("bid"))


# ---------------------------------------------------------------- searches with three legs

def three_legs(entity: DataFrame, embeddings: DataFrame, query: Vector, source: str, vector: str, where: Column | None = None, order: Sequence[str] = (), user: str | None = None, key: str = "id", content: str = "content", paths: str | None = "graph_paths", threshold: float | None = 0.75, limit: int = 5) -> DataFrame:
    """(leg, id, pos, vdistance, path_length, content): the first ``limit`` rows of each leg of a search over an entity.

    sql: rows for which ``where`` holds, in ``order`` (columns, ``-`` before those that descend), then by key. vector: rows nearest to ``query``. graph: other rows that share a
    concept of their graph paths with a hit of the vector leg, those that share most first. With a ``user`` only the user's rows count.
    Each leg is a top-k: filters and the least distance come before the shuffle, and what is joined to the entity is ``limit`` rows.
    """
    rows = entity if user is None else entity.where(F.col("userid") == user)
    narrow = rows.select(F.col(key).cast("string").alias("id"), F.col(content).alias("content"), *([paths] if paths else []))
    none = F.lit(None)

    def placed(df: DataFrame, leg: str, by: Sequence[Column], vdistance: Column, path_length: Column) -> DataFrame:
        pos = F.row_number().over(Window.orderBy(*by)).cast("long")  # at most limit rows
        return df.select(F.lit(leg).alias("leg"), "id", pos.alias("pos"), vdistance.cast("double").alias("vdistance"), path_length.cast("long").alias("path_length"), "content")

    if user is not None:
        embeddings = embeddings.join(rows.select(F.col(key).alias("_k")), F.col(source) == F.col("_k"), "left_semi")
    near = vector_search(embeddings, query, source, vector, threshold, limit).select(F.col("id").cast("string").alias("_hit"), "vdistance")
    hits = narrow.join(F.broadcast(near), F.col("id") == F.col("_hit")).drop("_hit")  # at most limit rows
    legs = placed(hits, "vector", [F.col("vdistance"), F.col("id")], F.col("vdistance"), none)
    if where is not None:
        keys = [c.removeprefix("-") for c in order]
        found = rows.where(where).select(F.col(key).cast("string").alias("id"), F.col(content).alias("content"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(keys)])
        by = [*(F.desc_nulls_last(f"_o{i}") if c[0] == "-" else F.asc_nulls_last(f"_o{i}") for i, c in enumerate(order)), F.asc("id")]
        legs = legs.unionByName(placed(found.orderBy(*by).limit(limit), "sql", by, none, none))
    if paths:
        concept = lambda df: df.select("id", F.explode(paths).alias("_p")).select("id", F.explode(F.split("_p", "/")).alias("concept")).where("concept != ''").distinct()
        mine = concept(hits).select(F.col("id").alias("_h"), F.col("concept").alias("_c"))
        shared = concept(narrow).join(F.broadcast(mine), F.col("concept") == F.col("_c"))  # concepts of at most limit rows
        other = shared.join(F.broadcast(near.select("_hit")), F.col("id") == F.col("_hit"), "left_anti").groupBy("id").agg(F.countDistinct("concept").alias("_n"))
        by = [F.desc("_n"), F.asc("id")]
        best = other.orderBy(*by).limit(limit)
        linked = narrow.select(F.col("id").alias("_i"), "content").join(F.broadcast(best), F.col("_i") == F.col("id"))
        legs = legs.unionByName(placed(linked, "graph", by, none, F.lit(1)))
    return legs


def entity_search(legs: DataFrame, query_text: str | None = None, confidence: float = 0.0, min_confidence: float = 0.7, use_sql: bool = True) -> DataFrame:
    """One row of a search from :func:`three_legs`: (query_text, confidence, relational_result, vector_result, graph_result, hybrid_score, error_message).

    Results are JSON arrays in order, ``[]`` where a leg is empty. The relational leg counts only if it is used and sure
    enough; what keeps it out is the error message. Legs run as one plan, so there are no times of theirs.
    """
    sql_on = use_sql and confidence >= min_confidence
    error = None if sql_on else "SQL is not used" if not use_sql else f"confidence {confidence} is below {min_confidence}"
    mine = lambda leg, *names: F.to_json(F.array_sort(F.filter(F.collect_list(F.when(F.col("leg") == leg, F.struct("pos", "id", *names))), lambda x: x.isNotNull())))
    n = lambda leg: F.count(F.when(F.col("leg") == leg, 1))
    rows = legs if sql_on else legs.where("leg != 'sql'")
    one = rows.agg(mine("sql", "content").alias("relational_result"), mine("vector", "vdistance", "content").alias("vector_result"), mine("graph", "path_length", "content").alias("graph_result"), n("sql").alias("_s"), n("vector").alias("_v"), n("graph").alias("_g"), F.min("vdistance").alias("_d"))
    score = hybrid_score(F.lit(float(confidence)), F.col("_s"), F.coalesce("_d", F.lit(0.0)), F.col("_v"), F.col("_g"), use_sql)
    return one.select(F.lit(query_text).cast("string").alias("query_text"), F.lit(float(confidence)).alias("confidence"), "relational_result", "vector_result", "graph_result", score.alias("hybrid_score"), F.lit(error).cast("string").alias("error_message"))


def merged_legs(legs: DataFrame, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), max_results: int = 10) -> DataFrame:
    """(id, score, content, source, rank) of the legs of :func:`three_legs`, merged as in :func:`merge_search_results`."""
    leg = lambda name: legs.where(F.col("leg") == name)
    top = merge_search_results(leg("sql"), leg("vector"), leg("graph"), weights, max_results)
    contents = legs.groupBy(F.col("id").alias("_i")).agg(F.max("content").alias("content"))  # rows of the legs only
    return top.join(contents, F.col("id") == F.col("_i")).select("id", "score", "content", "source", "rank")


def search_entities(legs: dict[str, DataFrame], max_results: int = 10, include_graph: bool = True, stats: bool = False) -> DataFrame:
    """(entity_type, id, score, content, rank, with ``stats`` also stats): searches of several entities, ranked together.

    ``legs`` by entity type as of :func:`three_legs`. ``stats``: JSON of how many rows each leg of the entity gave.
    """
    parts = []
    for name, rows in legs.items():
        rows = rows if include_graph else rows.where("leg != 'graph'")
        part = merged_legs(rows, max_results=max_results).select(F.lit(name).alias("entity_type"), "id", "score", "content")
        if stats:
            count = lambda leg: F.count(F.when(F.col("leg") == leg, 1)).alias(leg)
            part = part.crossJoin(rows.agg(F.to_json(F.struct(*[count(x).alias(x) for x in ("sql", "vector", "graph")])).alias("stats")))  # one row
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by = [F.desc("score"), F.asc("entity_type"), F.asc("id")]
    top = out.orderBy(*by).limit(max_results)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("long")).select("entity_type", "id", "score", "content", "rank", *(["stats"] if stats else []))


def resource_report(resources: DataFrame, scores: DataFrame | None = None, user: str | None = None, limit: int = 20) -> DataFrame:
    """Nine columns of each (uri, userid): (uri, resource_name, chunk_count, total_chunk_size, avg_chunk_size, max_date, categories, semantic_score, user_id).

    ``scores`` (uri, userid, score) as of :func:`resource_search` answer a question: best first, then latest. Without them: latest and largest first.
    """
    rows = resources if user is None else resources.where(F.col("userid") == user)
    agg = rows.groupBy("uri", "userid").agg(
        F.max("name").alias("resource_name"),
        F.count("*").alias("chunk_count"),
        F.sum(F.length("content")).alias("total_chunk_size"),
        F.avg(F.length("content")).alias("avg_chunk_size"),
        F.max("resource_timestamp").alias("max_date"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )
    order = [F.desc_nulls_last("max_date"), F.desc("chunk_count")]
    if scores is None:
        agg = agg.withColumn("semantic_score", F.lit(None).cast("double"))
    else:
        best = scores.groupBy(F.col("uri").alias("_u"), F.col("userid").alias("_o")).agg(F.max("score").alias("semantic_score"))
        agg = agg.join(best, (F.col("uri") == F.col("_u")) & (F.col("userid") == F.col("_o")))
        order = [F.desc("semantic_score"), F.desc_nulls_last("max_date")]
    columns = ["uri", "resource_name", "chunk_count", "total_chunk_size", "avg_chunk_size", "max_date", "categories", "semantic_score", F.col("userid").alias("user_id")]
    return agg.orderBy(*order, "uri", F.asc_nulls_last("userid")).limit(limit).select(*columns)


def upload_report(uploads: DataFrame, resources: DataFrame, semantic: DataFrame | None, query: str | None, user: str | None = None, tags: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
    """Seventeen columns of each upload found by the content of its chunks or by its file name; without a query of all.

    uploads (id, filename, content_type, total_size, uploaded_size, status, created_at, updated_at, s3_uri, tags, resource_id, userid),
    resources (id, uri, name, content, created_at), semantic (uri, semantic_score). Of both ways the better one counts.
    """
    up = uploads if user is None else uploads.where(F.col("userid") == user)
    if tags:
        up = up.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if query is None:
        found = up.withColumn("semantic_score", F.lit(None).cast("double"))
    else:
        by_name = filename_match(up, "filename", query).withColumnRenamed("filename_score", "semantic_score")
        found = by_name
        if semantic is not None:
            good = semantic.where("semantic_score > 0").groupBy(F.col("uri").alias("_s")).agg(F.max("semantic_score").alias("semantic_score"))
            found = up.join(good, F.col("s3_uri") == F.col("_s")).drop("_s").unionByName(by_name)
        found = found.groupBy("id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "id"]), "semantic_score").alias("_b")).select("id", "_b.*")
    order = [F.desc_nulls_last("semantic_score"), F.desc_nulls_last("updated_at"), F.asc("id")]
    top = found.orderBy(*order).limit(limit)
    # only the chunks of what is shown are summed up; the list is at most limit rows
    wanted = resources.join(F.broadcast(top.select(F.col("s3_uri").alias("_w")).distinct()), F.col("uri") == F.col("_w"), "left_semi")
    totals = wanted.groupBy("uri").agg(F.max("name").alias("resource_name"), F.countDistinct("id").alias("_n"), F.sum(F.length("content")).alias("_size"), F.max("created_at").alias("indexed_at")).withColumnRenamed("uri", "resource_uri")
    out = top.join(totals, F.col("s3_uri") == F.col("resource_uri"), "left")
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(name)
    return out.orderBy(*order).select(F.col("id").alias("upload_id"), "filename", "content_type", "total_size", "uploaded_size", "status", F.col("created_at"), "updated_at", "s3_uri", "tags", "resource_id", "resource_uri", "resource_name", zero("_n", "chunk_count"), zero("_size", "resource_size"), "indexed_at", "semantic_score")
