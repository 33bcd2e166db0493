"""Entity handles that carry a user's context, hybrid questions, indexing and lookups: the front door of the library."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import entities, graph, search, security
from weftline.operators.embedding import Embedder, embedding_records, hashing_embedder
from weftline.plans.schema import EntityType, Registry

#: question, entity -> (SQL or a filter over the entity's view, confidence)
Planner = Callable[[str, EntityType], tuple[str, float]]


def keyword_planner(question: str, entity: EntityType) -> tuple[str, float]:
    """Offline planner: rows whose text fields contain the longest word of the question."""
    words = sorted((w.strip("?.,!").lower() for w in question.split()), key=len)
    texts = [n for n, t in entity.fields.items() if t.upper() == "TEXT"]
    if not words or not texts:
        return "false", 0.0
    return " or ".join(f"instr(lower({c}), :word) > 0" for c in texts), 0.8


@dataclass
class Answer:
    """What a question over an entity gave: both legs as frames, and what went wrong with either."""

    query_text: str | None
    confidence: float
    relational: DataFrame | None
    vector: DataFrame | None
    errors: list[str] = field(default_factory=list)


class Engine:
    """Entities of a session. Models, planners and tools are injected; the defaults work offline."""

    def __init__(self, spark: SparkSession, embedder: Embedder | None = None, planner: Planner = keyword_planner):
        self.spark, self.registry = spark, Registry()
        self.embedder, self.planner = embedder or hashing_embedder(), planner
        self.frames: dict[str, DataFrame] = {}
        self.embeddings: dict[str, DataFrame] = {}
        self.nodes: DataFrame | None = None
        self.audit: list[tuple[str, str, str | None]] = []

    def register(self, entity: EntityType, rows: DataFrame | None = None, embeddings: DataFrame | None = None, plan: bool = False) -> list[str]:
        script = self.registry.register(entity, plan)
        if not plan:
            if rows is not None:
                self.frames[entity.name] = rows
            if embeddings is not None:
                self.embeddings[entity.name] = embeddings
        return script

    def entity(self, name: str, context: security.UserContext | None = None) -> "Repository":
        return Repository(self, name, context)

    def secure_all(self, context: security.UserContext) -> dict[str, DataFrame]:
        return {n: security.secured(df, context) for n, df in self.frames.items()}

    def get_entities(self, keys: Sequence[str], user: str | None = None, fuzzy: bool = False, threshold: float = 0.3) -> dict[str, DataFrame]:
        """Rows of every entity with one of the keys as business key; with ``fuzzy`` also keys similar to them. Types without a match are left out."""
        clean = [k for k in keys if k]
        out = {}
        for name, df in self.frames.items():
            key = self.registry.entities[name].key
            rows = df.where(search.visible_to(user)) if "userid" in df.columns else df
            wanted = rows.where(F.col(key).isin(*clean)) if clean else rows.where("false")
            if fuzzy and clean:
                near = search.fuzzy_entities(rows, key, clean, threshold).select(F.col("key").alias("_k")).distinct()
                wanted = wanted.unionByName(rows.join(near, F.col(key) == F.col("_k"), "left_semi").where(~F.col(key).isin(*clean)))
            if not wanted.isEmpty():
                out[name] = wanted
        return out

    def index(self, name: str, model: str = "offline-hash-64") -> dict[str, int]:
        """Adds what is missing to the graph and to the embeddings of an entity: once more changes nothing. The outcome is audited."""
        e, df = self.registry.entities[name], self.frames[name]
        label = name.replace(".", "__")
        try:
            fresh = graph.nodes_from(df, label, e.key)
            if self.nodes is not None:
                fresh = fresh.join(self.nodes.select("id"), "id", "left_anti")
            n_nodes = fresh.count()
            self.nodes = fresh if self.nodes is None else self.nodes.unionByName(fresh)
            n_vec = 0
            for column in e.embedded:
                have = self.embeddings.get(name) if self.embeddings.get(name) is not None else self.spark.createDataFrame([], "id string, source_record_id string, column_name string, embedding_vector array<float>, embedding_name string")
                todo = search.pending_embeddings(df, have, "id", column, model)
                new = embedding_records(todo, self.embedder)
                n_vec += new.count()
                self.embeddings[name] = have.unionByName(new)
            self.audit.append((name, "OK", None))
            return {"nodes": n_nodes, "embeddings": n_vec}
        except Exception as x:
            self.audit.append((name, "ERROR", str(x)[:200]))
            raise


class Repository:
    """An entity as one user sees it."""

    def __init__(self, engine: Engine, name: str, context: security.UserContext | None):
        self.engine, self.name, self.context = engine, name, context
        self.type = engine.registry.entities[name]

    @property
    def rows(self) -> DataFrame:
        return security.secured(self.engine.frames[self.name], self.context)

    def select(self, fields: Sequence[str] | None = None, **filters: object) -> DataFrame:
        return entities.select_with_predicates(self.rows, filters, fields)

    def page(self, order_by: Sequence[str], limit: int, offset: int = 0, **filters: object) -> DataFrame:
        return entities.select_with_predicates(self.rows, filters, order_by=order_by, limit=limit, offset=offset)

    def get_by_id(self, key: object) -> dict | None:
        row = self.rows.where(F.col("id") == key).first()
        return row.asDict() if row else None

    def get_by_name(self, name: object) -> dict | None:
        row = self.rows.where(F.col(self.type.key) == name).first()
        return row.asDict() if row else None

    def update_records(self, changes: DataFrame, version: str | None = None) -> int:
        """Upserts; updated_at is set where the entity has it. Quotes in texts stay as they are."""
        have = self.engine.frames[self.name]
        if "updated_at" in have.columns:
            kind = dict(have.dtypes)["updated_at"]
            changes = changes.withColumn("updated_at", F.current_timestamp().cast(kind))
        self.engine.frames[self.name] = entities.upsert(have, changes, "id", version)
        return changes.select("id").distinct().count()

    def delete_records(self, doomed: DataFrame) -> None:
        """Removes rows by id, and their embeddings with them."""
        self.engine.frames[self.name] = entities.delete_where(self.engine.frames[self.name], doomed, "id")
        if self.name in self.engine.embeddings:
            gone = doomed.select(F.col("id").alias("source_record_id"))
            self.engine.embeddings[self.name] = entities.delete_where(self.engine.embeddings[self.name], gone, "source_record_id")

    def search(self, question: str, semantic_only: bool = False, min_confidence: float = 0.7, limit: int = 3, threshold: float | None = 0.75, where: Column | None = None) -> Answer:
        """Both legs of a question. The relational one runs only if the planner is confident enough; a leg that fails leaves its error, not an exception."""
        a = Answer(None, 0.0, None, None)
        rows = self.rows if where is None else self.rows.where(where)
        if not semantic_only:
            try:
                a.query_text, a.confidence = self.engine.planner(question, self.type)
                if a.confidence >= min_confidence:
                    word = max((w.strip("?.,!").lower() for w in question.split()), key=len, default="")
                    a.relational = rows.where(F.expr(a.query_text.replace(":word", "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'")))
            except Exception as x:
                a.errors.append(f"relational: {x}"[:300])
        if self.name in self.engine.embeddings:
            try:
                vector = self.engine.embedder([question])[0]
                a.vector = search.entity_vector_search(rows, self.engine.embeddings[self.name], vector, "source_record_id", "embedding_vector", "id", threshold, limit)
            except Exception as x:
                a.errors.append(f"vector: {x}"[:300])
        return a

    def prompt(self, enum_columns: Sequence[str] = (), max_enum: int = 200) -> str:
        enums: dict[str, list[str]] = {}
        if enum_columns:
            for r in entities.enum_values(self.rows, enum_columns, max_enum).orderBy("column_name", "value").collect():  # at most max_enum a column
                enums.setdefault(r.column_name, []).append(r.value)
        return entities.markdown_prompt(self.name, self.type.description, [(n, t, "") for n, t in self.type.fields.items()], enums)


def recent_memories(sessions: DataFrame, users: DataFrame, since: dt.datetime, kinds: Sequence[str], limit: int = 200) -> DataFrame:
    """Sessions of known users updated after ``since``, newest first."""
    s = sessions.where((F.col("updated_at") > F.lit(since)) & F.col("session_type").isin(*kinds))
    return s.join(users.select(F.col("id").alias("_u")), F.col("userid") == F.col("_u"), "left_semi").orderBy(F.desc("updated_at"), "id").limit(limit)


def user_facts(facts: Mapping[str, str], user: str, spark: SparkSession) -> DataFrame:
    """(id, userid, label, content): facts of a user with ids by user and label."""
    from weftline.functions.ids import uuid5

    rows = spark.createDataFrame([(user, k, v) for k, v in facts.items()], "userid string, label string, content string")
    return rows.withColumn("id", uuid5(F.concat_ws(".", "userid", "label")))


def upsert_web_results(resources: DataFrame, links: DataFrame, results: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """Search results (url, title, summary, content, score) as resources, and links of the task to them where they are missing."""
    from weftline.functions.ids import uuid5

    new = results.where("url is not null").dropDuplicates(["url"]).select(uuid5(F.col("url")).alias("id"), F.col("title").alias("name"), F.lit("web").alias("category"), "content", "summary", F.lit(0).alias("ordinal"), F.col("url").alias("uri"))
    link = new.select(uuid5(F.concat_ws("-", F.lit(task), "id")).alias("id"), F.lit(task).alias("session_id"), F.col("id").alias("resource_id"))
    return entities.upsert(resources, new, "id"), entities.insert_if_absent(links, link, "id")


def json_safe(value: object, depth: int = 10) -> object:
    """A copy that JSON can hold: dates as text, unknown objects as text, nothing deeper than ``depth``."""
    if depth <= 0:
        return "..."
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, Mapping):
        return {str(k): json_safe(v, depth - 1) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v, depth - 1) for v in value]
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "asDict"):
        return json_safe(value.asDict(), depth - 1)
    try:
        json.dumps(value)
        return value
    except TypeError:
        return str(value)
