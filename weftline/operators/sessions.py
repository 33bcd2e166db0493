"""Sessions, their audit, user memories and upload listings, as upserts and filters over entity frames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import jsonb_uuid
from weftline.functions.text import contains_ci
from weftline.operators.entities import upsert


def new_sessions(requests: DataFrame, now: Column) -> DataFrame:
    """Session rows for (userid, query, agent): ids by time and user, so that a repeated request is the same session."""
    stamped = requests.withColumn("created_at", now)
    ident = jsonb_uuid({"timestamp": (F.col("created_at").cast("string"), "string"), "user_id": (F.col("userid"), "string")})
    return stamped.select(ident.alias("id"), "userid", "query", "agent", "created_at", F.col("created_at").alias("updated_at"), F.lit(None).cast("timestamp").alias("session_completed_at"))


def complete_sessions(sessions: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Sessions with those in ``done`` (id) marked complete; a time that is set stays."""
    d = done.select(F.col("id").alias("_d")).distinct()
    j = sessions.join(d, F.col("id") == F.col("_d"), "left")
    hit = F.col("_d").isNotNull()
    return j.withColumn("session_completed_at", F.when(hit, F.coalesce("session_completed_at", now)).otherwise(F.col("session_completed_at"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).drop("_d")


def audit(sessions: DataFrame, turns: DataFrame, new_session: DataFrame, new_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a conversation: the session without empty metadata, its turns by id."""
    clean = new_session.withColumn("metadata", F.when(F.trim("metadata").isin("", "{}", "null"), F.lit(None).cast("string")).otherwise(F.col("metadata"))) if "metadata" in new_session.columns else new_session
    return upsert(sessions, clean, "id", "updated_at"), upsert(turns, new_turns, "id", "created_at")


def user_memory(users: DataFrame, who: str) -> DataFrame:
    """The row of a user by id or by e-mail, without regard to case."""
    return users.where((F.col("id") == who) | (F.lower("email") == who.lower()))


def digest(turns: DataFrame, start: dt.datetime, days: int = 1) -> DataFrame:
    """(userid, messages, sessions, first, last): what each user did in the ``days`` from ``start``; messages without a user are nobody's."""
    t = turns.where(F.col("userid").isNotNull() & (F.col("created_at") >= F.lit(start)) & (F.col("created_at") < F.lit(start + dt.timedelta(days=days))))
    return t.groupBy("userid").agg(F.count("*").alias("messages"), F.countDistinct(F.lower("session_id")).alias("sessions"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def list_uploads(uploads: DataFrame, user: str | None = None, tags: Sequence[str] | None = None, status: str | None = None, text: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Uploads with all filters applied, newest first."""
    u = uploads
    if user is not None:
        u = u.where(F.col("userid") == user)
    if tags:
        u = u.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if status is not None:
        u = u.where(F.col("status") == status)
    if text:
        u = u.where(contains_ci(F.col("filename"), text))
    return u.orderBy(F.desc("updated_at"), "upload_id").offset(offset).limit(limit)


def sync_keys(df: DataFrame, key: str, tokens: DataFrame) -> DataFrame:
    """``df`` with ``token`` set from (key, token) where the key is listed."""
    t = tokens.dropDuplicates([key]).select(F.col(key).alias("_k"), F.col("token").alias("_t"))
    return df.join(t, F.col(key) == F.col("_k"), "left").withColumn("token", F.coalesce("_t", "token")).drop("_k", "_t")


def by_type(sinks: dict[str, Callable[[DataFrame], None]], column: str = "kind") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands the rows of each kind to its sink; kinds without a sink are an error."""

    def write(batch: DataFrame, _: int) -> None:
        kinds = {r[0] for r in batch.select(column).distinct().collect()}  # kinds of audit records, a handful
        if unknown := kinds - set(sinks):
            raise ValueError(f"no sink for {sorted(map(str, unknown))}")
        for k in sorted(kinds):
            sinks[k](batch.where(F.col(column) == k).drop(column))

    return write
