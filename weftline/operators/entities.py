"""Typed entities: selection, keyed storage, lookups, enumerations and prompts."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.latest import latest_rows

DEFAULT_TOOLS = ["help", "get_entities", "search", "announce_generate_large_output", "activate_functions_by_name"]


def predicates(filters: Mapping[str, object]) -> Column:
    """AND of the filters: a list means one of, anything else equals; equal to null matches nothing, an empty list neither."""
    parts: list[Column] = []
    for c, v in filters.items():
        if isinstance(v, (list, tuple, set)):
            parts.append(F.col(c).isin(*v) if v else F.lit(False))
        elif v is None:
            parts.append(F.lit(False))
        else:
            parts.append(F.col(c) == F.lit(v))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def select_with_predicates(df: DataFrame, filters: Mapping[str, object], fields: Sequence[str] | None = None, order_by: Sequence[str] | None = None, limit: int | None = None, offset: int = 0, since: object = None, since_column: str = "updated_at") -> DataFrame:
    """Filtered, projected, ordered and paged rows; ``since`` keeps rows updated at or after it."""
    out = df.where(predicates(filters))
    if since is not None:
        out = out.where(F.col(since_column) >= F.lit(since))
    if fields:
        out = out.select(*fields)
    if order_by:
        out = out.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order_by])
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def records_by_keys(df: DataFrame, keys: Sequence[object], key: str) -> DataFrame:
    """(key, record): matching rows as JSON; null and empty keys are left out."""
    clean = [k for k in keys if k not in (None, "")]
    rows = df.where(F.col(key).isin(*clean)) if clean else df.where("false")
    return rows.select(F.col(key), F.to_json(F.struct("*")).alias("record"))


def semi_join_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(F.col(key)).distinct(), key, "left_semi")


def enum_values(df: DataFrame, columns: Sequence[str], max_values: int = 250) -> DataFrame:
    """(column_name, value): distinct values of the columns that have at most ``max_values``.

    One pass decides by an approximate count, with room for its error; the exact distinct values are then made for those only.
    """
    counts = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    near = [c for c in columns if counts[c] <= max_values * 1.1 + 5]
    if not near:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in near])).alias("p")).select("p.*").where("value is not null").distinct()
    few = pairs.groupBy("column_name").count().where(F.col("count") <= max_values).select("column_name")
    return pairs.join(few, "column_name", "left_semi")


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with the same key; of several changes to a key the last (greatest ``version``) counts.

    New columns of ``changes`` are added, missing ones become null.
    """
    newest = latest_rows(changes, [key], [version or F.lit(0)])
    return current.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def insert_if_absent(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    fresh = rows.dropDuplicates([key]).join(current.select(key), key, "left_anti")
    return current.unionByName(fresh, allowMissingColumns=True)


def delete_where(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """``df`` without the keys of ``doomed``. Null keys stay."""
    return df.join(doomed.select(key).distinct(), key, "left_anti")


def merged_stack(old: Column, new: Column) -> Column:
    """Distinct union of two function stacks, nulls as empty."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(old, empty), F.coalesce(new, empty))


def group_ids(found: DataFrame, kind: str = "entity_type", key: str = "id") -> DataFrame:
    """(entity_type, ids): ids of each type without nulls and empty ones, sorted; types without any are left out."""
    ok = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    g = found.groupBy(F.regexp_replace(kind, "__", ".").alias("entity_type")).agg(F.array_sort(F.collect_set(F.when(ok, F.col(key).cast("string")))).alias("ids"))
    return g.where(F.size("ids") > 0)


def tool_names(functions: Column, add_defaults: bool = True) -> Column:
    """Names in the functions object of an agent, with the built-in tools behind them."""
    own = F.coalesce(F.json_object_keys(functions), F.array().cast("array<string>"))
    return F.concat(own, F.array(*[F.lit(t) for t in DEFAULT_TOOLS])) if add_defaults else own


def markdown_prompt(agent: str, description: str, fields: Sequence[tuple[str, str, str]], enums: Mapping[str, Sequence[str]], settings: str = "") -> str:
    """Prompt that describes an entity: settings, header, table of fields, values of enumerations."""
    lines = [settings, f"## Agent: {agent}", description, "", "| field | type | description |", "| --- | --- | --- |"]
    lines += [f"| {n} | {t} | {d} |" for n, t, d in fields]
    lines += ["", *[f"- {c}: {', '.join(v)}" for c, v in sorted(enums.items())]]
    return "\n".join(x for x in lines if x is not None).strip()


class EntityStore:
    """Entities as Parquet datasets: one folder each, replaced as a whole by a rename. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def exists(self, name: str) -> bool:
        return os.path.isdir(self.path(name))

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes beside the dataset, then swaps folders, so a plan may read what it replaces."""
        new = f"{self.path(name)}.{uuid.uuid4().hex}"
        df.write.parquet(new)
        old = f"{new}.old"
        if self.exists(name):
            os.rename(self.path(name), old)
        os.rename(new, self.path(name))
        shutil.rmtree(old, ignore_errors=True)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path(name))

    def upsert(self, name: str, changes: DataFrame, key: str, version: str | None = None) -> None:
        self.replace(name, upsert(self.read(name), changes, key, version) if self.exists(name) else latest_rows(changes, [key], [version or F.lit(0)]))

    def delete(self, name: str, doomed: DataFrame, key: str) -> None:
        self.replace(name, delete_where(self.read(name), doomed, key))
