"""Current rows: one row an id, the latest delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: Sequence[str] | None = None) -> DataFrame:
    """One row for each value of ``keys``: the one with the greatest ``order``.

    Works as an aggregation with a map-side part, so repeated deliveries of a hot key shrink before the shuffle.
    Null keys form a group of their own; a null order sorts below every value; rows equal in ``order`` are decided
    by their content, so the result does not depend on the order of arrival. An empty frame stays empty.
    """
    keep = [c for c in (keep or df.columns) if c not in keys]
    orderings = [F.col(c) if isinstance(c, str) else c for c in order]
    payload = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(1).alias("_"))
    tie = F.xxhash64(*[F.col(c).cast("string") if t.startswith(("map", "variant")) else F.col(c) for c, t in df.dtypes if c in keep]) if keep else F.lit(0)
    best = df.groupBy(*keys).agg(F.max_by(payload, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(orderings)], tie.alias("tie"))).alias("_p"))
    return best.select(*keys, *[F.col("_p")[c].alias(c) for c in keep])


def latest_ids(df: DataFrame, key: str, version: str, narrow: Sequence[Column]) -> DataFrame:
    """(key, version, narrow columns) of the current row of each key, without shuffling the wide columns."""
    return df.groupBy(key).agg(F.max_by(F.struct(F.col(version).alias(version), *narrow), F.struct(F.col(version), *narrow)).alias("_p")).select(key, "_p.*")
