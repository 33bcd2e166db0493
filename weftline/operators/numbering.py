"""Row numbers within groups of any size, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, parallelism


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "ordinal", start: int = 0, parts: int | None = None) -> DataFrame:
    """``df`` with ``out`` = consecutive numbers from ``start`` in each ``group``, in the given order.

    Rows are range partitioned by group and order, so that a hot group spreads over many partitions; each
    (group, partition) is numbered by itself and shifted by the sizes of the partitions before it. Null groups are
    groups, null orders come first. Ties in ``order`` are numbered arbitrarily; give a unique last column.
    """
    n = parts or parallelism(df.sparkSession)
    placed = cut(df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "_pid").count()
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_pid").alias("_p2"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_pid") == F.col("_p2")]
    w = Window.partitionBy(*group, "_pid").orderBy(*order)
    numbered = placed.withColumn("_rn", F.row_number().over(w))
    return numbered.join(shift, on, "inner").withColumn(out, (F.col("_rn") + F.col("_shift") - 1 + start).cast("long")).drop("_rn", "_shift", "_pid", "_p2", *[f"_g_{g}" for g in group])
