"""Items in containers of fixed capacity: best two-fit.

Items are spread over groups of bounded size by a hash and each group is packed by itself: a bin is filled greedily
with the largest item that fits; then its smallest item is replaced by two items not yet packed that fill the
widened gap more tightly, as long as that helps. The sizes that are left form a bit set, so the best single item and
the best pair are found with a few word operations. Items of bins that stay below ``good`` are packed again in a
second round over all groups. Only an item larger than the capacity is cut: into full containers and a rest.

Edge cases: null sizes are no items; size 0 goes into the first bin of its group; equal sizes are taken in the order
of their ids; an item of exactly the capacity is a bin; repeated ids are separate items only if their rows differ
(pass distinct ids).
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 50_000
PACKED = "container string, capacity long, bin string, doc_id long, piece int, size long, fill double"


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices into ``sizes`` (all between 1 and the capacity)."""
    left: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        left[sizes[i]].append(i)
    mask = mirror = 0
    for s in left:
        mask |= 1 << s
        mirror |= 1 << (capacity - s)

    def take(s: int) -> int:
        nonlocal mask, mirror
        i = left[s].pop()
        if not left[s]:
            mask ^= 1 << s
            mirror ^= 1 << (capacity - s)
        return i

    def give(s: int, i: int) -> None:
        nonlocal mask, mirror
        left[s].append(i)
        mask |= 1 << s
        mirror |= 1 << (capacity - s)

    bins = []
    while mask:
        content: list[tuple[int, int]] = []
        gap = capacity
        while True:
            while gap and (fits := mask & ((2 << gap) - 1)):
                s = fits.bit_length() - 1
                content.append((s, take(s)))
                gap -= s
            if not gap or not mask:
                break
            small, i = min(content)
            best = None
            for total in range(gap + small, small, -1):
                pair = mask & (mirror >> (capacity - total))
                if total % 2 == 0 and len(left.get(total // 2, ())) < 2:
                    pair &= ~(1 << (total // 2))
                if pair:
                    best = pair.bit_length() - 1, total
                    break
            if best is None:
                break
            content.remove((small, i))
            a, b = best[0], best[1] - best[0]
            content += [(a, take(a)), (b, take(b))]
            gap += small - best[1]
            give(small, i)
        bins.append([i for _, i in content])
    return bins


def _pack(pdf: pd.DataFrame, tag: str) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    capacity = int(pdf.capacity.iloc[0])
    some = pdf["size"] > 0
    sizes = pdf.loc[some, "size"].astype(int).tolist()
    index = pdf.index[some].tolist()
    number = [0] * len(pdf)
    fill = [0.0]
    bins = best_two_fit(sizes, capacity)
    if bins:
        fill = [sum(sizes[i] for i in b) / capacity for b in bins]
    for k, b in enumerate(bins):
        for i in b:
            number[index[i]] = k
    pdf["bin"] = [f"{tag}-{k}" for k in number]
    pdf["fill"] = [fill[k] for k in number]
    return pdf


def pack_items(items: DataFrame, capacities: DataFrame, good: float = 0.97, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each item of (doc_id, size) in a bin of each container of (container, capacity_tokens).

    (container, capacity, bin, doc_id, piece, size, fill): ``piece`` counts the parts of an item above the capacity,
    ``fill`` is how full its bin is.
    """
    from weftline.session import cut

    spark = items.sparkSession
    kinds = [(r.container, int(r.capacity_tokens)) for r in capacities.select("container", "capacity_tokens").collect()]  # a fixed table
    if not kinds:
        return spark.createDataFrame([], PACKED)
    items = cut(items.where("size is not null").select("doc_id", "size"))
    n = items.count()
    groups = max(1, -(-n // group_rows))
    boxes = F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(k).cast("long").alias("capacity")) for c, k in kinds]))
    all_ = items.select("doc_id", F.col("size").cast("long").alias("size"), boxes.alias("b")).select("b.*", "doc_id", "size")
    whole = F.expr("cast(size div capacity as int)")
    parts = all_.withColumn("piece", F.explode(F.expr("if(size <= capacity, array(0), sequence(0, cast((size - 1) div capacity as int)))")))
    parts = parts.withColumn("size", F.when(F.col("size") <= F.col("capacity"), F.col("size")).when(F.col("piece") < whole, F.col("capacity")).otherwise(F.expr("size % capacity")))
    full = parts.where("size = capacity").select("container", "capacity", F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin"), "doc_id", "piece", "size", F.lit(1.0).alias("fill"))
    rest = parts.where("size < capacity").withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(pdf, f"a{key[1]}")[["container", "capacity", "bin", "doc_id", "piece", "size", "fill"]]

    def second(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(pdf, f"b{key[1]}")[["container", "capacity", "bin", "doc_id", "piece", "size", "fill"]]

    once = cut(rest.groupBy("container", "g").applyInPandas(first, PACKED))
    kept = once.where(F.col("fill") >= good)
    loose = once.where(F.col("fill") < good)
    again = max(1, -(-loose.count() // (group_rows * len(kinds))))
    twice = loose.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(again))).groupBy("container", "g").applyInPandas(second, PACKED)
    return full.unionByName(kept).unionByName(twice)


def pack_report(packed: DataFrame) -> DataFrame:
    """(container, capacity, bins, tokens, fill, items, cut_items) for each kind of container."""
    per = packed.groupBy("container", "capacity", "bin").agg(F.sum("size").alias("used"), F.count("*").alias("n"), F.count(F.when(F.col("piece") > 0, 1)).alias("pieces"))
    return per.groupBy("container", "capacity").agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * F.max("capacity"))).alias("fill"), F.sum("n").alias("parts"), F.sum("pieces").alias("cuts"))
