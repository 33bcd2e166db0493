"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

#: edges whose stars are made at once, and bytes of them; stars of half as many are kept for the next ones
CHUNK, CHUNK_BYTES = 1 << 21, 128 << 20
#: types of nodes that Arrow can number
NUMBERED = {"string", "binary", "tinyint", "smallint", "int", "bigint", "date"}


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes, one node of its component over the edges (a, b)."""
    root = np.arange(n, dtype=np.int32)
    while len(a):
        root[np.maximum(a, b)] = np.minimum(a, b)  # of several only the last counts; each step leaves fewer roots
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with the same components, one less than nodes in each component; a node with nothing but a loop keeps it.

    The stars of a chunk are taken into the next, so a partition gives one edge a node, unless its nodes are too many to hold.
    """

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.chunked_array([x.column(i) for i in range(2) for x in held]).dictionary_encode()
        nodes, code = ends.chunk(0).dictionary, np.concatenate([x.indices.to_numpy() for x in ends.chunks])
        a, b = code[: len(code) // 2], code[len(code) // 2 :]
        root = _roots(a[a != b], b[a != b], len(nodes))
        own = root == np.arange(len(nodes))
        keep = np.flatnonzero(~own | (np.bincount(root, minlength=len(nodes)) == 1))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(keep)), nodes.take(pa.array(root[keep]))], names=["u", "v"])

    held, rows, size = [], 0, 0
    for x in batches:
        held.append(x)
        rows, size = rows + x.num_rows, size + x.nbytes
        if rows >= CHUNK or size >= CHUNK_BYTES:
            made = stars(held)
            held, rows, size = [made], made.num_rows, made.nbytes
            if rows > CHUNK // 2 or size > CHUNK_BYTES // 2:
                yield made
                held, rows, size = [], 0, 0
    if rows:
        yield stars(held)


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of the edges and a hash of them all; edges are distinct, so none cancels another, and no sum that overflows."""
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("h")).first()
    return r.n, r.h


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    linked = down.join(least, F.col("u") == F.col("c"))
    return linked.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the component is the least node in it. Nodes without an edge are not listed.

    Before anything is shuffled, the edges of each partition become stars, as far as memory goes. Each round is two
    aggregations and joins; hubs are handled as minima and joins (AQE splits hot keys), never as lists. Rounds are cut
    with checkpoint(). Null ends and loops are ignored; an empty edge list gives no rows; more than ``max_rounds``
    rounds are an error.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if dict(e.dtypes)["u"] in NUMBERED:
        e = e.coalesce(e.sparkSession.sparkContext.defaultParallelism).mapInArrow(_local_stars, e.schema)
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut(e.distinct())
    loops = e.where("u = v").select(F.col("u").alias("node"))
    e, looped = e.where("u != v"), not loops.isEmpty()
    seen = _mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        e = cut(_small_star(_large_star(e)))
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components are not finished after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select("component").distinct().select(F.col("component").alias("node"), "component")
    found = stars.unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))) if looped else found
