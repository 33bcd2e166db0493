"""The k most similar vectors of every vector: a block matrix join.

Usable vectors of a group (table, model) are numbered in the order of their ids and cut into ``s`` parts of equal size.
There is a task for each pair of parts, s (s + 1) / 2 in all, so each pair of vectors meets once and serves both. Within a
task, tiles of the pair are integer products of int8 codes. The rounding errors of the codes are known, so a product
bounds the cosine of its pair; pairs whose upper bound reaches the k-th best found so far of either vector are computed
again in float64 from the vectors themselves and merged into its running best k. The lists of the tasks are then
merged a part at a time. Nothing is lost: the result is exact up to float rounding.

Copies of a vector are compared once a partition; its list is then given to all of them, and in the lists of others it
stands for its first k + 1 copies. So a vector that a third of all rows repeat costs no more than another.

Work is quadratic within a group. No pair is ever materialised but the survivors. Each vector is sent to s tasks, so the
shuffle carries s x n vectors and about s x n x k entries of 20 bytes. A task holds two parts: ``part_bytes`` bounds the
floats of one (64 MB: 262,144 vectors of 64 dimensions, 10,922 of 1,536), and with codes, tile, lists and
the Arrow batch it needs some seven times that.

Edge cases: null, empty, zero, not-a-number vectors, vectors with null elements and those whose length is not the
usual one of their group (the most frequent, the smaller on a tie) are in no result. Repeated ids of a group count once (the
greatest vector if they differ). Similarities that are equal to 12 digits are ties, which go to the smaller id. Groups with one usable vector give no row.
Null ids are skipped; a null group is a group. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows sent at once, rows and columns of a tile, columns that give the first bounds and how many of them count as one
BLOCK, TILE, WIDE, FIRST, STRETCH = 2048, 1024, 4096, 8192, 16
#: the same columns where a least similarity is the first bound; they still tell vectors that have more than k others above it
FIRST_ABOVE = 1024
#: rows whose lists are merged at once, pairs looked at once
SLICE, HITS = 1024, 1 << 18
#: codes of rows lie in -63..63 (moved to 1..127), codes of columns in -127..127: two products fit 16 bits
ROW_LEVELS, COLUMN_LEVELS, ZERO = 63, 127, 64


def usable_vectors(df: DataFrame, vec_table: str, vector: str, name: str = "embedding_name", id_col: str = "id") -> DataFrame:
    """(vec_table, model, id, vec) of the usable vectors of one table; repeated ids are still there."""
    v = F.col("vec")
    rows = df.select(F.lit(vec_table).alias("vec_table"), F.col(name).alias("model"), F.lower(F.col(id_col)).alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.col("id").isNotNull())
    lengths = rows.groupBy("vec_table", "model", F.size(v).alias("dim")).count()
    usual = lengths.groupBy("vec_table", "model").agg(F.max_by("dim", F.struct("count", (-F.col("dim")).alias("d"))).alias("usual")).select(F.col("vec_table").alias("_t"), F.col("model").alias("_m"), "usual")
    rows = rows.join(usual, (F.col("vec_table") == F.col("_t")) & F.col("model").eqNullSafe(F.col("_m")) & (F.size(v) == F.col("usual"))).drop("_t", "_m", "usual")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


# ---------------------------------------------------------------- integer products


def _wire(tag: int, value: int | bytes) -> bytes:
    """A field of a protocol buffer."""

    def number(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return number(tag << 3) + number(value) if isinstance(value, int) else number(tag << 3 | 2) + number(len(value)) + value


@lru_cache(maxsize=1)
def _session():
    """A runtime with one node that multiplies unsigned by signed bytes; None where there is no such runtime."""
    try:
        import onnxruntime as ort
    except ImportError:
        return None
    uint8, int8, int32 = 2, 3, 6
    axis = lambda n: _wire(1, _wire(2, n))
    value = lambda name, kind, *axes: _wire(1, name) + _wire(2, _wire(1, _wire(1, kind) + _wire(2, b"".join(axis(a) for a in axes))))
    node = b"".join(_wire(1, x) for x in (b"rows", b"columns", b"zero")) + _wire(2, b"tile") + _wire(4, b"MatMulInteger")
    graph = _wire(1, node) + _wire(2, b"tile") + _wire(11, value(b"rows", uint8, b"m", b"d")) + _wire(11, value(b"columns", int8, b"d", b"n")) + _wire(11, value(b"zero", uint8)) + _wire(12, value(b"tile", int32, b"m", b"n"))
    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return ort.InferenceSession(_wire(1, 8) + _wire(8, _wire(2, 13)) + _wire(7, graph), options, providers=["CPUExecutionProvider"])


def product(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact products of (m, d) row codes (uint8, moved by ZERO) and (d, n) column codes (int8)."""
    session = _session()
    if session is not None:
        return session.run(None, {"rows": rows, "columns": columns, "zero": np.array(ZERO, np.uint8)})[0]
    exact = np.float32 if ROW_LEVELS * COLUMN_LEVELS * rows.shape[1] < 1 << 24 else np.float64
    return (rows.astype(exact) - ZERO) @ columns.astype(exact)


def _codes(unit: np.ndarray, levels: int, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the step of each row (its own with ``each``, else one for all), and the norm of its rounding error."""
    most = np.maximum(np.abs(unit).max(axis=1), 1e-12)
    step = (most if each else np.full_like(most, most.max())) / levels
    code = np.rint(unit / step[:, None])
    return code.astype(np.int8), step, np.linalg.norm(unit - code * step[:, None], axis=1)


# ---------------------------------------------------------------- a pair of parts


def best(row: np.ndarray, sim: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row, in order, and their ranks from 0. Equal similarities go by number."""
    order = np.argsort(-sim, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, sim, other = row[order], sim[order], other[order]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    tied = np.flatnonzero(~new[1:] & (sim[1:] == sim[:-1]))
    if len(tied):
        mixed = np.isin(row, row[tied])
        place = np.flatnonzero(mixed)
        again = place[np.lexsort((other[place], -sim[place], row[place]))]
        sim[place], other[place] = sim[again], other[again]
    first = np.flatnonzero(new)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep = rank < k
    return row[keep], sim[keep], other[keep], rank[keep]


class Part:
    """The vectors of a part and the running best k of each. ``num``: the number of its first vector. ``least``: less similar ones are not wanted."""

    def __init__(self, num: int, mat: np.ndarray, k: int, least: float | None = None):
        self.num, self.mat, self.k, self.m = num, mat, k, len(mat)
        self.norm = np.empty(self.m)
        for lo in range(0, self.m, TILE):
            self.norm[lo : lo + TILE] = np.linalg.norm(mat[lo : lo + TILE].astype(np.float64), axis=1)
        self.unit = mat / self.norm[:, None].astype(np.float32)
        self.floor = np.full(self.m, -np.inf if least is None else least)
        self.first = FIRST if least is None else FIRST_ABOVE
        self.row, self.sim, self.other = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def as_rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, step, error = _codes(self.unit, ROW_LEVELS, True)
        return code.view(np.uint8) + np.uint8(ZERO), step, error

    def as_columns(self) -> tuple[np.ndarray, float, float]:
        """Codes as (dimensions, vectors), their step and the greatest error."""
        code, step, error = _codes(self.unit, COLUMN_LEVELS, False)
        return np.ascontiguousarray(code.T), float(step[0]), float(error.max())

    def merge(self, row: np.ndarray, sim: np.ndarray, other: np.ndarray) -> None:
        """Takes new entries; ``other`` are numbers, which are in the order of the ids."""
        keep = sim >= self.floor[row]
        row, sim, other = row[keep], sim[keep], other[keep]
        if not len(row):
            return
        touched = np.zeros(self.m, bool)
        touched[row] = True
        old = touched[self.row]
        r, s, o = np.concatenate([self.row[old], row]), np.concatenate([self.sim[old], sim]), np.concatenate([self.other[old], other])
        r, s, o, rank = best(r, s, o, self.k)
        full = rank == self.k - 1
        self.floor[r[full]] = np.maximum(self.floor[r[full]], s[full])
        self.row, self.sim, self.other = np.concatenate([self.row[~old], r]), np.concatenate([self.sim[~old], s]), np.concatenate([self.other[~old], o])

    def first_bounds(self, rows: np.ndarray, scale: np.ndarray, slack: np.ndarray, columns: np.ndarray) -> None:
        """Lower bounds of the k-th best from some columns: of the greatest of each STRETCH, k + 1 are as many other vectors, or itself and k."""
        whole = min(columns.shape[1], self.first) // STRETCH * STRETCH
        if whole // STRETCH <= self.k:
            return
        columns = np.ascontiguousarray(columns[:, :whole])
        for lo in range(0, self.m, TILE):
            tops = product(rows[lo : lo + TILE], columns).reshape(-1, STRETCH, whole // STRETCH).max(axis=1)
            kth = np.partition(tops, tops.shape[1] - self.k - 1, axis=1)[:, -self.k - 1]
            self.floor[lo : lo + TILE] = np.maximum(self.floor[lo : lo + TILE], kth * scale[lo : lo + TILE] - slack[lo : lo + TILE])


def compare(a: Part, b: Part) -> None:
    """Every pair of ``a`` x ``b`` (of ``a`` alone where they are the same) into the lists of both."""
    rows, step, error = a.as_rows()
    columns, column_step, column_error = b.as_columns()
    scale, slack = step * column_step, error * (1 + column_error) + column_error + 1e-6
    a.first_bounds(rows, scale, slack, columns)
    if a is not b:
        back, back_step, back_error = b.as_rows()
        there, there_step, there_error = a.as_columns()
        b.first_bounds(back, back_step * there_step, back_error * (1 + there_error) + there_error + 1e-6, there)
    for lo in range(0, a.m, TILE):
        for left in range(lo if a is b else 0, b.m, WIDE):
            hi, right = min(a.m, lo + TILE), min(b.m, left + WIDE)
            tile = product(rows[lo:hi], np.ascontiguousarray(columns[:, left:right]))
            floor = np.minimum(a.floor[lo:hi], b.floor[left:right].min())
            least = np.where(np.isinf(floor), -(1 << 30), np.floor((floor - slack[lo:hi]) / scale[lo:hi])).astype(tile.dtype)
            hits = np.flatnonzero(tile >= least[:, None])
            for x in range(0, len(hits), HITS):
                i, j = np.divmod(hits[x : x + HITS], right - left)
                keep = tile[i, j] * scale[lo + i] + slack[lo + i] >= np.minimum(a.floor[lo + i], b.floor[left + j])
                i, j = i[keep] + lo, j[keep] + left
                if a is b:
                    keep = i < j
                    i, j = i[keep], j[keep]
                _recompute(a, b, i, j)


def _recompute(a: Part, b: Part, i: np.ndarray, j: np.ndarray) -> None:
    """Cosines of pairs from the vectors themselves: in float32 to see which could count, then in float64."""
    for x in range(0, len(i), 65536):
        p, q = i[x : x + 65536], j[x : x + 65536]
        rough = np.einsum("ij,ij->i", a.unit[p], b.unit[q])
        keep = rough >= np.minimum(a.floor[p], b.floor[q]) - 1e-5
        p, q = p[keep], q[keep]
        sim = np.round(np.einsum("ij,ij->i", a.mat[p].astype(np.float64), b.mat[q].astype(np.float64)) / (a.norm[p] * b.norm[q]), 12)
        a.merge(p, sim, b.num + q)
        b.merge(q, sim, a.num + p)


# ---------------------------------------------------------------- Spark


@dataclass
class Group:
    """How the vectors of one (table, model) are laid out. ``starts``: number of the first vector of a partition."""

    index: int
    rows: int = 0
    dim: int = 0
    parts: int = 1
    first_task: int = 0
    starts: dict[int, int] = field(default_factory=dict)

    @property
    def part_rows(self) -> int:
        return -(-self.rows // self.parts)

    def tasks_of(self, part: int) -> list[int]:
        """A task for each pair of parts, numbered along the upper triangle."""
        pair = lambda i, j: i * self.parts - i * (i - 1) // 2 + j - i
        return [self.first_task + pair(min(part, x), max(part, x)) for x in range(self.parts)]


def layout(sizes: Iterable[tuple[str, str | None, int, int, int]], tasks: int, part_bytes: int) -> tuple[dict[tuple[str, str | None], Group], int]:
    """Groups from (table, model, partition, rows, dimensions), and the number of tasks in all, about ``tasks``."""
    groups: dict[tuple[str, str | None], Group] = {}
    for t, m, pid, rows, dim in sorted(sizes, key=lambda x: (x[2], x[0], x[1] or "")):
        g = groups.setdefault((t, m), Group(len(groups)))
        g.starts[pid] = g.rows
        g.rows, g.dim = g.rows + rows, dim
    work = sum(g.rows**2 * g.dim for g in groups.values()) or 1
    total = 0
    for g in groups.values():
        share = tasks * g.rows**2 * g.dim / work
        g.parts = max(1, int((math.sqrt(8 * share + 1) - 1) / 2 + 0.5), -(-g.rows * g.dim * 4 // part_bytes))
        g.first_task = total
        total += g.parts * (g.parts + 1) // 2
    return groups, total


MARKED = "vec_table string, model string, pid int, id string, vec array<float>, h long, local long, rep boolean"
PACKED = "grp int, part int, num long, dim int, tasks array<int>, mat binary"
LISTS = "grp int, part int, slice int, rows binary, sims binary, others binary"
MERGED = "grp int, num long, other long, similarity double, rank int"
NAMES = "grp int, num long, vec_table string, model string, pid int, id string, h long"
RESULT_DDL = "vec_table string, model string, id string, neighbour string, similarity double, rank int"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the different vectors of each group in a partition; a copy has the number of the first. Rows come in order of the ids."""
    now, seen = None, {}
    for b in batches:
        local, rep = np.empty(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
        for i, (t, m, h) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True)):
            if (t, m) != now:
                now, seen = (t, m), {}
            rep[i] = h not in seen
            local[i] = seen.setdefault(h, len(seen))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local), pa.array(rep)], names=[x.split(" ")[0] for x in MARKED.split(", ")])


def _runs(b: pa.RecordBatch, groups: dict[tuple[str, str | None], Group]) -> Iterator[tuple[Group, np.ndarray, pa.RecordBatch]]:
    """Stretches of rows of one group with the numbers of their vectors."""
    keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    local = b.column(b.schema.get_field_index("local")).to_numpy()
    lo = 0
    while lo < len(keys):
        hi = lo + 1
        while hi < len(keys) and keys[hi] == keys[lo]:
            hi += 1
        g = groups[keys[lo][:2]]
        yield g, g.starts[keys[lo][2]] + local[lo:hi], b.slice(lo, hi - lo)
        lo = hi


def _batch(ddl: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split(" ") for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def similar_vectors(vectors: DataFrame, k: int = 10, least: float | None = None, tasks: int | None = None, part_bytes: int = 64 << 20) -> DataFrame:
    """The ``k`` nearest other vectors of each vector by cosine: (vec_table, model, id, neighbour, similarity, rank).

    ``vectors`` as from :func:`usable_vectors` (a union of several tables is fine). ``least``: of the k nearest only those at
    least so similar are wanted; it is the first bound of every list, so no less similar pair is computed again or sent. ``tasks``: about how many there are, by
    default one and a half a core; fewer shuffle less. ``part_bytes`` bounds what a task holds, see the module text.
    """
    spark = vectors.sparkSession
    from weftline.session import cut, parallelism

    n = parallelism(spark, 4)
    key = ["vec_table", "model", "id"]
    # placed by range of the id: the same shuffle serves to drop repeats and to number in the order of the ids
    placed = vectors.select(*key, "vec").repartitionByRange(n, *key).groupBy(*key).agg(F.max("vec").alias("vec")).sortWithinPartitions(*key)
    placed = cut(placed.select("vec_table", "model", F.spark_partition_id().alias("pid"), "id", "vec", F.xxhash64("vec").alias("h")).mapInArrow(_mark, MARKED))
    sizes = placed.where("rep").groupBy("vec_table", "model", "pid").agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("dim")).collect()  # a row a group and partition
    groups, total = layout([tuple(r) for r in sizes], tasks or -(-3 * n // 2), part_bytes)
    if not total:
        return spark.createDataFrame([], RESULT_DDL)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, nums, b in _runs(batch, groups):
                cuts = [0, *(i for i in range(1, len(nums)) if nums[i] % g.part_rows == 0), len(nums)]
                for lo, end in zip(cuts, cuts[1:], strict=False):
                    for at in range(lo, end, BLOCK):
                        rows, part = b.slice(at, min(BLOCK, end - at)), int(nums[at]) // g.part_rows
                        mat = rows.column(3).flatten().to_numpy(zero_copy_only=False).astype("<f4")
                        yield _batch(PACKED, [[g.index], [part], [int(nums[at])], [g.dim], [g.tasks_of(part)], [mat.tobytes()]])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, nums, b in _runs(batch, groups):
                yield _batch(NAMES, [[g.index] * b.num_rows, pa.array(nums), b.column(0), b.column(1), b.column(2), b.column(3), b.column(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[int, np.ndarray]]] = {}
        group = 0
        for b in batches:
            for grp, part, num, dim, mat in zip(*(b.column(i) for i in range(5)), strict=True):
                group = grp.as_py()
                blocks.setdefault(part.as_py(), []).append((num.as_py(), np.frombuffer(mat.as_buffer(), "<f4").reshape(-1, dim.as_py())))
        sides = {}
        for part, own in blocks.items():
            own.sort(key=lambda x: x[0])
            sides[part] = Part(own[0][0], np.concatenate([m for _, m in own]), k, least)
            own.clear()
        if not sides:
            return
        compare(sides[min(sides)], sides[max(sides)])
        for part, side in sides.items():
            order = np.argsort(side.row, kind="stable")
            row, sim, other = side.row[order], side.sim[order], side.other[order]
            cuts = np.searchsorted(row, np.arange(0, side.m + SLICE, SLICE))
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if lo < hi:
                    yield _batch(LISTS, [[group], [part], [i], [(side.num + row[lo:hi]).tobytes()], [sim[lo:hi].tobytes()], [other[lo:hi].tobytes()]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sim, other, rank, grp = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), 0
        for b in batches:
            grp = b.column(0)[0].as_py()
            for r, s, o in zip(b.column(3), b.column(4), b.column(5), strict=True):
                fresh = (np.frombuffer(x.as_buffer(), t) for x, t in ((r, np.int64), (s, np.float64), (o, np.int64)))
                row, sim, other, rank = best(*(np.concatenate(x) for x in zip((row, sim, other), fresh, strict=True)), k)
        yield _batch(MERGED, [[grp] * len(row), pa.array(row), pa.array(other), pa.array(sim), pa.array(rank + 1, pa.int32())])

    sent = placed.where("rep").select("vec_table", "model", "pid", "vec", "local").mapInArrow(pack, PACKED)
    sent = sent.withColumn("task", F.explode("tasks")).drop("tasks").repartitionById(total, F.col("task"))
    lists = sent.select("grp", "part", "num", "dim", "mat").mapInArrow(run, LISTS)
    merged = lists.groupBy("grp", "part", "slice").applyInArrow(merge, MERGED)
    names = placed.select("vec_table", "model", "pid", "id", "h", "local").mapInArrow(name, NAMES)
    copies = cut(names.groupBy("grp", "h").agg(F.count("*").alias("c")).where("c > 1").select("grp", "h"))
    if copies.isEmpty():
        near = names.select(F.col("grp").alias("_g"), F.col("num").alias("_n"), F.col("id").alias("neighbour"))
        out = merged.join(names, ["grp", "num"]).join(near, (F.col("grp") == F.col("_g")) & (F.col("other") == F.col("_n")))
        return out.select("vec_table", "model", "id", "neighbour", "similarity", "rank")
    return _with_copies(merged, names, copies, k)


def _with_copies(merged: DataFrame, names: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Lists of different vectors as lists of ids: a copy has the list of the vector it repeats, and a vector in a list stands for its first k + 1 copies."""
    same = names.join(copies, ["grp", "h"], "left_semi")
    # first within a partition, so that no window holds all copies of a vector
    few = same.withColumn("r", F.row_number().over(Window.partitionBy("grp", "h", "pid").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("grp", "h").orderBy("id"))).where(F.col("r") <= k + 1)
    members = few.groupBy("grp", "h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    whose = names.groupBy("grp", "num").agg(F.min("h").alias("h"), F.min("id").alias("first"))
    near = merged.join(whose.select(F.col("grp").alias("_g"), F.col("num").alias("_n"), F.col("h").alias("_h"), "first"), (F.col("grp") == F.col("_g")) & (F.col("other") == F.col("_n")))
    near = near.join(whose.select("grp", "num", "h"), ["grp", "num"]).where("h != _h")
    near = near.groupBy("grp", "num", "_h").agg(F.max("similarity").alias("similarity"), F.min("first").alias("first"))
    near = near.join(members.select(F.col("grp").alias("_g"), F.col("h").alias("_m"), "ids"), (F.col("grp") == F.col("_g")) & (F.col("_h") == F.col("_m")), "left")
    near = near.select("grp", "num", "similarity", F.explode(F.coalesce("ids", F.array("first"))).alias("neighbour"))
    mine = ["grp", "vec_table", "model", "id", "neighbour", "similarity"]
    found = near.join(names, ["grp", "num"]).select(*mine)
    own = same.join(members, ["grp", "h"]).withColumn("neighbour", F.explode("ids")).where("neighbour != id").withColumn("similarity", F.lit(1.0)).select(*mine)
    rank = F.row_number().over(Window.partitionBy("grp", "id").orderBy(F.desc("similarity"), "neighbour"))
    return found.unionByName(own).withColumn("rank", rank).where(F.col("rank") <= k).select("vec_table", "model", "id", "neighbour", "similarity", "rank")
