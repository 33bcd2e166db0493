"""Sources mixed to target shares, with few repetitions: a min-cost flow.

Texts are identified by a hash of the whole text and grouped by the set of target sources they occur in (their
pattern). The flow sends token capacity from patterns to the quotas of the sources; the first use of a text costs
nothing, each further use one more than the last, so repetitions are spread as evenly as the quotas allow. The
network has at most 2^targets patterns and is solved on the driver; texts are then chosen in a seeded order by running
sums over hash buckets, each text taking the use that the middle of its interval falls into.

Without ``total_tokens`` the mixture is the largest in which every source that has any text gets its share. Sources
without texts are reported with share 0. A text is never used more often than the smallest max_repeats of the
target sources it occurs in.

Edge cases: null texts and texts without a token are not drawn; copies of a text in a source are one text (its least doc_id
stands for it); null sources and sources without a target are not drawn; no texts or no targets give no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIX = "source string, doc_id long, use int, n_tokens long"


class _Flow:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def edge(self, u: int, v: int, cap: int, cost: int) -> int:
        k = len(self.to)
        self.to += [v, u]
        self.cap += [cap, 0]
        self.cost += [cost, -cost]
        self.out[u].append(k)
        self.out[v].append(k + 1)
        return k

    def run(self, s: int, t: int) -> tuple[int, int]:
        flow = cost = 0
        pot: dict[int, int] = defaultdict(int)
        while True:
            dist, back, heap = {s: 0}, {}, [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for k in self.out[u]:
                    if self.cap[k]:
                        v = self.to[k]
                        nd = d + self.cost[k] + pot[u] - pot[v]
                        if nd < dist.get(v, 1 << 62):
                            dist[v], back[v] = nd, k
                            heapq.heappush(heap, (nd, v))
            if t not in dist:
                return flow, cost
            far = max(dist.values())
            for v in self.out:
                pot[v] += dist.get(v, far)
            push, v = 1 << 62, t
            while v != s:
                push = min(push, self.cap[back[v]])
                v = self.to[back[v] ^ 1]
            v = t
            while v != s:
                self.cap[back[v]] -= push
                self.cap[back[v] ^ 1] += push
                cost += push * self.cost[back[v]]
                v = self.to[back[v] ^ 1]
            flow += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[dict[tuple[tuple[str, ...], int, str], int], int]:
    """Tokens by (pattern, use, source), and how many tokens of the quotas were met."""
    net, ids = _Flow(), {}
    node = lambda x: ids.setdefault(x, len(ids))
    s, t = node("s"), node("t")
    arcs = {}
    for p, tokens in sorted(patterns.items()):
        for use in range(1, min(targets[x][1] for x in p) + 1):
            net.edge(s, node((p, use)), tokens, 0)
            for x in p:
                arcs[(p, use, x)] = net.edge(node((p, use)), node(x), tokens, use - 1)
    for x, (share, _) in sorted(targets.items()):
        net.edge(node(x), t, int(share * total), 0)
    met, _ = net.run(s, t)
    return {k: net.cap[e + 1] for k, e in arcs.items() if net.cap[e + 1]}, met


def largest_total(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total of which every source that has a text can get its share (within a token a source)."""
    present = {x for p in patterns for x in p}
    reach = {x: v for x, v in targets.items() if x in present and v[0] > 0}
    if not reach:
        return 0
    lo, hi = 0, min(int(sum(n for p, n in patterns.items() if x in p) * r / share) for x, (share, r) in reach.items())
    while lo < hi:
        mid = (lo + hi + 1) // 2
        want = sum(int(share * mid) for share, _ in reach.values())
        if route({p: n for p, n in patterns.items()}, targets, mid)[1] >= want:
            lo = mid
        else:
            hi = mid - 1
        if hi - lo <= max(1, hi // 10_000):
            break
    return lo


def mix_sources(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """The uses drawn from (doc_id, source, key, n_tokens), ``key`` being a hash of the whole text: (source, doc_id, use, n_tokens)."""
    from weftline.session import cut

    spark = texts.sparkSession
    want = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.select("source", "target_share", "max_repeats").collect() if r.source is not None and r.target_share and r.max_repeats and r.max_repeats > 0}  # a fixed table
    if not want:
        return spark.createDataFrame([], MIX)
    rows = texts.where(F.col("source").isin(*want) & (F.col("n_tokens") > 0) & F.col("key").isNotNull())
    # a copied text is reduced to one row a source before the shuffle on the text alone
    per = rows.groupBy("key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    one = per.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("docs"))
    one = cut(one.select("key", "n_tokens", F.col("docs.source").alias("pattern"), F.map_from_entries("docs").alias("docs"), F.xxhash64(F.lit(seed), "key").alias("h")))
    sums = one.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()  # at most 2^targets rows
    patterns = {tuple(r.pattern): int(r.tokens) for r in sums}
    total = largest_total(patterns, want) if total_tokens is None else total_tokens
    flows, _ = route(patterns, want, total)
    segments, at = [], defaultdict(int)
    for (p, use, x), f in sorted(flows.items()):
        segments.append((list(p), use, x, at[p, use], at[p, use] + f))
        at[p, use] += f
    if not segments:
        return spark.createDataFrame([], MIX)
    buckets = max(1, -(-sum(r.n for r in sums) // bucket_rows))
    placed = one.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))) * buckets).cast("long"))
    by = placed.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = by.select(F.col("pattern").alias("_p"), F.col("bucket").alias("_b"), F.coalesce(F.sum("s").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0))
    middle = placed.withColumn("upto", inner).join(before, (F.col("pattern") == F.col("_p")) & (F.col("bucket") == F.col("_b"))).withColumn("mid", F.col("base") + F.col("upto") - F.col("n_tokens") / 2)
    seg = spark.createDataFrame(segments, "sp array<string>, use int, source string, lo long, hi long")
    # bounded: at most 2^targets x repeats x targets rows
    drawn = middle.join(F.broadcast(seg), (F.col("pattern") == F.col("sp")) & (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi")))
    return drawn.select("source", F.expr("docs[source]").alias("doc_id"), "use", "n_tokens")


def mix_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, uses, documents) of each target, those without texts too."""
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.countDistinct("doc_id").alias("documents"))
    out = targets.select("source", "target_share").join(got, "source", "left").withColumn("total", F.sum("tokens").over(Window.partitionBy()))  # a row a target
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("source", "target_share", F.try_divide(F.coalesce("tokens", F.lit(0)), F.col("total")).alias("actual_share"), zero("tokens"), zero("uses"), zero("documents"))
