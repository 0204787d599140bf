"""Proximity graphs: medoid, bootstrap, candidate pools, pruning, symmetrization, and a whole build.

The relational steps are DataFrame operations on edges (src, dst, dist).  A large table is cut into shards of bounded size; each gets
its own graph in one task with array kernels, all shards in parallel, and searches merge shards.

Two pruning rules.  `vamana`, the published one, drops a candidate c once a selected s has alpha * d(c, s) <= d(u, c);
`strict` drops it once d(c, s) < alpha * d(u, c), so that a larger alpha drops more.  Dropped candidates then fill the list,
nearest first, up to the degree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.distance import Metric, metric
from .validate import matrix

# ---- relational steps


#: Bytes of centroids sent to every task, at most; more are joined.
CENTROID_BYTES = 32 << 20


def _means(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centroid): tasks add up whole vectors by key, so that only a row for each task and key is shuffled."""
    fields = [vectors.schema[k] for k in keys]
    schema = StructType([*fields, StructField("n", LongType()), StructField("sums", ArrayType(DoubleType()))])

    def run(batches):
        held: dict[tuple, list] = {}

        def flush():
            rows = list(held.items())
            names = [pa.array([k[i] for k, _ in rows], batch.schema.field(f.name).type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*names, pa.array([n for _, (n, _) in rows], pa.int64()), pa.array([s for _, (_, s) in rows], pa.list_(pa.float64()))], schema.names)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            if not keys:
                parts = [((), np.arange(len(x)))]
            else:
                own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
                kinds = {k: i for i, k in enumerate(dict.fromkeys(own))}
                code = np.array([kinds[k] for k in own])
                order = np.argsort(code, kind="stable")
                parts = list(zip(kinds, np.split(order, np.flatnonzero(np.diff(code[order])) + 1), strict=True))
            for key, at in parts:
                n, total = held.get(key, (0, 0.0))
                held[key] = (n + len(at), total + x[at].sum(0))
            if len(held) > 4096:
                yield from flush()
        if held:
            yield from flush()

    partial = vectors.select(*keys, "embedding").mapInArrow(run, schema).select(*keys, "n", F.posexplode("sums").alias("pos", "x"))
    each = partial.groupBy(*keys, "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def centroid(vectors: DataFrame) -> DataFrame:
    """One row (centroid): the mean of each element over all vectors."""
    return _means(vectors, [])


def medoid(vectors: DataFrame, metric_name: str = "l2", by: str | None = None) -> DataFrame:
    """(id, dist), the vector nearest to the centroid of all, or one row for each value of `by`; ties go to the smaller id."""
    keys = [by] if by else []
    centre = _means(vectors, keys)
    if by:
        dim, n = centre.agg(F.max(F.size("centroid")), F.count("*")).first()
        met = vectors.join(F.broadcast(centre) if n * ((dim or 0) * 8 + 64) <= CENTROID_BYTES else centre, by)
    else:
        met = vectors.join(F.broadcast(centre), F.lit(True))  # one row
    dist = metric(metric_name).column(F.col("embedding"), F.col("centroid"))
    return met.groupBy(*keys).agg(F.min(F.struct(dist.alias("dist"), F.col("id").alias("id"))).alias("m")).select(*keys, "m.id", "m.dist")


def hashed_choice(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the parts alone; the same in any engine with md5."""
    text = F.concat_ws(":", F.lit(f"s{seed}"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def bootstrap(ids: DataFrame, degree: int, seed: int = 42) -> DataFrame:
    """(src, dst): about degree / 2 distinct neighbours, at least 2 where there are so many, for ids that run from 0 to n - 1."""
    n = ids.count()
    want = min(max(degree // 2, 2), max(n - 1, 0))
    draws = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(max(3 * want - 1, 0)))).alias("draw"))
    picked = draws.select("src", "draw", (hashed_choice(seed, F.col("src"), F.col("draw")) % max(n, 1)).alias("dst")).where("src <> dst")
    first = picked.groupBy("src", "dst").agg(F.min("draw").alias("draw"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("draw"))
    return first.withColumn("r", rank).where(F.col("r") <= want).select("src", "dst")


def nearest_candidates(edges: DataFrame) -> DataFrame:
    """Each (src, dst) once, with its least distance."""
    return edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def alpha_prune(pools: DataFrame, degree: int, alpha: float = 1.2, metric_name: str = "l2", *, fill: bool = True, rule: str = "vamana") -> DataFrame:
    """(src, neighbors): pools has one row for each candidate: src, dst, dist and dst's vector `embedding`."""
    distance = metric(metric_name).column
    grouped = pools.where("src <> dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", F.col("dst").alias("id"), F.col("embedding").alias("v")))).alias("pool"))

    def hidden(x: Column, y: Column) -> Column:
        between = distance(y["v"], x["v"])
        return between < alpha * x["dist"] if rule == "strict" else alpha * between <= x["dist"]

    kept = F.aggregate(
        "pool",
        F.filter("pool", lambda x: F.lit(False)),
        lambda acc, x: F.when((F.size(acc) >= degree) | F.exists(acc, lambda y: hidden(x, y)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    chosen = grouped.select("src", "pool", F.transform(kept, lambda x: x["id"]).alias("kept"))
    rest = F.filter(F.transform("pool", lambda x: x["id"]), lambda i: ~F.array_contains("kept", i))
    return chosen.select("src", F.slice(F.concat("kept", rest) if fill else F.col("kept"), 1, degree).alias("neighbors"))


def edges_of(nodes: DataFrame) -> DataFrame:
    """(src, dst) of nodes (id, neighbors)."""
    return nodes.select(F.col("id").alias("src"), F.explode("neighbors").alias("dst"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, each once, without loops."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").unionByName(back).where("src <> dst").distinct()


def in_degree(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n) of every id, 0 included."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return ids.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def csr_offsets(degrees: DataFrame) -> DataFrame:
    """(id, start): how many edges come before each id in an array ordered by id, of degrees (id, n).

    Sums go by buckets of ids first, so that no task orders all of them.
    """
    bucketed = degrees.withColumn("bucket", F.floor(F.col("id") / 65536))
    totals = bucketed.groupBy("bucket").agg(F.sum("n").alias("all"))
    before = totals.withColumn("base", F.coalesce(F.sum("all").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bucketed.withColumn("within", within).join(before, "bucket").select("id", (F.col("base") + F.col("within")).cast("long").alias("start"))


def padded(neighbors: Column | str, degree: int, pad: int = 0xFFFFFFFF) -> Column:
    """A list of exactly `degree` neighbours: cut, or filled up with the pad value."""
    own = F.slice(neighbors, 1, degree)
    return F.concat(own, F.array_repeat(F.lit(pad).cast("long"), F.lit(degree) - F.size(own)))


# ---- array kernels, for one shard


#: Bytes of distances between candidates that are held at once.
AMONG_BYTES = 64 << 20


def pruned(to_node: np.ndarray, among: np.ndarray, degree: int, alpha: float, *, rule: str = "vamana", fill: bool = True) -> np.ndarray:
    """Places of the chosen candidates, a row for each node, filled up with -1.

    to_node: (nodes, candidates), their ascending distances from the node, infinite beyond the last.  among: (nodes, candidates, candidates).
    """
    rows, wide = to_node.shape
    out, count = np.full((rows, degree), -1, np.int64), np.zeros(rows, np.int64)
    real = np.isfinite(to_node)
    open_, kept = real.copy(), np.zeros(to_node.shape, bool)
    for i in range(wide):
        take = np.flatnonzero(open_[:, i] & (count < degree))
        if not len(take):
            continue
        out[take, count[take]] = i
        count[take] += 1
        kept[take, i] = True
        between, own = among[take, i, i + 1 :], to_node[take, i + 1 :]
        open_[take, i + 1 :] &= ~(between < alpha * own if rule == "strict" else alpha * between <= own)
    if fill:
        rest = real & ~kept
        place = count[:, None] + rest.cumsum(1) - 1
        r, c = np.nonzero(rest & (place < degree))
        out[r, place[r, c]] = c
    return out


def prune_pool(to_node: np.ndarray, among: np.ndarray, degree: int, alpha: float, *, rule: str = "vamana", fill: bool = True) -> np.ndarray:
    """The same for one node."""
    out = pruned(to_node[None], among[None], degree, alpha, rule=rule, fill=fill)[0]
    return out[out >= 0]


def chosen_neighbors(nodes: np.ndarray, pool: np.ndarray, x: np.ndarray, degree: int, alpha: float, m: Metric, *, rule: str = "vamana", fill: bool = True) -> np.ndarray:
    """(nodes, degree) places, filled up with -1: of each row of `pool`, places with -1 for none, counted once and without the node, the pruned ones."""
    out = np.full((len(nodes), degree), -1, np.int64)
    if not pool.size:
        return out
    step = max(1, AMONG_BYTES // (8 * pool.shape[1] ** 2))
    for low in range(0, len(nodes), step):
        own, c = nodes[low : low + step], np.sort(pool[low : low + step], axis=1)
        none = (c < 0) | (c == own[:, None])
        none[:, 1:] |= c[:, 1:] == c[:, :-1]
        d = np.full(c.shape, np.inf)
        r, k = np.nonzero(~none)
        d[r, k] = m.pairs(x[own[r]], x[c[r, k]])
        order = np.argsort(d, axis=1, kind="stable")[:, : max(int((~none).sum(1).max()), 1)]  # ties go to the smaller place
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        rows = x[np.maximum(c, 0)]
        at = pruned(d, m.kernel(rows, rows), degree, alpha, rule=rule, fill=fill)
        out[low : low + step] = np.where(at >= 0, np.take_along_axis(c, np.maximum(at, 0), 1), -1)
    return out


def linked_back(near: np.ndarray, x: np.ndarray, degree: int, alpha: float, m: Metric, *, rule: str = "vamana") -> np.ndarray:
    """The graph with all links in both directions; lists of more than `degree` are pruned."""
    from .beam import padded_matrix

    n = len(near)
    src, k = np.nonzero(near >= 0)
    dst = near[src, k]
    both = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    src, dst = both // max(n, 1), both % max(n, 1)
    sizes = np.bincount(src, minlength=n)
    begins = np.cumsum(sizes) - sizes
    out = np.full((n, degree), -1, np.int64)
    few = sizes[src] <= degree
    out[src[few], np.arange(len(src))[few] - begins[src[few]]] = dst[few]
    full = np.flatnonzero(sizes > degree)
    full = full[np.argsort(sizes[full], kind="stable")]  # lists of like lengths together
    for low in range(0, len(full), 1024):
        own = full[low : low + 1024]
        pool = padded_matrix([dst[begins[u] : begins[u] + sizes[u]] for u in own])
        out[own] = chosen_neighbors(own, pool, x, degree, alpha, m, rule=rule)
    return out


def _near_and_far(x: np.ndarray, degree: int, pool: int, alpha: float, m: Metric, rule: str, random: np.random.Generator) -> np.ndarray:
    """Candidates of a node are its `pool` nearest rows, found exactly block by block, and random rows for long links."""
    n = len(x)
    near = np.full((n, degree), -1, np.int64)
    wide = min(pool, n - 1)
    for first in range(0, n, 512):
        own = np.arange(first, min(first + 512, n))
        d = m.kernel(x[own], x)
        d[np.arange(len(own)), own] = np.inf
        best = np.argpartition(d, wide - 1, axis=1)[:, :wide] if wide else np.zeros((len(own), 0), np.int64)
        far = random.integers(0, n, (len(own), max(degree // 4, 1)))
        near[own] = chosen_neighbors(own, np.concatenate([best, far], 1), x, degree, alpha, m, rule=rule)
    return linked_back(near, x, degree, alpha, m, rule=rule)


def _by_search(x: np.ndarray, start: int, degree: int, pool: int, alpha: float, m: Metric, rule: str, random: np.random.Generator, passes: int = 2, seeds: int = 2) -> np.ndarray:
    """From a random graph: in each pass every node searches the graph of the pass before, from the medoid and from random nodes, and prunes what it met."""
    from .beam import beam_search

    n, own = len(x), np.arange(len(x))
    want = min(max(degree // 2, 2), n - 1, degree)
    near = np.full((n, degree), -1, np.int64)
    if want:
        near[:, :want] = (own[:, None] + np.stack([random.choice(n - 1, want, replace=False) + 1 for _ in range(n)])) % n
    for _ in range(passes):
        met = [beam_search(x, x, near, s, pool, m)[0] for s in [np.full(n, start), *(random.integers(0, n, n) for _ in range(seeds))]]
        near = linked_back(chosen_neighbors(own, np.concatenate([near, *met], 1), x, degree, alpha, m, rule=rule), x, degree, alpha, m, rule=rule)
    return near


def build_shard(x: np.ndarray, degree: int, pool: int, alpha: float, metric_name: str, *, rule: str = "vamana", method: str = "exact", seed: int = 42) -> tuple[np.ndarray, int]:
    """(neighbours of each row, filled up with -1; place of the medoid) of one shard.

    method: `search` finds candidates by two passes of beam searches from a random graph; `exact` compares all rows of the shard, which for
    shards of a bounded size is one matrix product a block, and adds random rows.
    """
    m, random = metric(metric_name), np.random.default_rng(seed)
    if not len(x):
        return np.zeros((0, degree), np.int64), 0
    start = int(np.argmin(m.kernel(x.mean(0, keepdims=True), x)[0]))
    if method == "search":
        return _by_search(x, start, degree, pool, alpha, m, rule, random), start
    return _near_and_far(x, degree, pool, alpha, m, rule, random), start
