"""Exact nearest neighbours: a set of queries against all rows, in blocks.

Queries are few beside the data, as a rule: a set of bounded size goes to every task, and a larger one meets the rows in packed blocks.  A task
keeps the best k of each query over its rows with one matrix product for each batch, and only those reach the shuffle, where a window ranks
them.  Ties go to the smaller id.  A filter is applied to the rows first, so that the scan can push it down.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric
from ..functions.distance import metric as metric_named
from ..functions.filters import Filter
from .validate import VectorError, matrix

#: Bytes of queries sent to every task, and in a packed block; rows in a packed block; queries checked together, and pairs computed at once.
BLOCK_BYTES, PACK_BYTES, PACK_ROWS = 32 << 20, 1 << 20, 4096
CHECKED, AT_ONCE = 512, 1 << 16
#: Rows that meet a query together in the column path, about.
COLUMN_ROWS = 256


def select_k(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the best k of one query, best first, by distance and id."""
    if len(dist) > 4 * k:
        edge = np.partition(dist, k - 1)[k - 1]
        near = np.flatnonzero(dist <= edge)
        return near[np.lexsort((ids[near], dist[near]))[:k]]
    return np.lexsort((ids, dist))[:k]


def rank_top_k(hits: DataFrame, k: int) -> DataFrame:
    """(qid, id, rank, dist): the best k of each query of hits (qid, id, dist), partial ranks first."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("qid", "id", "rank", "dist")


def check_queries(queries: DataFrame, dim: int | None = None) -> tuple[int, int]:
    """(queries, bytes of their vectors); raises if sizes differ from `dim`, or from one another."""
    n, low, high = queries.agg(F.count("*"), F.min(F.size("q")), F.max(F.size("q"))).first()
    if n and (low != high or dim not in (None, high)):
        raise VectorError(f"queries have from {low} to {high} elements" + ("" if dim is None else f", the index {dim}"))
    return n, n * (high or 0) * 8


def packed_queries(queries: DataFrame) -> DataFrame:
    """(qids, q): runs of queries as 64-bit integers and rows of doubles, `PACK_BYTES` of vectors each at most."""

    def run(batches):
        for batch in batches:
            q, ids = matrix(batch.column("q"), "query"), batch.column("qid").to_numpy().astype("<i8")
            step = max(1, PACK_BYTES // max(8 * (q.shape[1] if len(q) else 1), 1))
            for i in range(0, len(ids), step):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i : i + step].tobytes()]), pa.array([q[i : i + step].tobytes()])], ["qids", "q"])

    return queries.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")).mapInArrow(run, "qids binary, q binary")


def unpacked(qids: bytes, q: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(qids, "<i8")
    return ids, np.frombuffer(q, np.float64).reshape(len(ids), -1)


def few_queries(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of queries whose size was checked, on the driver."""
    held = queries.select(F.col("qid").cast("long"), F.col("q").cast("array<double>")).toArrow().combine_chunks()
    return held["qid"].to_numpy(), matrix(held["q"].combine_chunks(), "query")


def rounding(q: np.ndarray, x: np.ndarray) -> float:
    """More than a kernel's product of these rows is off in its last digits."""
    scale = np.sqrt((q**2).sum(1).max(initial=0) + (x**2).sum(1).max(initial=0))
    return 1e-7 * (1 + scale) + 1e-12 * scale**2


def pair_distances(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, m: Metric) -> np.ndarray:
    """The distances of some pairs of a query and a row, computed one by one, so that equal rows tie."""
    return np.concatenate([np.zeros(0), *(m.pairs(q[r[i : i + AT_ONCE]], x[c[i : i + AT_ONCE]]) for i in range(0, len(r), AT_ONCE))])


def completed(q: np.ndarray, x: np.ndarray, found: np.ndarray, k: int, m: Metric) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the exact best min(k, rows) of x for each query, from the places that a walk found (-1: nothing).

    The k-th of what was found bounds what was missed: a product for a block of rows tells which rows are as near, and those alone
    are computed one by one.  So a walk that found all leaves nothing but the products.  Ties go to the smaller place.
    """
    k = min(k, len(x))
    places, dist = np.full((len(q), max(k, 0)), -1, np.int64), np.full((len(q), max(k, 0)), np.inf)
    if k < 1:
        return places, dist
    for low in range(0, len(q), CHECKED):
        part, bound = q[low : low + CHECKED], np.full(len(q[low : low + CHECKED]), np.inf)
        who, c = np.nonzero(found[low : low + CHECKED] >= 0)
        at = found[low : low + CHECKED][who, c]
        d = pair_distances(part, x, who, at, m)
        for first in range(0, len(x), PACK_ROWS):
            order = np.lexsort((at, d, who))
            rank = np.arange(len(who)) - np.searchsorted(who[order], who[order])
            bound[who[order][rank == k - 1]] = d[order][rank == k - 1]
            who, at, d = (v[order][rank < k] for v in (who, at, d))
            rows = x[first : first + PACK_ROWS]
            near = m.kernel(part, rows) <= (bound + rounding(part, rows))[:, None]
            known = (at >= first) & (at < first + len(rows))
            near[who[known], at[known] - first] = False
            r, c = np.nonzero(near)
            who, at, d = (np.concatenate(v) for v in ((who, r), (at, c + first), (d, pair_distances(part, rows, r, c, m))))
        order = np.lexsort((at, d, who))
        rank = np.arange(len(who)) - np.searchsorted(who[order], who[order])
        order, rank = order[rank < k], rank[rank < k]
        places[low + who[order], rank], dist[low + who[order], rank] = at[order], d[order]
    return places, dist


class Best:
    """The best k of each of some queries so far."""

    def __init__(self, n: int, k: int):
        self.k, self.dist, self.ids = k, np.full((n, 0), np.inf), np.zeros((n, 0), np.int64)

    def add(self, dist: np.ndarray, ids: np.ndarray) -> None:
        """dist: (queries, rows)."""
        keep = np.stack([select_k(d, ids, self.k) for d in dist]) if len(ids) > 4 * self.k else np.broadcast_to(np.arange(len(ids)), dist.shape)
        d = np.concatenate([self.dist, np.take_along_axis(dist, keep, 1)], 1)
        i = np.concatenate([self.ids, ids[keep]], 1)
        order = np.lexsort((i, d), axis=1)[:, : self.k]
        self.dist, self.ids = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

    def rows(self, qids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, self.ids.shape[1])), pa.array(self.ids.ravel()), pa.array(self.dist.ravel())], ["qid", "id", "dist"])


def best_of_blocks(queries: DataFrame, rows: DataFrame, k: int, distances: Callable[[np.ndarray, np.ndarray], np.ndarray], column: str) -> DataFrame:
    """(qid, id, rank, dist): the best k rows (id, `column`) of each query by distances(queries, rows).

    A set of queries of BLOCK_BYTES at most goes to every task, which scans its rows once.  A larger one is packed into
    blocks, as are the rows, and every block of the one meets every block of the other in tasks: nothing of either is gathered on the driver.
    """
    kind = "qid long, id long, dist double"
    n, size = check_queries(queries)
    if not n or k < 1:
        return rows.sparkSession.createDataFrame([], "qid long, id long, rank int, dist double")
    if size <= BLOCK_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast(few_queries(queries))

        def scan(batches):
            qids, q = shared.value
            best = Best(len(q), k)
            for batch in batches:
                if batch.num_rows:
                    best.add(distances(q, matrix(batch.column(column))), batch.column("id").to_numpy())
            if best.ids.shape[1]:
                yield best.rows(qids)

        return rank_top_k(rows.select("id", column).mapInArrow(scan, kind), k)

    def pack(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(i, PACK_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().astype("<i8").tobytes()]), pa.array([matrix(part.column(column)).tobytes()])], ["ids", "x"])

    def meet(batches):
        for batch in batches:
            for ids, x, qids, q in zip(*(batch.column(c).to_pylist() for c in ("ids", "x", "qids", "q")), strict=True):
                own, q = unpacked(qids, q)
                best = Best(len(q), k)
                best.add(distances(q, np.frombuffer(x, np.float64).reshape(len(ids) // 8, -1)), np.frombuffer(ids, "<i8"))
                yield best.rows(own)

    blocks = rows.select("id", column).mapInArrow(pack, "ids binary, x binary").crossJoin(packed_queries(queries))  # of packed blocks
    return rank_top_k(blocks.mapInArrow(meet, kind), k)


def exact_knn(queries: DataFrame, data: DataFrame, k: int, metric: str = "l2", where: Filter | Column | None = None, *, dim: int | None = None) -> DataFrame:
    """(qid, id, rank, dist) of the nearest min(k, rows) rows of data (id, embedding) to each of queries (qid, q)."""
    m = metric_named(metric)
    if isinstance(where, Filter):
        where = where.column()
    rows = (data if where is None else data.where(where)).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    if dim is not None:
        check_queries(queries, dim)

    def distances(q, x):
        if x.shape[1] != q.shape[1]:
            raise VectorError(f"queries have {q.shape[1]} elements, rows {x.shape[1]}")
        d = m.kernel(q, x)
        if len(x) > 4 * k:  # a product is off in its last digits: the few that can be among the best k are computed one by one, so that equal rows tie
            near = d <= (np.partition(d, k - 1, axis=1)[:, k - 1] + rounding(q, x))[:, None]
        else:
            near = np.ones(d.shape, bool)
        r, c = np.nonzero(near)
        d[r, c] = pair_distances(q, x, r, c, m)
        return d

    return best_of_blocks(queries, rows, k, distances, "embedding")


def pairwise_knn(queries: DataFrame, data: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The same by column expressions alone, for any number of queries: the reference path of the tests.

    Rows meet a query in packs, of which the best k are kept, so neither a row for each pair is made nor are all pairs ordered.  Queries
    are broadcast up to BLOCK_BYTES.
    """
    size = check_queries(queries)[1]
    asked = queries.select("qid", F.col("q").cast("array<double>").alias("q"))
    packs = max(1, -(-data.count() // COLUMN_ROWS))
    rows = data.select("id", F.struct("id", F.col("embedding").cast("array<double>").alias("e")).alias("row"))
    packed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(packs)).alias("pack")).agg(F.collect_list("row").alias("rows"))
    met = packed.select("rows").repartition(max(1, min(packs, 4 * data.sparkSession.sparkContext.defaultParallelism))).crossJoin(F.broadcast(asked) if size <= BLOCK_BYTES else asked)
    dist = F.transform("rows", lambda r: F.struct(metric_named(metric).column(F.col("q"), r["e"]).alias("dist"), r["id"].alias("id")))
    hits = met.select("qid", F.explode(F.slice(F.sort_array(dist), 1, k)).alias("hit"))
    return rank_top_k(hits.select("qid", "hit.id", "hit.dist"), k)
