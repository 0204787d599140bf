"""A base index with rows added and deleted beside it.

    path/base        the index directory, a version for each compaction
    path/delta       added rows (epoch, id, embedding, batch): ids from DELTA_ID_OFFSET on
    path/tombstones  deleted ids (epoch, id)

All three are durable.  A compaction makes a new base version and raises the epoch; rows of older epochs no longer count.
Deleted rows are taken out before the best k are chosen, so deletions never starve a search.
Added rows are scanned exactly: they are few until the next compaction.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import DELTA_ID_OFFSET, metric
from ..plans import index as ix
from .beam import DeltaGraph
from .knn import BLOCK_BYTES, check_queries, completed, exact_knn, few_queries, rank_top_k
from .validate import VectorError, check_dim, check_vectors, matrix

#: Deleted ids that are sent to every task as a mask, at most: 8 MB.
MASKED = 1_000_000
_DELTA = "epoch int, id long, embedding array<float>, batch long"


@dataclass(frozen=True)
class IncrementalConfig:
    delta_threshold: int = 10_000
    tombstone_ratio: float = 0.1
    params: ix.IndexParams = ix.IndexParams()


# ---- relational steps, on any tables


#: Rows that one task numbers, about, and such ranges at most.
RANGE_ROWS, RANGES = 1 << 18, 1024


def assign_delta_ids(added: DataFrame, used: int, order: str = "id") -> DataFrame:
    """added with ids that follow `used` earlier ones, in order of a numeric column.

    Rows are cut into ranges by quantiles of the column, which are constants of the plan: however often and in whatever partitions a row is
    computed, its range is the same.  So counts of ranges and ranks within them agree, and no task orders all rows.
    """
    n = added.count()
    parts = min(RANGES, -(-n // RANGE_ROWS))
    cuts = sorted({int(c) for c in added.select(F.col(order).cast("double")).approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    place = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    ranged = added.withColumn("__range", place)
    counts = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()}  # RANGES rows at most
    before, total = [], 0
    for i in range(len(cuts) + 1):
        before.append(total)
        total += counts.get(i, 0)
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    first = F.element_at(F.lit(before), F.col("__range") + 1)
    return ranged.withColumn("__rank", rank).withColumn("id", (F.lit(DELTA_ID_OFFSET + used - 1) + first + F.col("__rank")).cast("long")).drop("__range", "__rank")


def live_rows(base: DataFrame, delta: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(id, embedding) of both, without deleted ids."""
    return base.select("id", "embedding").unionByName(delta.select("id", "embedding")).join(tombstones.select("id").distinct(), "id", "left_anti")


def merged_search(queries: DataFrame, base: DataFrame, delta: DataFrame, tombstones: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(qid, id, rank, dist) over the live rows."""
    return exact_knn(queries, live_rows(base, delta, tombstones), k, metric)


def stats(base: DataFrame, delta: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row: base, delta, tombstones (of ids that exist), live."""
    counts = base.select("id", F.lit("base").alias("kind")).unionByName(delta.select("id", F.lit("delta").alias("kind")))
    marked = counts.join(tombstones.select("id").distinct().withColumn("dead", F.lit(1)), "id", "left")
    n = lambda test: F.count(F.when(test, 1))
    return marked.agg(n(F.col("kind") == "base").alias("base"), n(F.col("kind") == "delta").alias("delta"), n(F.col("dead") == 1).alias("tombstones"), n(F.col("dead").isNull()).alias("live"))


def should_compact(counts: DataFrame, config: IncrementalConfig = IncrementalConfig()) -> DataFrame:
    """One row (compact): whether the delta is large or many rows are deleted, of stats' row."""
    share = F.col("tombstones") / F.greatest(F.col("base") + F.col("delta"), F.lit(1))
    return counts.select(((F.col("delta") >= config.delta_threshold) | (share >= config.tombstone_ratio)).alias("compact"))


def compacted_ids(base: DataFrame, delta: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(old_id, new_id): live rows numbered from 0, base before delta, each in order of id."""
    numbered = assign_delta_ids(live_rows(base, delta, tombstones).select("id", F.col("id").alias("old_id")), 0, "old_id")
    return numbered.select("old_id", (F.col("id") - F.lit(DELTA_ID_OFFSET)).alias("new_id"))


def deleted_flags(ids: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(id, deleted) of ids (id)."""
    marked = tombstones.select("id").distinct().withColumn("__dead", F.lit(True))
    return ids.select("id").join(marked, "id", "left").select("id", F.coalesce("__dead", F.lit(False)).alias("deleted"))


def vectors_of(ids: DataFrame, base: DataFrame, delta: DataFrame) -> DataFrame:
    """(id, embedding) of ids (id) in base or delta; unknown ids have no row."""
    return base.select("id", "embedding").unionByName(delta.select("id", "embedding")).join(ids.select("id").distinct(), "id", "left_semi")


def delta_graph_search(queries: DataFrame, delta: DataFrame, k: int, beam: int, metric_name: str = "l2", params: ix.IndexParams = ix.IndexParams(32, 64), batch: int = 1024, *, verify: bool = False) -> DataFrame:
    """(qid, id, rank, dist) by a graph that delta's rows are added to in batches, in order of id.

    A delta is compacted once it has `delta_threshold` rows; a hash of the id cuts a larger one into groups of that many, each with its graph.
    verify: whether a group's rows are checked, after the walk, against the k-th distance that it found, and what it missed is added.
    """
    m, threshold = metric(metric_name), IncrementalConfig().delta_threshold
    n, size = check_queries(queries)
    if not n or k < 1:
        return delta.sparkSession.createDataFrame([], "qid long, id long, rank int, dist double")
    if size > BLOCK_BYTES:
        raise VectorError("too many queries for a graph search of the delta; search exactly")
    shared, groups = delta.sparkSession.sparkContext.broadcast(few_queries(queries)), max(1, -(-delta.count() // threshold))

    def run(table):
        qids, q = shared.value
        table = table.sort_by("id").combine_chunks()
        ids, x = table["id"].to_numpy(), matrix(table["embedding"].combine_chunks())
        graph = DeltaGraph(x.shape[1], m, params.max_degree, params.build_beam_width, params.alpha, params.rule)
        for i in range(0, len(x), batch):
            graph.add(x[i : i + batch])
        at, d = graph.search(q, k, beam)
        if verify:
            at, d = completed(q, x, at, k, m)
        r, c = np.nonzero(at >= 0)
        return pa.table([pa.array(qids[r]), pa.array(ids[at[r, c]]), pa.array(d[r, c])], names=["qid", "id", "dist"])

    grouped = delta.select(F.col("id").cast("long").alias("id"), "embedding").groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)))
    return rank_top_k(grouped.applyInArrow(run, "qid long, id long, dist double"), k)


# ---- the durable object


class IncrementalIndex:
    def __init__(self, spark: SparkSession, path: str, dim: int, metric: str, config: IncrementalConfig):
        self.spark, self.path, self.dim, self.metric, self.config = spark, path, dim, metric, config

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "l2", config: IncrementalConfig = IncrementalConfig()) -> IncrementalIndex:
        base = ix.build_index(vectors.select("id", "embedding"), f"{path}/base", metric, config.params)
        made = cls(base.spark, path, base.dim, metric, config)
        made._state(1 if not made._has("state") else made.epoch + 1)
        return made

    @classmethod
    def empty(cls, spark: SparkSession, path: str, dim: int, metric: str = "l2", config: IncrementalConfig = IncrementalConfig()) -> IncrementalIndex:
        """Without a base, until the first compaction."""
        made = cls(spark, path, dim, metric, config)
        made._state(0)
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: IncrementalConfig = IncrementalConfig()) -> IncrementalIndex:
        row = spark.read.parquet(f"{path}/state").orderBy(F.desc("epoch")).first()
        return cls(spark, path, row["dim"], row["metric"], config)

    def _has(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _state(self, epoch: int) -> None:
        self.spark.createDataFrame([(epoch, self.dim, self.metric)], "epoch int, dim int, metric string").coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    @property
    def epoch(self) -> int:
        return self.spark.read.parquet(f"{self.path}/state").agg(F.max("epoch")).first()[0]

    def _rows(self, name: str, schema: str) -> DataFrame:
        if not self._has(name):
            return self.spark.createDataFrame([], schema).drop("epoch", "batch")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("epoch") == self.epoch).drop("epoch", "batch")

    @property
    def base(self) -> DataFrame:
        if not ix.exists(self.spark, f"{self.path}/base"):
            return self.spark.createDataFrame([], "id long, embedding array<float>")
        return ix.open_index(self.spark, f"{self.path}/base").nodes.select("id", "embedding")

    @property
    def delta(self) -> DataFrame:
        return self._rows("delta", _DELTA)

    @property
    def tombstones(self) -> DataFrame:
        return self._rows("tombstones", "epoch int, id long").distinct()

    def has_batch(self, batch: int) -> bool:
        """Whether rows of a numbered batch were added, in this epoch or an earlier one."""
        return self._has("delta") and self.spark.read.schema(_DELTA).parquet(f"{self.path}/delta").where(F.col("batch") == batch).limit(1).count() > 0

    def add(self, vectors: DataFrame, batch: int | None = None) -> DataFrame:
        """Adds vectors (id, embedding); gives (old_id, id) with the new ids.  No rows: nothing happens.

        batch: a number that is written with the rows, in the one write that adds them.
        """
        if not vectors.limit(1).count():
            return self.spark.createDataFrame([], "old_id long, id long")
        check_dim(check_vectors(vectors)[1], self.dim)
        used = (self.delta.agg(F.max("id")).first()[0] or DELTA_ID_OFFSET - 1) - DELTA_ID_OFFSET + 1
        named = assign_delta_ids(vectors.select(F.col("id").cast("long").alias("old_id"), F.col("embedding").cast("array<float>").alias("embedding")), used, "old_id")
        table = f"{self.path}/added-{uuid.uuid4().hex}"
        named.write.parquet(table)  # numbered once: what is returned is what is added
        named = self.spark.read.parquet(table)
        named.select(F.lit(self.epoch).alias("epoch"), "id", "embedding", F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.path}/delta")
        return named.select("old_id", "id")

    def delete(self, ids: DataFrame) -> None:
        """Marks ids (id) as deleted; again, or unknown ones, without effect."""
        known = self.base.select("id").unionByName(self.delta.select("id"))
        fresh = ids.select("id").distinct().join(known, "id", "left_semi").join(self.tombstones, "id", "left_anti")
        fresh.select(F.lit(self.epoch).alias("epoch"), F.col("id").cast("long").alias("id")).write.mode("append").parquet(f"{self.path}/tombstones")

    def is_deleted(self, ids: DataFrame) -> DataFrame:
        return deleted_flags(ids, self.tombstones)

    def vectors(self, ids: DataFrame, include_deleted: bool = False) -> DataFrame:
        rows = vectors_of(ids, self.base, self.delta)
        return rows if include_deleted else rows.join(self.tombstones, "id", "left_anti")

    def vector(self, i: int, include_deleted: bool = False) -> DataFrame:
        return self.vectors(self.spark.range(i, i + 1), include_deleted)

    def search(self, queries: DataFrame, k: int, beam: int | None = None) -> DataFrame:
        """(qid, id, rank, dist) over live rows; with a beam the base is searched by its graph, else exactly.

        Deleted rows are walked over but never returned; beyond MASKED of them, which calls for a compaction, the search is exact.
        """
        first = queries.select(F.size("q")).first()
        if first is not None:
            check_dim(first[0], self.dim)
        if beam is None or not ix.exists(self.spark, f"{self.path}/base"):
            return merged_search(queries, self.base, self.delta, self.tombstones, k, self.metric)
        dead, index = self.tombstones, ix.open_index(self.spark, f"{self.path}/base")
        if dead.count() > MASKED:
            return merged_search(queries, self.base, self.delta, dead, k, self.metric)
        live = exact_knn(queries, self.delta.join(dead, "id", "left_anti"), k, self.metric)
        near = ix.search_graph(index, queries, k, beam, without=dead)
        return rank_top_k(near.unionByName(live).select("qid", "id", "dist"), k)

    def stats(self) -> DataFrame:
        return stats(self.base, self.delta, self.tombstones)

    def should_compact(self) -> bool:
        return should_compact(self.stats(), self.config).first()["compact"]

    def compact(self) -> DataFrame:
        """Rewrites the live rows as a new base with ids from 0; gives (old_id, new_id).  Raises if no row lives."""
        live = live_rows(self.base, self.delta, self.tombstones)
        if not live.limit(1).count():
            raise VectorError("no live rows to compact")
        table = f"{self.path}/compacted-{uuid.uuid4().hex}"
        compacted_ids(self.base, self.delta, self.tombstones).write.parquet(table)
        ids = self.spark.read.parquet(table)
        named = live.join(ids, live["id"] == ids["old_id"]).select(F.col("new_id").alias("id"), "embedding")
        ix.build_index(named, f"{self.path}/base", self.metric, self.config.params)
        self._state(self.epoch + 1)
        return ids
