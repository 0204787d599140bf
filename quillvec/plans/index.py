"""An index directory: node tables in versions, and a table of versions.

    path/nodes-<version>   a folder for each shard, with one file of id, embedding, neighbors, and the label columns, in order of id
    path/versions          one row for each finished build: the newest one counts

A build writes its nodes first and its version row last, so a build that was cut off is never opened.  Rows
go to shards by a hash of their id; each shard has its own graph, in one row group of one file, so that a scan gives a whole shard to one
task: searches walk shards where they are read, without a shuffle.  A row is looked up in its shard's file alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions.distance import Metric, metric
from ..functions.filters import Filter
from ..operators.beam import beam_search, filtered_search, padded_matrix
from ..operators.graph import build_shard
from ..operators.knn import BLOCK_BYTES, check_queries, completed, exact_knn, few_queries, packed_queries, rank_top_k, unpacked
from ..operators.validate import VectorError, check_dim, check_labels, check_vectors, matrix

#: Rows of a shard in expectation: as few as the first, for small tables to use all cores, and as many as the second, for large ones to have few files.
SHARD_ROWS, SHARD_ROWS_MOST = 8_192, 65_536


@dataclass(frozen=True)
class IndexParams:
    max_degree: int = 64
    build_beam_width: int = 128
    alpha: float = 1.2
    rule: str = "vamana"
    #: How candidates are found: `exact` in the shard, or by `search` of the growing graph.
    method: str = "exact"


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    metric: str
    dim: int
    rows: int
    shards: int
    params: IndexParams
    table: str

    @property
    def nodes(self) -> DataFrame:
        """shard, id, embedding, neighbors, is_start and label columns; a scan reads only what is used of them."""
        return self.spark.read.parquet(self.table)

    def _row(self, i: int) -> DataFrame:
        return self.nodes.where((F.col("shard") == _shard_of(F.lit(i).cast("long"), self.shards)) & (F.col("id") == i))

    def vector(self, i: int) -> DataFrame:
        """(id, embedding) of one row, or none."""
        return self._row(i).select("id", "embedding")

    def neighbors(self, i: int) -> DataFrame:
        return self._row(i).select("id", F.explode("neighbors").alias("neighbor"))

    def labels_of(self, ids: DataFrame, column: str = "labels") -> DataFrame:
        """(id, `column`) of ids (id); unknown ids have no row."""
        return self.nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id", column)

    def metadata(self) -> DataFrame:
        """One row: dim, num_vectors, max_degree, medoid_id, distance_name."""
        starts = self.nodes.where("is_start")
        from ..operators.graph import medoid

        one = medoid(starts.select("id", "embedding"), self.metric).select(F.col("id").alias("medoid_id"))
        return one.select(F.lit(self.dim).alias("dim"), F.lit(self.rows).cast("long").alias("num_vectors"), F.lit(self.params.max_degree).alias("max_degree"), "medoid_id", F.lit(self.metric).alias("distance_name"))

    def distance_to(self, queries: DataFrame, ids: DataFrame) -> DataFrame:
        """(qid, id, dist) for the pairs named by ids (qid, id)."""
        met = ids.join(self.nodes.select("id", "embedding"), "id").join(queries, "qid")
        return met.select("qid", "id", metric(self.metric).column(F.col("q"), F.col("embedding")).alias("dist"))


_VERSION = "version long, nodes string, metric string, dim int, rows long, shards int, max_degree int, build_beam_width int, alpha double, rule string, method string, fields int"


def _shard_of(i: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(i), F.lit(shards)).cast("int")


def build_index(vectors: DataFrame, path: str, metric_name: str = "l2", params: IndexParams = IndexParams()) -> Index:
    """Builds and writes an index over vectors (id, embedding, labels...), as a new version of the directory.

    Label columns keep their names; an array column `labels` must have as many in every row.
    """
    spark = vectors.sparkSession
    metric(metric_name)
    n, dim = check_vectors(vectors)
    if vectors.where("id is null").limit(1).count():
        raise VectorError("an id is null")
    fields = check_labels(vectors)[1] if _is_array(vectors, "labels") else None
    shards = max(-(-n // SHARD_ROWS_MOST), min(-(-n // SHARD_ROWS), 4 * spark.sparkContext.defaultParallelism), 1)
    placed = vectors.withColumn("id", F.col("id").cast("long")).withColumn("shard", _shard_of(F.col("id"), shards))
    extra = [f for f in vectors.schema.fields if f.name not in ("id", "embedding")]
    schema = StructType([StructField("shard", IntegerType()), StructField("id", LongType()), vectors.schema["embedding"], StructField("neighbors", ArrayType(LongType())), *extra])

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids = table["id"].to_numpy()
        near, start = build_shard(matrix(table["embedding"].combine_chunks()), params.max_degree, params.build_beam_width, params.alpha, metric_name, rule=params.rule, method=params.method)
        real = near >= 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32)), pa.array(ids[near[real]]))
        rest = [pa.array(np.arange(len(ids)) == start), pa.array(np.full(len(ids), len(ids), np.int32))]
        return pa.table([table["shard"], table["id"], table["embedding"], lists, *[table[f.name] for f in extra], *rest], names=[*schema.names, "is_start", "shard_rows"])

    made = placed.groupBy("shard").applyInArrow(build, StructType([*schema.fields]).add("is_start", "boolean").add("shard_rows", IntegerType()))
    table = f"{path}/nodes-{uuid.uuid4().hex}"
    made.write.option("parquet.block.size", 1 << 30).partitionBy("shard").parquet(table)
    last = _versions(spark, path)
    number = (last.agg(F.max("version")).first()[0] or 0) + 1 if last is not None else 1
    row = (number, table, metric_name, dim, n, shards, params.max_degree, params.build_beam_width, params.alpha, params.rule, params.method, fields)
    spark.createDataFrame([row], _VERSION).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return open_index(spark, path, metric_name)


def _is_array(df: DataFrame, column: str) -> bool:
    return column in df.columns and isinstance(df.schema[column].dataType, ArrayType)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(_VERSION).parquet(f"{path}/versions") if exists(spark, path) else None


def open_index(spark: SparkSession, path: str, metric_name: str | None = None, *, allow_metric_mismatch: bool = False, check: bool = True) -> Index:
    """The newest version; raises if it was built with another metric, unless that is allowed.

    check: whether to raise if rows, or labels of a row, are not as many as were built: a count of the files' footers, and a scan of
    the labels.
    """
    versions = _versions(spark, path)
    if versions is None:
        raise VectorError(f"no index at {path}")
    v = versions.orderBy(F.desc("version")).first()
    if metric_name not in (None, v["metric"]) and not allow_metric_mismatch:
        raise VectorError(f"the index was built with {v['metric']}, not {metric_name}")
    index = Index(spark, path, metric_name or v["metric"], v["dim"], v["rows"], v["shards"], IndexParams(v["max_degree"], v["build_beam_width"], v["alpha"], v["rule"], v["method"]), v["nodes"])
    if check:
        found = index.nodes.count()
        if found != v["rows"]:
            raise VectorError(f"the index was built with {v['rows']} rows and has {found}")
        if v["fields"] is not None and check_labels(index.nodes)[1] != v["fields"]:
            raise VectorError(f"the index was built with {v['fields']} labels a row")
    return index


def build_or_open(vectors: DataFrame, path: str, metric_name: str = "l2", params: IndexParams = IndexParams()) -> Index:
    spark = vectors.sparkSession
    return open_index(spark, path, metric_name) if exists(spark, path) else build_index(vectors, path, metric_name, params)


class _Shard:
    """A shard in arrays: rows in order of id, neighbours as places."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, near: np.ndarray, start: int, allowed: np.ndarray):
        self.ids, self.x, self.near, self.start, self.allowed = ids, x, near, start, allowed

    @classmethod
    def of(cls, batches: list[pa.RecordBatch]) -> _Shard:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, lists = table["id"].to_numpy(), table["neighbors"].combine_chunks()
        if len(ids) != table["shard_rows"][0].as_py():
            raise VectorError("a shard was split; its file must be one row group")
        sizes = lists.value_lengths().to_numpy()
        near = padded_matrix(np.split(np.searchsorted(ids, lists.flatten().to_numpy()), np.cumsum(sizes)[:-1]))
        start = int(np.flatnonzero(table["is_start"].to_numpy())[0])
        return cls(ids, matrix(table["embedding"].combine_chunks()), near, start, table["allowed"].to_numpy())

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, beam: int, m: Metric, verify: bool) -> pa.RecordBatch:
        if self.allowed.all():
            at, d = beam_search(q, self.x, self.near, self.start, beam, m)
            at, d = at[:, :k], d[:, :k]
        else:
            at, d = filtered_search(q, self.x, self.near, self.start, min(k, beam), beam, m, self.allowed)
        if verify:
            some = np.flatnonzero(self.allowed)
            at, d = completed(q, self.x[some], np.where(at >= 0, np.searchsorted(some, at), -1), k, m)
            at = np.where(at >= 0, some[at], -1) if len(some) else at
        r, c = np.nonzero(at >= 0)
        return pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(self.ids[at[r, c]]), pa.array(d[r, c])], ["qid", "id", "dist"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
    """The shards of a partition, whose rows follow one another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
            if a == b:
                continue
            if held and held[-1].column("shard")[0].as_py() != shard[a]:
                yield _Shard.of(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _Shard.of(held)


def search_graph(index: Index, queries: DataFrame, k: int, beam: int, where: Filter | Column | None = None, without: DataFrame | None = None, *, verify: bool = False) -> DataFrame:
    """(qid, id, rank, dist) by beam search in every shard; at most min(k, beam) rows of a shard for each query.

    verify: whether each shard's rows are checked, after the walk, against the k-th distance that it found, and what it missed is added:
    the result is then exact, and has min(k, rows) rows of each query.

    With a filter each shard walks over all its rows and keeps those that match: min(k, beam) of them, or all there are.  without: ids
    (id) that are not returned, sent to every task; the caller checks their number.
    """
    if beam < 1:
        raise VectorError("a beam has at least one row")
    m, kind = metric(index.metric), "qid long, id long, dist double"
    n, size = check_queries(queries, index.dim)
    if not n or k < 1:
        return index.spark.createDataFrame([], "qid long, id long, rank int, dist double")
    test = F.lit(True) if where is None else where.truth() if isinstance(where, Filter) else F.coalesce(where, F.lit(False))
    nodes = index.nodes
    if without is not None:
        nodes = nodes.join(F.broadcast(without.select("id").distinct().withColumn("__dead", F.lit(True))), "id", "left")
        test = test & F.col("__dead").isNull()
    nodes = nodes.select("shard", "id", "embedding", "neighbors", "is_start", "shard_rows", test.alias("allowed"))
    if size <= BLOCK_BYTES:
        shared = index.spark.sparkContext.broadcast(few_queries(queries))

        def walk(batches):
            for shard in _shards(batches):
                yield shard.search(*shared.value, k, beam, m, verify)

        return rank_top_k(nodes.mapInArrow(walk, kind), k)

    def pack(batches):
        for shard in _shards(batches):
            values = (shard.ids, shard.x, shard.near, np.array([shard.start]), shard.allowed)
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()]) for v in values], ["ids", "x", "near", "start", "allowed"])

    def meet(batches):
        for batch in batches:
            for ids, x, near, start, allowed, qids, q in zip(*(batch.column(c).to_pylist() for c in ("ids", "x", "near", "start", "allowed", "qids", "q")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                shard = _Shard(ids, np.frombuffer(x).reshape(len(ids), -1), np.frombuffer(near, np.int64).reshape(len(ids), -1), int(np.frombuffer(start, np.int64)[0]), np.frombuffer(allowed, bool))
                yield shard.search(*unpacked(qids, q), k, beam, m, verify)

    blocks = nodes.mapInArrow(pack, "ids binary, x binary, near binary, start binary, allowed binary").crossJoin(packed_queries(queries))  # shards and blocks
    return rank_top_k(blocks.mapInArrow(meet, kind), k)


#: Distances that an exact search may compute, and the share of matching rows under which a filter calls for one.
EXACT_WORK, EXACT_SHARE = 2_000_000_000, 0.05


def choose(index: Index, n_queries: int, share: float = 1.0) -> str:
    """`exact` where the work is small or few rows match, else `graph`."""
    return "exact" if n_queries * index.rows * share <= EXACT_WORK or share < EXACT_SHARE else "graph"


def search(index: Index, queries: DataFrame, k: int, beam: int = 128, where: Filter | Column | None = None, mode: str = "auto", verify: bool = False) -> DataFrame:
    """(qid, id, rank, dist); mode: exact, graph or auto; verify: see `search_graph`."""
    first = queries.select(F.size("q")).first()
    if first is not None:
        check_dim(first[0], index.dim)
    if mode == "auto":
        share = 1.0 if where is None else count_matching(index, where) / max(index.rows, 1)
        mode = choose(index, queries.count(), share)
    if mode == "exact":
        return exact_knn(queries, index.nodes, k, index.metric, where, dim=index.dim)
    return search_graph(index, queries, k, beam, where, verify=verify)


def count_matching(index: Index, where: Filter | Column) -> int:
    return index.nodes.where(where.column() if isinstance(where, Filter) else where).count()
