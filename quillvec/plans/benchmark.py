"""Benchmark drivers: build and search timings, beam sweeps, exact against graph search, rates of adding and deleting.

Each gives a DataFrame of figures.  A search is timed as a whole batch of queries, for Spark answers batches; percentiles are over
repeated batches, divided by the number of queries.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import DELTA_ID_OFFSET
from ..functions.evaluate import all_returned_k, last_distance_ratio, mean_fraction_returned, percentile, recall_by_distance, recall_by_ids
from ..operators.incremental import IncrementalConfig, IncrementalIndex
from ..operators.knn import exact_knn
from ..sources.store import size_of
from ..sources.vecs import generate, read_ground_truth, read_hdf5, read_vecs, truth_rows
from . import index as ix
from .charts import line_chart


def _timed(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def engine_info(spark: SparkSession) -> DataFrame:
    """One row: versions and cores that searches run with, and the vector instructions that this machine's array kernels use."""
    import numpy
    import pyarrow

    simd = ",".join(numpy.show_config(mode="dicts").get("SIMD Extensions", {}).get("found", []))
    row = (spark.version, numpy.__version__, pyarrow.__version__, spark.sparkContext.defaultParallelism, spark.sparkContext.master, simd)
    return spark.createDataFrame([row], "spark string, numpy string, pyarrow string, cores int, master string, simd string")


def run_benchmark(data: DataFrame, queries: DataFrame, path: str, *, k: int = 10, beams: tuple[int, ...] = (16, 64, 128), metric: str = "l2", params: ix.IndexParams = ix.IndexParams(), repeats: int = 3) -> DataFrame:
    """A row for each beam: build_seconds, beam, recall, qps, and percentiles of seconds a query."""
    spark = data.sparkSession
    began = time.perf_counter()
    index = ix.build_index(data, path, metric, params)
    built = time.perf_counter() - began
    n = queries.count()
    truth = exact_knn(queries, data, k, metric).cache()
    rows = []
    for beam in beams:
        search: Callable[[], DataFrame] = lambda beam=beam: ix.search(index, queries, k, beam, mode="graph")
        recall = recall_by_ids(search(), truth, k).first()["recall"]  # also the warm-up
        took = [_timed(search()) / max(n, 1) for _ in range(repeats)]
        times = spark.createDataFrame([(t,) for t in took], "t double")
        rows.append((built, beam, recall, len(took) / max(sum(took), 1e-12), *(percentile(times, "t", p).first()["value"] for p in (50, 95, 99))))
    truth.unpersist()
    return spark.createDataFrame(rows, "build_seconds double, beam int, recall double, qps double, p50 double, p95 double, p99 double")


def compare_with_exact(spark: SparkSession, path: str, sizes: tuple[int, ...] = (1_000, 5_000), dim: int = 32, n_queries: int = 50, *, k: int = 10, beam: int = 64, params: ix.IndexParams = ix.IndexParams(32, 64)) -> DataFrame:
    """A row for each size of generated data: seconds of building, of exact and of graph search, and the recall."""
    rows = []
    for n in sizes:
        data = generate(spark, n, dim, 42)
        queries = generate(spark, n_queries, dim, 123).select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
        began = time.perf_counter()
        index = ix.build_index(data, f"{path}/{n}", "l2", params)
        built = time.perf_counter() - began
        truth = exact_knn(queries, index.nodes, k)
        found = ix.search(index, queries, k, beam, mode="graph")
        rows.append((n, built, _timed(truth), _timed(found), recall_by_ids(found, truth, k).first()["recall"]))
    return spark.createDataFrame(rows, "n int, build_seconds double, exact_seconds double, graph_seconds double, recall double")


def run_incremental_benchmark(spark: SparkSession, path: str, base: int = 1_000, batches: int = 2, batch: int = 100, deletes: int = 50, dim: int = 32, config: IncrementalConfig = IncrementalConfig(params=ix.IndexParams(16, 32))) -> DataFrame:
    """A row for each phase: the rows it handled and its seconds."""
    index, rows = IncrementalIndex.build(generate(spark, base, dim, 42), path, config=config), []
    for i in range(batches):
        began = time.perf_counter()
        index.add(generate(spark, batch, dim, 1000 + i))
        rows.append(("add", batch, time.perf_counter() - began))
    queries = generate(spark, 100, dim, 123).select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    rows.append(("search", 100, _timed(index.search(queries, 10))))
    began = time.perf_counter()
    index.delete(spark.range(deletes).unionByName(spark.range(DELTA_ID_OFFSET, DELTA_ID_OFFSET + 10)))
    rows.append(("delete", deletes + 10, time.perf_counter() - began))
    rows.append(("search_after_delete", 100, _timed(index.search(queries, 10))))
    began = time.perf_counter()
    index.compact()
    rows.append(("compact", base + batches * batch - deletes - 10, time.perf_counter() - began))
    return spark.createDataFrame(rows, "phase string, n int, seconds double")


def build_times(spark: SparkSession, path: str, sizes: tuple[int, ...] = (10_000, 50_000, 100_000), dim: int = 128, *, params: ix.IndexParams = ix.IndexParams(32, 64)) -> DataFrame:
    """A row for each size of generated data: seconds of building, and rows a second."""
    rows = []
    for n in sizes:
        data = generate(spark, n, dim, 42)
        began = time.perf_counter()
        ix.build_index(data, f"{path}/{n}", "l2", params)
        took = time.perf_counter() - began
        rows.append((n, dim, took, n / took))
    return spark.createDataFrame(rows, "n int, dim int, build_seconds double, rows_per_second double")


#: Data sizes and dimensions of the benchmark matrix; the large ones take a cluster.
QUICK_CASES, LARGE_CASES = ((10_000, 128), (50_000, 128)), ((100_000, 128), (500_000, 128), (50_000, 768))


def bench_matrix(spark: SparkSession, path: str, *, large: bool = False, cases: tuple[tuple[int, int], ...] | None = None, n_queries: int = 1_000, beams: tuple[int, ...] = (64, 128, 256), params: ix.IndexParams = ix.IndexParams(32, 64)) -> DataFrame:
    """`run_benchmark` on generated data of each (rows, dim): the cases given, or the quick ones and perhaps the large ones."""
    out = None
    for n, dim in cases or (QUICK_CASES + LARGE_CASES if large else QUICK_CASES):
        queries = generate(spark, n_queries, dim, 123).select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
        one = run_benchmark(generate(spark, n, dim, 42), queries, f"{path}/{n}-{dim}", beams=beams, params=params, repeats=1)
        one = one.select(F.lit(n).alias("n"), F.lit(dim).alias("dim"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def memory_of_searches(index: ix.Index, queries: DataFrame, *, k: int = 10, beams: tuple[int, ...] = (32, 64, 128)) -> DataFrame:
    """A row for each beam: bytes of the index's files, and the most memory that a worker of its search has had, in bytes."""
    rows = []
    for beam in beams:

        def peak(batches):
            import resource

            import pyarrow as pa

            for _ in batches:
                pass
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024], pa.int64())], ["bytes"])

        found = ix.search(index, queries, k, beam, mode="graph").select("qid")
        rows.append((beam, size_of(index.table), found.mapInArrow(peak, "bytes long").agg(F.max("bytes")).first()[0]))
    return index.spark.createDataFrame(rows, "beam int, index_bytes long, worker_peak_bytes long")


def search_report(index: ix.Index, queries: DataFrame, truth: DataFrame, k: int, beam: int) -> DataFrame:
    """One row of a batch search against the truth (qid, id, rank, dist): recall by distance, fraction returned, last distance over the true one, whether all have k rows, and queries a second."""
    n = queries.count()
    found = ix.search(index, queries, k, beam, mode="graph")
    qps = n / max(_timed(found), 1e-9)
    near = F.round(F.col("dist"), 4).alias("dist")  # files hold single precision
    found, truth = (df.select("qid", "id", "rank", near) for df in (found, truth))
    row = recall_by_distance(found, truth, k).crossJoin(mean_fraction_returned(found, queries, k)).crossJoin(last_distance_ratio(found.where("dist > 0"), truth.where("dist > 0"), k)).crossJoin(all_returned_k(found, queries, index.rows, k))
    return row.withColumn("qps", F.lit(qps))  # of one row each


def file_benchmark(spark: SparkSession, base: str, queries: str, path: str, *, truth: tuple[str, str] | None = None, limit: int | None = None, metric: str = "l2", ks: tuple[int, ...] = (10, 100), beam: int = 512, params: ix.IndexParams = ix.IndexParams()) -> DataFrame:
    """A row for each k: `search_report` of the vectors of one file asked for by those of another, with the index at `path` built if it is not there.

    base, queries: .fvecs or .bvecs files.  truth: .ivecs of neighbours and .fvecs of squared distances; without it, exact search.  limit: rows of base.
    """
    kind = lambda name: name.rsplit(".", 1)[-1]
    index = ix.build_or_open(read_vecs(spark, base, kind(base), limit=limit), path, metric, params)
    asked = read_vecs(spark, queries, kind(queries)).select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    return _reports(index, asked, truth_rows(read_ground_truth(spark, *truth)) if truth else None, ks, beam)


def hdf5_benchmark(spark: SparkSession, file: str, path: str, *, metric: str = "l2", ks: tuple[int, ...] = (10,), beam: int = 384, params: ix.IndexParams = ix.IndexParams(48, 128)) -> DataFrame:
    """The same of a benchmark file with train, test, neighbors and (true) distances."""
    parts = read_hdf5(spark, file)
    index = ix.build_or_open(parts["train"], path, metric, params)
    both = parts["neighbors"].join(parts["distances"], "qid").select("qid", F.posexplode(F.arrays_zip("ids", "d")).alias("pos", "x"))
    truth = both.select("qid", F.col("x.ids").cast("long").alias("id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.d").cast("double").alias("dist"))
    return _reports(index, parts["test"], truth, ks, beam)


def _reports(index: ix.Index, asked: DataFrame, truth: DataFrame | None, ks: tuple[int, ...], beam: int) -> DataFrame:
    out = None
    for k in ks:
        one = search_report(index, asked, truth if truth is not None else exact_knn(asked, index.nodes, k, index.metric), k, max(beam, k)).select(F.lit(k).alias("k"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def write_charts(folder: str, **tables: DataFrame) -> dict[str, int]:
    """SVG files of what the drivers above give, by keyword: builds (n, build_seconds), beams (recall, qps), memory (beam, worker_peak_bytes), phases (n, seconds by phase); points by file."""
    shapes = {"builds": ("n", "build_seconds", None), "beams": ("recall", "qps", None), "memory": ("beam", "worker_peak_bytes", None), "phases": ("n", "seconds", "phase")}
    return {name: line_chart(df, f"{folder}/{name}.svg", x, y, series=series, title=name) for name, df in tables.items() for x, y, series in [shapes[name]]}
