"""Vector benchmark files and generated vectors.

.fvecs, .ivecs and .bvecs files are records of a little-endian 32-bit dimension and as many floats, integers or
bytes.  Tasks read runs of records as arrays; a file is named by a URI or a path that every machine can open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import VectorError
from . import store

_KINDS = {"fvecs": ("<f4", pa.float32(), "array<float>"), "ivecs": ("<u4", pa.int64(), "array<long>"), "bvecs": ("u1", pa.float32(), "array<float>")}
#: Bytes that a task reads at once, about.
RUN_BYTES = 4 << 20


def lists_of(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list array."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()).cast(kind))


def runs(spark: SparkSession, n: int, bytes_each: int) -> tuple[DataFrame, int]:
    """(first) of runs of n records, a row each, and the records of a run."""
    step = max(1, RUN_BYTES // max(bytes_each, 1))
    return spark.range(0, n, step).withColumnRenamed("id", "first"), step


def read_vecs(spark: SparkSession, path: str, kind: str, *, limit: int | None = None) -> DataFrame:
    """(id, embedding) of a file, in file order from 0; limit: the first so many rows, of which no others are read.  bvecs become floats."""
    dtype, element, column = _KINDS[kind]
    total = store.size_of(path)
    with store.reader(path) as f:
        head = f.read(4)
    if len(head) < 4:
        raise VectorError(f"{path} has no record")
    dim = struct.unpack("<I", head)[0]
    size = 4 + np.dtype(dtype).itemsize * dim
    if total % size:
        raise VectorError(f"{path} is not of records of {dim} elements")
    n = total // size if limit is None else min(limit, total // size)
    starts, step = runs(spark, n, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with store.reader(path) as f:
            for batch in batches:
                for first in batch.column("first").to_pylist():
                    m = min(step, n - first)
                    records = np.frombuffer(f.read_at(m * size, first * size), np.dtype([("dim", "<u4"), ("x", dtype, (dim,))]))
                    if (records["dim"] != dim).any():
                        raise VectorError(f"a record from {first} on is not of {dim} elements")
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + m)), lists_of(records["x"], element)], ["id", "embedding"])

    return starts.mapInArrow(run, f"id long, embedding {column}")


def write_vecs(vectors: DataFrame, path: str, kind: str) -> None:
    """One file of vectors (id, embedding) in order of id, streamed partition by partition: for tests and exchange."""
    dtype, _, _ = _KINDS[kind]
    with store.writer(path) as out:
        for r in vectors.orderBy("id").select("embedding").toLocalIterator():
            x = np.asarray(r["embedding"])
            out.write(struct.pack("<I", len(x)) + x.astype(dtype).tobytes())


def read_ground_truth(spark: SparkSession, ids_path: str, dists_path: str, limit: int | None = None) -> DataFrame:
    """(qid, ids, sqdist) of an .ivecs file of neighbours and an .fvecs file of squared distances."""
    ids = read_vecs(spark, ids_path, "ivecs", limit=limit).select(F.col("id").alias("qid"), F.col("embedding").alias("ids"))
    dists = read_vecs(spark, dists_path, "fvecs", limit=limit).select(F.col("id").alias("qid"), F.col("embedding").alias("sqdist"))
    return ids.join(dists, "qid")


def truth_rows(truth: DataFrame) -> DataFrame:
    """(qid, id, rank, dist) of read_ground_truth's rows, with true distances."""
    each = truth.select("qid", F.posexplode(F.arrays_zip("ids", "sqdist")).alias("pos", "x"))
    return each.select("qid", F.col("x.ids").alias("id"), (F.col("pos") + 1).cast("int").alias("rank"), F.sqrt(F.col("x.sqdist").cast("double")).alias("dist"))


def read_hdf5(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """train, test, neighbors and distances of a benchmark file, read by tasks in runs of rows; needs the optional h5py, and a path of a mounted file system."""
    try:
        import h5py
    except ImportError as e:
        raise VectorError("h5py is not installed") from e
    kinds = {"train": ("id", "embedding", "float", pa.float32()), "test": ("qid", "q", "float", pa.float32()), "neighbors": ("qid", "ids", "int", pa.int32()), "distances": ("qid", "d", "float", pa.float32())}
    with h5py.File(path, "r") as f:
        if missing := [name for name in kinds if name not in f]:
            raise VectorError(f"{path} has no {', '.join(missing)}")
        shapes = {name: f[name].shape for name in kinds}

    def part(name: str) -> DataFrame:
        key, column, element, arrow = kinds[name]
        n, dim = shapes[name]
        starts, step = runs(spark, n, 4 * dim)

        def run(batches):
            import h5py

            with h5py.File(path, "r") as f:
                for batch in batches:
                    for first in batch.column("first").to_pylist():
                        x = np.asarray(f[name][first : min(first + step, n)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x))), lists_of(x, arrow)], [key, column])

        return starts.mapInArrow(run, f"{key} long, {column} array<{element}>")

    return {name: part(name) for name in kinds}


def generate(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """(id, embedding): n vectors uniform in [0, 1), the same for the same seed in any partitioning."""
    unit = lambda j: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), j), F.lit(1 << 24)) / (1 << 24)
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), unit).cast("array<float>").alias("embedding"))
