"""Single-file formats of a memory-mapped vector index, its label file and its quantizer file: import and export.

All numbers are little-endian.  Fixed values: an index file has a 64-bit length and that many bytes of metadata, then at 1 MiB the
vectors as 32-bit floats and the adjacency as rows of 32-bit ids padded with 0xFFFFFFFF.  Metadata: dim, vectors, degree
(64-bit), medoid (32-bit), two offsets (64-bit), and the metric's name (64-bit length and UTF-8).  A label file has a
64-bit length, the numbers of vectors and fields (64-bit), then 64-bit labels.  A quantizer file has dim, M, K and dim / M
(64-bit), a 64-bit count, and 32-bit centroid elements.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pq import Quantizer
from ..operators.validate import VectorError, check_labels
from . import store
from .vecs import lists_of, runs

GAP, PAD = 1 << 20, 0xFFFFFFFF


def _metadata(data: bytes) -> dict:
    dim, n, degree, medoid, vectors, adjacency, size = struct.unpack_from("<QQQIQQQ", data)
    name = data[struct.calcsize("<QQQIQQQ") :][:size].decode()
    return {"dim": dim, "num_vectors": n, "max_degree": degree, "medoid_id": medoid, "vectors_offset": vectors, "adjacency_offset": adjacency, "distance_name": name}


def read_index_metadata(path: str) -> dict:
    with store.reader(path) as f:
        head = f.read(8)
        if len(head) < 8:
            raise VectorError(f"{path} is no index file")
        return _metadata(f.read(struct.unpack("<Q", head)[0]))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding, neighbors): tasks read runs of rows; the file must be readable on every machine under one name."""
    meta = read_index_metadata(path)
    n, dim, degree = meta["num_vectors"], meta["dim"], meta["max_degree"]
    starts, step = runs(spark, n, 4 * (dim + degree))

    def run(batches):
        with store.reader(path) as f:
            for batch in batches:
                for first in batch.column("first").to_pylist():
                    m = min(step, n - first)
                    x = np.frombuffer(f.read_at(m * dim * 4, meta["vectors_offset"] + first * dim * 4), "<f4").reshape(m, dim)
                    near = np.frombuffer(f.read_at(m * degree * 4, meta["adjacency_offset"] + first * degree * 4), "<u4").reshape(m, degree)
                    real = near != PAD
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32)), pa.array(near[real].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + m)), lists_of(x, pa.float32()), lists], ["id", "embedding", "neighbors"])

    return starts.mapInArrow(run, "id long, embedding array<float>, neighbors array<long>")


def write_index(nodes: DataFrame, path: str, metric: str, medoid_id: int, max_degree: int) -> None:
    """One file of nodes (id from 0, embedding, neighbors), streamed in order of id, twice: vectors, then adjacency."""
    n, dim = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    name = metric.encode()
    meta = struct.pack("<QQQIQQQ", dim, n, max_degree, medoid_id, GAP, GAP + n * dim * 4, len(name)) + name
    with store.writer(path) as f:
        f.write((struct.pack("<Q", len(meta)) + meta).ljust(GAP, b"\0"))
        for r in nodes.orderBy("id").select("embedding").toLocalIterator():
            f.write(np.asarray(r["embedding"], "<f4").tobytes())
        for r in nodes.orderBy("id").select("neighbors").toLocalIterator():
            near = r["neighbors"][:max_degree]
            f.write(np.array(near + [PAD] * (max_degree - len(near)), "<u4").tobytes())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, labels), read by tasks in runs of rows; labels of 2**63 and more are refused."""
    with store.reader(path) as f:
        head = f.read(24)
    if len(head) < 24:
        raise VectorError(f"{path} is no label file")
    _, n, fields = struct.unpack("<QQQ", head)
    if store.size_of(path) != 24 + 8 * n * fields:
        raise VectorError(f"{path} does not have {n} rows of {fields} labels")
    starts, step = runs(spark, n, 8 * fields)

    def run(batches):
        with store.reader(path) as f:
            for batch in batches:
                for first in batch.column("first").to_pylist():
                    m = min(step, n - first)
                    values = np.frombuffer(f.read_at(m * fields * 8, 24 + first * fields * 8), "<u8").reshape(m, fields)
                    if values.size and values.max() >= 1 << 63:
                        raise VectorError("a label exceeds 63 bits")
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + m)), lists_of(values.astype(np.int64), pa.int64())], ["id", "labels"])

    return starts.mapInArrow(run, "id long, labels array<long>")


def write_labels(labels: DataFrame, path: str) -> None:
    """One file of labels (id from 0, labels), streamed in order of id."""
    n, fields = check_labels(labels)
    with store.writer(path) as f:
        f.write(struct.pack("<QQQ", 16, n, fields))
        for r in labels.orderBy("id").toLocalIterator():
            f.write(np.asarray(r["labels"], "<u8").tobytes())


def read_quantizer(path: str) -> Quantizer:
    with store.reader(path) as f:
        dim, m, k, size, n = struct.unpack("<5Q", f.read(40))
        return Quantizer(np.frombuffer(f.read(4 * n), "<f4").astype(np.float64).reshape(m, k, size))


def write_quantizer(q: Quantizer, path: str) -> None:
    m, k, size = q.centroids.shape
    with store.writer(path) as f:
        f.write(struct.pack("<5Q", m * size, m, k, size, m * k * size) + q.centroids.astype("<f4").tobytes())
