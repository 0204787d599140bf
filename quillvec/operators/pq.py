"""Product quantization: a vector is cut into M parts, each replaced by its nearest of K centroids.

The codebook has at most M * 256 rows, so it goes to every task.  Lloyd steps run over all training rows: each task
adds up its rows by centroid, and only M * K sums reach the driver.  Distances are squared L2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, ShortType, StructField, StructType

from .graph import hashed_choice
from .knn import best_of_blocks, check_queries, rank_top_k
from .validate import VectorError, check_vectors, matrix


@dataclass(frozen=True)
class PQConfig:
    subspaces: int = 8
    centroids: int = 256
    iterations: int = 20
    #: Training rows, chosen by hash; 0: all.
    sample: int = 50_000


@dataclass
class Quantizer:
    """centroids: (M, K, dim / M)."""

    centroids: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[0] * self.centroids.shape[2]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(M, rows, dim / M)."""
        m, _, size = self.centroids.shape
        if x.shape[1] != m * size:
            raise VectorError(f"vectors have {x.shape[1]} elements, the quantizer {m * size}")
        return x.reshape(len(x), m, size).transpose(1, 0, 2)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, M): the nearest centroid of each part, the first of equals."""
        out = np.empty((len(x), len(self.centroids)), np.int16)
        for j, (p, c) in enumerate(zip(self.parts(x), self.centroids, strict=True)):
            out[:, j] = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1) if len(p) <= 256 else np.concatenate([((p[i : i + 256, None] - c[None]) ** 2).sum(2).argmin(1) for i in range(0, len(p), 256)])
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, M, K): squared distances from each part of a query to each centroid."""
        return np.stack([((p[:, None] - c[None]) ** 2).sum(2) for p, c in zip(self.parts(q), self.centroids, strict=True)], axis=1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.centroids[np.arange(codes.shape[1])[None], codes].reshape(len(codes), -1)


def check_config(dim: int, c: PQConfig) -> None:
    if not 1 <= c.centroids <= 256:
        raise VectorError(f"{c.centroids} centroids; 1 to 256 fit a code")
    if c.subspaces < 1 or dim % c.subspaces:
        raise VectorError(f"{dim} elements can't be cut into {c.subspaces} equal parts")


def sample_rows(vectors: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The n rows (id, ...) that come first by a hash of the id; without replacement, the same in every run."""
    return vectors.orderBy(hashed_choice(seed, F.col("id")), "id").limit(n)


def _seeds(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k rows, each next one drawn by its squared distance to the nearest so far; repeated if there are fewer rows."""
    picked = [int(random.integers(len(x)))]
    d = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < min(k, len(x)):
        total = d.sum()
        nxt = int(np.searchsorted(np.cumsum(d), random.random() * total)) if total > 0 else int(random.integers(len(x)))
        picked.append(min(nxt, len(x) - 1))
        d = np.minimum(d, ((x - x[picked[-1]]) ** 2).sum(1))
    return x[np.resize(picked, k)]


def lloyd_step(vectors: DataFrame, q: Quantizer, spare: np.ndarray | None = None) -> Quantizer:
    """Moves each centroid to the mean of its rows; one without rows goes to its part of the next row of `spare`, and stays where there is none."""
    m, k, size = q.centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        sums, n = np.zeros((m * k, size)), np.zeros(m * k, np.int64)
        for batch in batches:
            x = matrix(batch.column("embedding"))
            if len(x):
                codes = shared.value.codes(x)
                for j, part in enumerate(shared.value.parts(x)):
                    np.add.at(sums, j * k + codes[:, j], part)
                    n += np.bincount(j * k + codes[:, j], minlength=m * k)
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n[cells]), pa.array(list(sums[cells]), pa.list_(pa.float64()))], ["cell", "n", "sums"])

    partial = vectors.select("embedding").mapInArrow(run, "cell long, n long, sums array<double>").select("cell", "n", F.posexplode("sums").alias("pos", "x"))
    rows = partial.groupBy("cell", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
    moved = q.centroids.reshape(m * k, size).copy()
    if spare is not None and len(spare):
        empty = np.setdiff1d(np.arange(m * k), rows["cell"].to_numpy(np.int64))
        moved[empty] = q.parts(spare)[empty // k, np.arange(len(empty)) % len(spare)]
    moved[rows["cell"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64)] = rows["x"] / rows["n"]
    return Quantizer(moved.reshape(m, k, size))


def train(vectors: DataFrame, config: PQConfig = PQConfig(), *, init: str = "spread", seed: int = 42) -> Quantizer:
    """Trains on vectors (id, embedding).  init: `spread` draws seeds by distance; `first` takes the first K rows by id."""
    _, dim = check_vectors(vectors)
    check_config(dim, config)
    own = sample_rows(vectors, config.sample, seed) if config.sample else vectors
    first = own.orderBy("id").limit(config.centroids) if init == "first" else sample_rows(own, config.sample or 50_000, seed)
    x = matrix(first.select("embedding").toArrow().combine_chunks()["embedding"].combine_chunks())
    size = dim // config.subspaces
    random = np.random.default_rng(seed)
    parts = x.reshape(len(x), config.subspaces, size).transpose(1, 0, 2)
    seeds = [np.resize(p, (config.centroids, size)) if init == "first" else _seeds(p, config.centroids, random) for p in parts]
    q = Quantizer(np.stack(seeds))
    for _ in range(config.iterations):
        q = lloyd_step(own, q, x[random.permutation(len(x))])
    return q


def codebook(spark: SparkSession, q: Quantizer) -> DataFrame:
    """(m, k, centroid)."""
    m, k, _ = q.centroids.shape
    return spark.createDataFrame([(i, j, q.centroids[i, j].tolist()) for i in range(m) for j in range(k)], "m int, k int, centroid array<double>")


def from_codebook(book: DataFrame) -> Quantizer:
    rows = book.orderBy("m", "k").collect()
    m, k = rows[-1]["m"] + 1, rows[-1]["k"] + 1
    return Quantizer(np.array([r["centroid"] for r in rows]).reshape(m, k, -1))


def _mapped(df: DataFrame, q: Quantizer, source: str, target: StructField, f) -> DataFrame:
    schema = StructType([*df.schema.fields, target])
    shared = df.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        for batch in batches:
            values = f(shared.value, batch.column(batch.schema.get_field_index(source)))
            flat = pa.array(values.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, q: Quantizer, vector: str = "embedding", codes: str = "codes") -> DataFrame:
    return _mapped(df, q, vector, StructField(codes, ArrayType(ShortType())), lambda z, c: z.codes(matrix(c)) if len(c) else np.zeros((0, len(z.centroids)), np.int16))


def decode(df: DataFrame, q: Quantizer, codes: str = "codes", vector: str = "decoded") -> DataFrame:
    return _mapped(df, q, codes, StructField(vector, ArrayType(DoubleType())), lambda z, c: z.decoded(matrix(c).astype(np.int64)) if len(c) else np.zeros((0, z.dim)))


def distance_table(df: DataFrame, q: Quantizer, query: str = "q", table: str = "table") -> DataFrame:
    """df with the table of each query: element m * K + k is the squared distance to centroid k of part m."""
    return _mapped(df, q, query, StructField(table, ArrayType(DoubleType())), lambda z, c: z.tables(matrix(c)).reshape(len(c), -1) if len(c) else np.zeros((0, z.centroids[:, :, 0].size)))


def table_distance(table: Column | str, codes: Column | str, k: int) -> Column:
    """The sum of the table's entries that the codes name."""
    table = F.col(table) if isinstance(table, str) else table
    return F.aggregate(F.transform(codes, lambda c, m: F.get(table, m * k + c)), F.lit(0.0), lambda total, x: total + x)


def adc_top_k(queries: DataFrame, coded: DataFrame, q: Quantizer, k: int) -> DataFrame:
    """(qid, id, rank, dist): the best k of coded (id, codes) by table distance."""
    shared, last = coded.sparkSession.sparkContext.broadcast(q), []

    def distances(x, codes):
        if not last or last[0] is not x:
            last[:] = [x, shared.value.tables(x)]
        codes, out = codes.astype(np.int64), np.zeros((len(x), len(codes)))
        for m in range(codes.shape[1]):
            out += last[1][:, m, codes[:, m]]
        return out

    check_queries(queries, q.dim)
    return best_of_blocks(queries, coded.select(F.col("id").cast("long").alias("id"), "codes"), k, distances, "codes")


def adc_rerank(queries: DataFrame, coded: DataFrame, data: DataFrame, q: Quantizer, k: int, wide: int, metric_name: str = "l2sq") -> DataFrame:
    """The best k of the best `wide` by table distance, by exact distance."""
    from ..functions.distance import metric

    hits = adc_top_k(queries, coded, q, wide).select("qid", "id")
    exact = hits.join(data.select("id", "embedding"), "id").join(queries.select("qid", "q"), "qid")
    return rank_top_k(exact.select("qid", "id", metric(metric_name).column(F.col("q"), F.col("embedding")).alias("dist")), k)


def stats(spark: SparkSession, q: Quantizer) -> DataFrame:
    """One row; the ratio leaves the codebook out."""
    m, k, size = q.centroids.shape
    return spark.createDataFrame([(m * size, m, k, size, m, m * k * size * 4, m * size * 4 / m)], "dim int, subspaces int, centroids int, subspace_dim int, code_bytes int, codebook_bytes long, ratio double")
