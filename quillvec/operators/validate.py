"""Checks that run before a table of vectors is used."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class VectorError(ValueError):
    """A table of vectors that an operator can't take."""


def check_vectors(df: DataFrame, vector: str = "embedding") -> tuple[int, int]:
    """(rows, dim) of a table; raises if it is empty, or vectors are null, of different sizes, or hold null or NaN."""
    n, low, high, nulls, bad = df.agg(
        F.count("*"),
        F.min(F.size(vector)),
        F.max(F.size(vector)),
        F.count(F.when(F.col(vector).isNull(), 1)),
        F.count(F.when(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), 1)),
    ).first()
    if not n:
        raise VectorError("no vectors")
    if nulls or bad:
        raise VectorError(f"{nulls} vectors are null and {bad} hold null or NaN")
    if low != high or not low:
        raise VectorError(f"vectors have from {low} to {high} elements")
    return n, low


def check_dim(dim: int, expected: int) -> None:
    if dim != expected:
        raise VectorError(f"a query has {dim} elements, the index {expected}")


def check_labels(df: DataFrame, labels: str = "labels") -> tuple[int, int]:
    """(rows, fields) of a label column; raises if it is null somewhere, or rows have different numbers of labels."""
    n, low, high, nulls = df.agg(F.count("*"), F.min(F.size(labels)), F.max(F.size(labels)), F.count(F.when(F.col(labels).isNull(), 1))).first()
    if nulls or low != high:
        raise VectorError(f"{nulls} rows have no labels, the others from {low} to {high}")
    return n, high or 0


def matrix(column: pa.Array, what: str = "vector") -> np.ndarray:
    """The rows of a list column as a matrix of doubles; all must be of one size, without nulls."""
    if not len(column):
        return np.zeros((0, 0))
    if column.null_count:
        raise VectorError(f"a {what} is null")
    flat = column.flatten()
    if len(flat) % len(column) or (np.diff(column.offsets.to_numpy()) != len(flat) // len(column)).any():
        raise VectorError(f"{what}s have different sizes")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
