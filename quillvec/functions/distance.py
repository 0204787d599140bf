"""Vector metrics, each as a Spark column expression and as a NumPy kernel over whole batches.

Vectors are stored as array<float>; arithmetic is in double, so a sum does not depend on its order in any visible digit.
A metric is chosen by name; `register_metric` adds others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of added rows start here; smaller ids belong to the base.
DELTA_ID_OFFSET = 1 << 48


@dataclass(frozen=True)
class Metric:
    """column(a, b): of two array columns.  kernel(queries, rows): the matrix of all distances, or a stack of them for
    stacks of either.  pairs(a, b): of the rows of two matrices, one by one."""

    name: str
    column: Callable[[Column, Column], Column]
    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """The share of positions with different values."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: F.when(x != y, 1.0).otherwise(0.0))) / F.size(_double(a))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def squared_norm(a: Column | str) -> Column:
    return F.aggregate(_double(a), F.lit(0.0), lambda total, x: total + x * x)


def dot_distance(a: Column | str, b: Column | str) -> Column:
    """1 - inner product; negative for long vectors."""
    return 1 - inner_product(a, b)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, kept in [0, 2]; 1 where either vector is zero."""
    norms = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / norms)))


def normalize(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    norm = F.sqrt(squared_norm(a))
    return F.when(norm == 0, _double(a)).otherwise(F.transform(_double(a), lambda x: x / norm))


def _across(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ np.swapaxes(x, -1, -2)


def _k_l2_squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q**2).sum(-1)[..., :, None] + (x**2).sum(-1)[..., None, :] - 2 * _across(q, x), 0)


def _k_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((q**2).sum(-1))[..., :, None] * np.sqrt((x**2).sum(-1))[..., None, :]
    return np.where(norms == 0, 1.0, 1 - np.clip(_across(q, x) / np.where(norms == 0, 1, norms), -1, 1))


def _by_rows(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def kernel(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if q.ndim > 2:
            return np.stack([kernel(a, b) for a, b in zip(q, x, strict=True)]) if len(q) else np.zeros((0, q.shape[1], x.shape[1]))
        return np.stack([f(row[None], x) for row in q]) if len(q) else np.zeros((0, len(x)))

    return kernel


def _p_l2_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _p_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _p_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norms = np.sqrt(_p_dot(a, a)) * np.sqrt(_p_dot(b, b))
    return np.where(norms == 0, 1.0, 1 - np.clip(_p_dot(a, b) / np.where(norms == 0, 1, norms), -1, 1))


METRICS: dict[str, Metric] = {}


def register_metric(name: str, column: Callable[[Column, Column], Column], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], pairs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
    """Adds a metric; without `pairs` its kernel serves, a row at a time."""
    METRICS[name] = Metric(name, column, kernel, pairs or (lambda a, b: np.array([kernel(x[None], y[None])[0, 0] for x, y in zip(a, b, strict=True)])))


register_metric("l2sq", l2_squared, _k_l2_squared, _p_l2_squared)
register_metric("l2", l2, lambda q, x: np.sqrt(_k_l2_squared(q, x)), lambda a, b: np.sqrt(_p_l2_squared(a, b)))
register_metric("dot", dot_distance, lambda q, x: 1 - _across(q, x), lambda a, b: 1 - _p_dot(a, b))
register_metric("cosine", cosine_distance, _k_cosine, _p_cosine)
register_metric("l1", l1, _by_rows(lambda q, x: np.abs(q - x).sum(1)), lambda a, b: np.abs(a - b).sum(1))
register_metric("hamming", hamming, _by_rows(lambda q, x: (q != x).mean(1)), lambda a, b: (a != b).mean(1))


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(METRICS))}")
    return METRICS[name]


def is_delta_id(i: Column | str) -> Column:
    return (F.col(i) if isinstance(i, str) else i) >= F.lit(DELTA_ID_OFFSET)


def delta_local_index(i: Column | str) -> Column:
    return (F.col(i) if isinstance(i, str) else i) - F.lit(DELTA_ID_OFFSET)
