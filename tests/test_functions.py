from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.functions import distance as D
from quillvec.functions import evaluate as ev
from quillvec.functions import filters as fl


@pytest.mark.parametrize("name", sorted(D.METRICS))
def test_column_and_kernel_agree(spark, name):
    random = np.random.default_rng(1)
    a, b = random.normal(size=(7, 13)), random.normal(size=(7, 13))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "i int, a array<double>, b array<double>")
    got = [r["d"] for r in df.select("i", D.metric(name).column(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert np.allclose(got, np.diag(D.metric(name).kernel(a, b)))


def test_cosine_cases(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 2.0], 1.0), ([1.0, 0.0], [-3.0, 0.0], 2.0), ([0.0, 0.0], [1.0, 1.0], 1.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all(abs(r["d"] - r["want"]) < 1e-9 for r in df.select(D.cosine_distance("a", "b").alias("d"), "want").collect())
    assert np.allclose(D.metric("cosine").kernel(np.zeros((1, 2)), np.ones((1, 2))), 1)


def test_unknown_metric():
    with pytest.raises(ValueError):
        D.metric("nope")


def test_registered_metric(spark):
    D.register_metric("first", lambda a, b: F.abs(a[0] - b[0]), lambda q, x: np.abs(q[:, :1] - x[:, 0][None]))
    assert D.metric("first").kernel(np.array([[1.0]]), np.array([[4.0]]))[0, 0] == 3
    del D.METRICS["first"]


def test_delta_ids(spark):
    row = spark.range(1).select(D.is_delta_id(F.lit(5)).alias("a"), D.is_delta_id(F.lit(D.DELTA_ID_OFFSET + 5)).alias("b"), D.delta_local_index(F.lit(D.DELTA_ID_OFFSET + 5)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (False, True, 5)


@pytest.mark.parametrize(
    ("test", "want"),
    [
        (fl.Equal(0, 5), True), (fl.Equal(0, 6), False), (fl.Equal(9, 5), False), (fl.OneOf(1, (1, 10)), True), (fl.OneOf(1, ()), False), (fl.Less(1, 10), False), (fl.Less(1, 11), True),
        (fl.Greater(1, 10), False), (fl.Greater(1, 9), True), (fl.Between(1, 10, 20), True), (fl.Between(1, 5, 10), True), (fl.Between(1, 11, 20), False), (fl.Between(7, 0, 99), False),
        (fl.And((fl.Equal(0, 5), fl.Equal(1, 10))), True), (fl.And((fl.Equal(0, 5), fl.Equal(1, 11))), False), (fl.Or((fl.Equal(0, 6), fl.Equal(1, 10))), True), (fl.Or((fl.Equal(9, 5), fl.Equal(0, 6))), False),
        (fl.And(()), True), (fl.Or(()), False), (fl.Everything(), True), (fl.Equal(0, 5) & fl.Less(1, 11), True), (fl.Equal(0, 6) | fl.Less(1, 5), False),
    ],
)
def test_filters(spark, test, want):
    row = spark.createDataFrame([([5, 10],)], "labels array<long>")
    assert row.select(test.truth().alias("m")).first()["m"] is want
    assert row.where(test.column()).count() == int(want)


@pytest.mark.parametrize("p", [0, 1, 25, 50, 95, 99, 100])
def test_percentile(spark, p):
    values = np.random.default_rng(p).normal(size=357)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert math.isclose(ev.percentile(df, "x", p).first()["value"], np.sort(values)[int(p / 100 * 356 + 0.5)])


def test_percentile_of_nothing_and_of_ties(spark):
    assert ev.percentile(spark.createDataFrame([], "x double"), "x", 50).first()["value"] == 0
    assert ev.percentile(spark.createDataFrame([(2.0,)] * 50 + [(3.0,)], "x double"), "x", 50).first()["value"] == 2


def test_recalls(spark):
    truth = spark.createDataFrame([(0, 1, 1, 0.1), (0, 2, 2, 0.2), (1, 3, 1, 0.1), (1, 4, 2, 0.3)], "qid long, id long, rank int, dist double")
    found = spark.createDataFrame([(0, 1, 1, 0.1), (0, 9, 2, 0.2), (1, 3, 1, 0.1)], "qid long, id long, rank int, dist double")
    assert ev.recall_by_ids(found, truth, 2).first()["recall"] == 0.5
    assert ev.recall_by_distance(found, truth, 2).first()["recall"] == 0.75
    assert ev.mean_fraction_returned(found, truth.select("qid").distinct(), 2).first()["fraction"] == 0.75
    assert abs(ev.last_distance_ratio(found, truth, 2).first()["ratio"] - (1 + 1 / 3) / 2) < 1e-9
    assert not ev.all_returned_k(found, truth.select("qid").distinct(), 10, 2).first()["complete"]
    assert ev.all_returned_k(truth, truth.select("qid").distinct(), 10, 2).first()["complete"]
