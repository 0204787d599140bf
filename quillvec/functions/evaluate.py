"""Quality of search results (qid, id, rank, dist) against the true ones, and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_by_ids(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: recall, the share of the true first k ids among the results' first k, over k and all queries of truth."""
    own = truth.where(F.col("rank") <= k).select("qid", "id")
    total = own.select("qid").distinct().agg(F.count("*").alias("queries"))
    found = results.where(F.col("rank") <= k).select("qid", "id").join(own, ["qid", "id"], "left_semi").agg(F.count("*").alias("hits"))
    return total.join(found, F.lit(True)).select((F.col("hits") / (F.col("queries") * k)).alias("recall"))


def _kth(truth: DataFrame, k: int) -> DataFrame:
    return truth.where(F.col("rank") <= k).groupBy("qid").agg(F.max("dist").alias("kth"))


def recall_by_distance(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: recall, counting a result as right if it is as near as the true k-th; ties count."""
    met = _kth(truth, k).join(results.where(F.col("rank") <= k), "qid", "left")
    return met.agg((F.sum(F.when(F.col("dist") <= F.col("kth"), 1).otherwise(0)) / (F.countDistinct("qid") * k)).alias("recall"))


def mean_fraction_returned(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: fraction, the rows returned over those asked for."""
    n = queries.select("qid").join(results.where(F.col("rank") <= k).groupBy("qid").agg(F.count("*").alias("n")), "qid", "left")
    return n.agg((F.coalesce(F.sum("n"), F.lit(0)) / (F.count("*") * k)).alias("fraction"))


def last_distance_ratio(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: ratio, the mean over queries of the last returned distance over the true k-th; 0 for a query without results."""
    last = results.where(F.col("rank") <= k).groupBy("qid").agg(F.max("dist").alias("last"))
    return _kth(truth, k).join(last, "qid", "left").agg(F.avg(F.coalesce(F.col("last") / F.col("kth"), F.lit(0.0))).alias("ratio"))


def all_returned_k(results: DataFrame, queries: DataFrame, n: Column | int, k: int) -> DataFrame:
    """One row: complete, whether every query has min(k, n) rows."""
    counts = queries.select("qid").join(results.groupBy("qid").agg(F.count("*").alias("c")), "qid", "left")
    least = F.least(F.lit(k), F.lit(n) if isinstance(n, int) else n)
    return counts.agg(F.coalesce(F.bool_and(F.coalesce("c", F.lit(0)) == least), F.lit(True)).alias("complete"))


#: Distinct values that one task puts in order, at most.
IN_ORDER = 100_000


def percentile(values: DataFrame, column: str, p: float) -> DataFrame:
    """One row: value at place round(p / 100 * (n - 1)) of the sorted values, by nearest rank; 0 if there are none.

    Equal values are one row with a count.  An approximate quantile halves the range until it has IN_ORDER distinct values or fewer; their counts are
    then added up in order, so no task sorts all rows.
    """
    counted = values.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    n, rows = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if not n:
        return values.sparkSession.sql("SELECT CAST(0.0 AS DOUBLE) AS value")
    left = int(p / 100 * (n - 1) + 0.5)  # values before the one sought, in the range
    while rows > IN_ORDER:
        middle = counted.approxQuantile("v", [0.5], 0.05)[0]
        lower, upper = counted.where(F.col("v") <= middle), counted.where(F.col("v") > middle)
        own, distinct = lower.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        if left < own:
            counted, rows = lower, distinct
        else:
            counted, rows, left = upper, rows - distinct, left - own
    upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("upto", upto).where(F.col("upto") > left).agg(F.min("v").alias("value"))
