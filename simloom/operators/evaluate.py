"""Measures of searches and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of the request histogram, in seconds (fixed).
DURATIONS = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``query_id, recall``: the share of true hits that were found; queries without true hits are left out."""
    hit = truth.select("query_id", "id").distinct().join(found.select("query_id", "id", F.lit(1).alias("f")).distinct(), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("f") / F.count("*")).alias("recall"))


def rate_at(points: DataFrame, want: float) -> DataFrame:
    """``series, qps`` at a recall of ``want`` by linear interpolation between the neighbouring (``recall, qps``) points."""
    w = W.partitionBy("series").orderBy("recall")
    p = points.withColumns({"r2": F.lead("recall").over(w), "q2": F.lead("qps").over(w)})
    share = (F.lit(want) - F.col("recall")) / (F.col("r2") - F.col("recall"))
    return p.where((F.col("recall") <= want) & (F.col("r2") >= want) & (F.col("r2") > F.col("recall"))).groupBy("series").agg(F.max(F.col("qps") + share * (F.col("q2") - F.col("qps"))).alias("qps"))


def request_metrics(log: DataFrame, route: str, seconds: str, failed: Column) -> DataFrame:
    """By route: requests, errors, sum of durations and the cumulative histogram (one column a bound, ``le_inf`` last)."""
    buckets = [F.count_if(F.col(seconds) <= b).alias(f"le_{i}") for i, b in enumerate(DURATIONS)]
    return log.groupBy(F.col(route).alias("route")).agg(F.count("*").alias("requests"), F.count_if(failed).alias("errors"), F.sum(seconds).alias("seconds"), *buckets, F.count("*").alias("le_inf"))
