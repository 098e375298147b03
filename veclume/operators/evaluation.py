"""Recall, and the tables of a benchmark report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall): the share of the k true neighbours (query_id, id) that were found, averaged over the true queries."""
    hits = truth.join(found.select("query_id", "id").distinct().withColumn("__hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("__hit") / k).alias("r")).agg(F.round(F.avg("r"), 6).alias("recall"))


RESULT_SCHEMA = "library string, algorithm string, dataset string, index_size bigint, build_time_sec double, peak_memory_mb double, recall_at_10 double, recall_at_100 double, qps double, parameters map<string,string>, notes string"


def _first(results: DataFrame, keys: list[str], *order) -> DataFrame:
    return results.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def best_by_algorithm(results: DataFrame) -> DataFrame:
    """Each algorithm's run of best recall@10; of equals the one of most queries a second."""
    return _first(results, ["library", "algorithm"], F.desc("recall_at_10"), F.desc("qps"))


def fastest_at_recall(results: DataFrame, least: float, n: int = 5) -> DataFrame:
    return results.filter(F.col("recall_at_10") >= least).orderBy(F.desc("qps"), "library", "algorithm").limit(n)


def build_comparison(results: DataFrame) -> DataFrame:
    """Build time and memory, once for each algorithm."""
    return _first(results, ["library", "algorithm"], "build_time_sec", "peak_memory_mb").select("library", "algorithm", "build_time_sec", "peak_memory_mb", "notes")


def analysis(results: DataFrame) -> DataFrame:
    """(what, library, algorithm, value): the winners of the report."""
    picks = [
        ("best_recall", F.lit(True), F.desc("recall_at_10"), "recall_at_10"),
        ("best_qps", F.lit(True), F.desc("qps"), "qps"),
        ("lowest_memory_at_recall_0.9", F.col("recall_at_10") > 0.9, F.asc("peak_memory_mb"), "peak_memory_mb"),
        ("fastest_build", F.lit(True), F.asc("build_time_sec"), "build_time_sec"),
        ("best_qps_at_recall_0.95", F.col("recall_at_10") >= 0.95, F.desc("qps"), "qps"),
    ]
    out = None
    for what, where, order, value in picks:
        one = results.filter(where).orderBy(order, "library", "algorithm").limit(1).select(F.lit(what).alias("what"), "library", "algorithm", F.col(value).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
