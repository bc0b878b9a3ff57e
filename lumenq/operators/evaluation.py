"""Recall and ranking quality of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at_k(exact: Column, actual: Column, k: int) -> Column:
    """Share of the distinct first k exact ids among the first k actual ones; 0 without exact ids."""
    if k <= 0:
        raise ValueError("k must be greater than zero")
    truth = F.array_distinct(F.slice(exact, 1, k))
    return F.when(F.size(truth) == 0, 0.0).otherwise(F.size(F.array_intersect(truth, F.slice(actual, 1, k))) / F.size(truth))


def tie_aware_recall_at_k(exact: Column, actual: Column, k: int) -> Column:
    """The same by distances: an actual distance counts when it isn't beyond the k-th exact one by
    more than a millionth of it (of 1, if that is smaller)."""
    if k <= 0:
        raise ValueError("k must be greater than zero")
    first = F.slice(exact, 1, k)
    last = F.element_at(first, -1)
    limit = last + F.greatest(F.abs(last), F.lit(1.0)) * 1e-6
    n = F.size(first)
    hit = F.size(F.filter(F.slice(actual, 1, k), lambda d: d <= limit))
    return F.when(n == 0, 0.0).otherwise(F.least(hit, n) / n)


def collect_ids(hits: DataFrame) -> DataFrame:
    """query_id, ids and distances in the order of rank; a query's hits are at most k."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "distance")))
    return hits.groupBy("query_id").agg(F.transform(rows, lambda r: r["id"]).alias("ids"), F.transform(rows, lambda r: r["distance"]).alias("distances"))


def ranking_quality(hits: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg, mrr, precision at k of hits (query_id, rank, id) against graded judgements
    (query_id, id, grade): gain 2**grade - 1, relevant above 0."""
    top = hits.where(F.col("rank") <= k).join(judged.where("grade > 0"), ["query_id", "id"])
    got = top.groupBy("query_id").agg(
        F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("n")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    best = judged.where("grade > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    ideal = best.groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("r") + 1.0)).alias("ideal"))
    every = ideal.join(got, "query_id", "left")
    return every.select(
        "query_id",
        F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("n", F.lit(0)) / k).alias("precision"),
    )
