"""Fusing several ranked lists of hits into one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions.metrics import parse
from lumenq.operators.knn import check_k, top_k

PRIMARY, TEXT = "", "@text"


def _legs(legs: dict[str, DataFrame]) -> DataFrame:
    if not legs:
        raise ValueError("a hybrid query needs at least one leg")
    named = [h.select(F.lit(n).alias("leg"), "query_id", "rank", "id", "distance") for n, h in legs.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def default_depth(k: int) -> int:
    return max(check_k(k), 100)


def fuse_rrf(legs: dict[str, DataFrame], k: int, constant: float = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum over legs of 1 / (constant + rank from zero), as -distance."""
    scored = _legs(legs).groupBy("query_id", "id").agg((-F.sum(1 / (F.lit(float(constant)) + F.col("rank") - 1))).alias("distance"))
    return top_k(scored, check_k(k), 9)


def leg_score(metric: str | None):
    """Larger is better: of a dense leg 1 / (1 + d), of inner product and of lexical legs -d."""
    d = F.col("distance")
    if metric is None or parse(metric)[0] == "inner-product":
        return -d
    return 1 / (1 + d)


def fuse_weighted(legs: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None, metrics: dict[str, str | None] | None = None) -> DataFrame:
    """The weighted sum of scores, each leg's scaled by its best score of the query; a leg without a
    weight counts 1. Legs are named by vector, "" for the primary one and "@text". metrics names the
    metric of dense legs."""
    weights, metrics = weights or {}, metrics or {}
    scored = {n: h.withColumn("distance", -leg_score(metrics.get(n))) for n, h in legs.items()}
    every = _legs(scored).withColumn("score", -F.col("distance"))
    best = F.max("score").over(Window.partitionBy("query_id", "leg"))
    w = F.coalesce(*[F.when(F.col("leg") == n, F.lit(float(weights.get(n, 1.0)))) for n in legs])
    part = every.withColumn("part", w * F.when(best > 0, F.col("score") / best).otherwise(0.0))
    return top_k(part.groupBy("query_id", "id").agg((-F.sum("part")).alias("distance")), check_k(k), 9)
