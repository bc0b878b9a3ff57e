"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.util import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node of it) for every node of an edge.

    Each round takes the smallest label among a node and its neighbours, then follows the label's
    own label (pointer jumping), so the rounds grow with the logarithm of the longest path. The
    labels of a round are written to the shared folder; a node with very many edges is reduced
    before the shuffle. Null ends and loops add nothing.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("u").alias("label"), F.col("label").alias("further"))
        new = low.join(hop, "label", "left").select("u", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = materialize(new, "labels")
        labels = new.select("u", "label")
        if new.where("old <> label").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
