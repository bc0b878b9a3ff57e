"""Search options, and the search that a set of options asks for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions import metrics
from lumenq.operators import graph, ivf, knn, quantize
from lumenq.operators.explain import guarantee
from lumenq.util import broadcast_if_small, materialize


class RecallNotGuaranteed(ValueError):
    """The options ask for exact recall and for a budget that may cut it."""


@dataclass
class SearchOptions:
    """mode is exact or approx. Budgets: max_segments cells a query, max_bytes of vectors a query
    (cells by distance until the budget is used), eps (cells whose lower bound times 1 + eps isn't
    below the k-th distance are left out), max_candidates_per_segment rows of a cell."""

    k: int = 10
    mode: str = "approx"
    leaf_mode: str = "srht-pq-scan"
    max_segments: int | None = None
    max_bytes: int | None = None
    eps: float | None = None
    max_candidates_per_segment: int | None = None
    candidates: int = 200
    guaranteed_recall: bool = False

    def checked(self) -> SearchOptions:
        knn.check_k(self.k)
        if self.mode not in ("exact", "approx"):
            raise ValueError(f"unknown mode: {self.mode}")
        if self.leaf_mode not in (*quantize.LEAF_MODES, "graph", "vamana-pq", "hybrid"):
            raise ValueError(f"unknown leaf mode: {self.leaf_mode}")
        if self.eps is not None and not (self.eps >= 0 and self.eps < float("inf")):
            raise ValueError("eps must be finite and non-negative when set")
        for name in ("max_segments", "max_bytes", "max_candidates_per_segment"):
            v = getattr(self, name)
            if v is not None and v <= 0:
                raise ValueError(f"{name} must be greater than zero when set")
        if self.guaranteed_recall and (self.budgets() or self.mode == "approx"):
            raise RecallNotGuaranteed("guaranteed recall needs exact mode and no budget")
        return self

    def budgets(self) -> list[str]:
        return [n for n in ("max_segments", "max_bytes", "eps", "max_candidates_per_segment") if getattr(self, n) is not None]


def search(index: ivf.Cells, queries: DataFrame, options: SearchOptions, *, query_id: str = "query_id", query_vector: str = "vector") -> tuple[DataFrame, dict]:
    """Hits, and a report: recall guarantee, termination reason and leaf mode."""
    o = options.checked()
    names = {"query_id": query_id, "query_vector": query_vector}
    rows = {"id": index.id, "vector": index.vector}
    if o.mode == "exact" and not o.budgets():
        if metrics.supports_centroid_bound(index.metric):
            return ivf.search_pruned(index, queries, o.k, **names), {"recall_guarantee": guarantee(exact=True), "termination": "exact-pruned", "leaf_mode": "exact"}
        return knn.search_batch(index.records, queries, o.k, index.metric, **rows, **names), {"recall_guarantee": guarantee(exact=True), "termination": "complete", "leaf_mode": "exact"}
    report = {"recall_guarantee": guarantee(exact=o.mode == "exact", truncated=bool(o.budgets())), "leaf_mode": o.leaf_mode}
    if not o.budgets():
        if o.leaf_mode in ("graph", "vamana-pq"):
            hits = graph.search_graph(index, queries, o.k, mode=o.leaf_mode, budget=o.candidates, **names)
        else:  # a hybrid leaf takes codes for every cell
            mode = "srht-pq-scan" if o.leaf_mode == "hybrid" else o.leaf_mode
            hits = quantize.search_codes(index.records, queries, o.k, mode=mode, metric=index.metric, candidates=o.candidates, **rows, **names)
        return hits, report | {"termination": "complete"}
    probes = materialize(ivf._probes(index, queries, query_id, query_vector).join(broadcast_if_small(index.stats, ivf.MAX_CELLS), "cell_id"), "probes")
    kept, reason = probes, "complete"
    if o.max_segments is not None:
        kept, reason = kept.where(F.col("order") <= o.max_segments), "max-segments"
    if o.max_bytes is not None:
        before = Window.partitionBy("query_id").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        used = F.sum(F.col("n") * F.lit(4 * index.centroids.shape[1])).over(before)
        kept, reason = kept.withColumn("__b", used).where((F.col("__b") <= o.max_bytes) | (F.col("order") == 1)).drop("__b"), "max-bytes"
    scan = index.records.select(F.col(index.id).alias("id"), F.col(index.vector).alias("__v"), "cell_id")

    def hits_of(p: DataFrame) -> DataFrame:
        both = scan.join(p.select("query_id", "__q", "cell_id"), "cell_id")
        if o.max_candidates_per_segment is not None:
            w = Window.partitionBy("query_id", "cell_id").orderBy(F.abs(ivf.routing_code(F.col("__v")) - ivf.routing_code(F.col("__q"))), "id")
            both = both.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= o.max_candidates_per_segment)
        return knn.top_k(both.select("query_id", "id", metrics.distance(index.metric, F.col("__q"), F.col("__v")).alias("distance")), o.k)

    if o.eps is not None:
        near = hits_of(kept.where(F.col("order") <= 2)).groupBy("query_id").agg(F.max("distance").alias("tau"), F.count("*").alias("have"))
        bound = ivf.lower_bound(index.metric, F.col("to_centre"), F.col("radius"))
        kept = kept.join(near, "query_id", "left").where((F.coalesce("have", F.lit(0)) < o.k) | (bound * (1 + o.eps) <= F.col("tau")))
        reason = "epsilon"
    return hits_of(kept), report | {"termination": reason}
