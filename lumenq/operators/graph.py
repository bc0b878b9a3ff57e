"""Neighbour graphs within cells, and best-first walks over them (the leaf modes graph and vamana-pq)."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions.metrics import block
from lumenq.operators.ivf import Cells, _probes
from lumenq.operators.knn import check_k, top_k
from lumenq.operators.quantize import ProductQuantizer

EXACT_ROWS = 256
WINDOW = 64


def build_edges(x: np.ndarray, metric: str, degree: int) -> list[np.ndarray]:
    """Neighbours of each row: exact for up to EXACT_ROWS rows, else within overlapping windows of
    the rows in the order of their routing codes."""
    n = len(x)
    if n <= EXACT_ROWS:
        d = block(metric, x, x)
        np.fill_diagonal(d, np.inf)
        return [np.argsort(r, kind="stable")[: min(degree, n - 1)] for r in d]
    code = (x * np.where(np.arange(x.shape[1]) % 2 == 0, 1, -1)).sum(1)
    order = np.argsort(code, kind="stable")
    near: list[set] = [set() for _ in range(n)]
    for lo in range(0, n, WINDOW // 2):
        rows = order[lo : lo + WINDOW]
        d = block(metric, x[rows], x[rows])
        np.fill_diagonal(d, np.inf)
        for i, r in enumerate(d):
            near[rows[i]] |= set(rows[np.argsort(r, kind="stable")[: min(degree, len(rows) - 1)]].tolist())
    return [np.array(sorted(s), int) for s in near]


def walk(x: np.ndarray, edges: list[np.ndarray], q: np.ndarray, metric: str, entries: list[int], budget: int) -> dict[int, float]:
    """Best-first: always the nearest unvisited row next, until budget rows are scored."""
    seen = {e: float(block(metric, q[None], x[e : e + 1])[0, 0]) for e in entries}
    heap = [(d, e) for e, d in seen.items()]
    heapq.heapify(heap)
    while heap and len(seen) < budget:
        _, v = heapq.heappop(heap)
        new = [int(w) for w in edges[v] if int(w) not in seen][: budget - len(seen)]
        if new:
            for w, d in zip(new, block(metric, q[None], x[new])[0].tolist()):
                seen[w] = d
                heapq.heappush(heap, (d, w))
    return seen


def search_graph(index: Cells, queries: DataFrame, k: int, *, nprobe: int = 4, budget: int = 128, degree: int = 16, mode: str = "graph", query_id: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """Approximate hits by walks in the graphs of the nprobe nearest cells. Walks start at the row
    with the nearest routing code (graph) or the rows with the nearest product codes (vamana-pq)."""
    check_k(k)
    if mode not in ("graph", "vamana-pq"):
        raise ValueError(f"unknown leaf mode: {mode}")
    kind, qkind = index.records.schema[index.id].dataType, queries.schema[query_id].dataType
    probes = _probes(index, queries, query_id, query_vector).where(F.col("order") <= nprobe).select("query_id", "cell_id", "__q")
    rows = index.records.select("cell_id", F.col(index.id).alias("id"), F.col(index.vector).alias("v"))
    metric = index.metric

    def cell(key, held, asked):  # noqa: ANN001, ANN202
        import pandas as pd

        out = {"query_id": [], "id": [], "distance": []}
        if len(held) and len(asked):
            held = held.sort_values("id")
            x, ids = np.array(held["v"].tolist(), float), held["id"].to_numpy()
            edges = build_edges(x, metric, degree)
            sign = np.where(np.arange(x.shape[1]) % 2 == 0, 1, -1)
            code = (x * sign).sum(1)
            pq = ProductQuantizer(x) if mode == "vamana-pq" else None
            codes = pq.encode(x) if pq else None
            for qid, v in zip(asked["query_id"], asked["__q"]):
                q = np.asarray(v, float)
                start = np.argsort(pq.scores(q[None], codes)[0])[:4].tolist() if pq else [int(np.abs(code - (q * sign).sum()).argmin())]
                for i, d in walk(x, edges, q, metric, start, budget).items():
                    out["query_id"].append(qid)
                    out["id"].append(ids[i])
                    out["distance"].append(d)
        return pd.DataFrame(out)

    schema = T.StructType([T.StructField("query_id", qkind), T.StructField("id", kind), T.StructField("distance", T.DoubleType())])
    return top_k(rows.groupBy("cell_id").cogroup(probes.groupBy("cell_id")).applyInPandas(cell, schema), k)
