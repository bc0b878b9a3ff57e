"""Cells: a coarse index of centroids, probes, and bounds that prune cells without changing results."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions import metrics
from lumenq.functions.metrics import EPS, block, parse
from lumenq.operators.knn import _queries, check_k, scan, top_k
from lumenq.util import scratch_path

SAMPLE = 65_536
MAX_CELLS = 4096


def cell_rows(dims: int) -> int:
    """Rows aimed at per cell: about 16 MiB of float32, from 64 to 131072."""
    return int(min(131_072, max(64, 16 * 2**20 // (4 * max(1, dims)))))


def lloyd(x: np.ndarray, k: int, rounds: int = 10, seed: int = 42, spherical: bool = False) -> np.ndarray:
    """k centroids of the rows by Lloyd's iterations; an empty one takes the row farthest from its own."""
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
        at = d.argmin(1)
        far = d[np.arange(len(x)), at] + (x * x).sum(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=k)
        for e, r in zip(np.flatnonzero(n == 0), np.argsort(-far)):
            total[e], n[e] = x[r], 1
        c = total / n[:, None]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1), EPS)[:, None]
    return c


def sample_rows(records: DataFrame, id: str, vector: str, n: int | None = None, most: int = SAMPLE) -> np.ndarray:
    """At most `most` of the n vectors (counted if not given), chosen by a hash of the id."""
    n = records.count() if n is None else n
    share = min(1.0, 0.95 * most / max(1, n))
    h = F.pmod(F.xxhash64(id), F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True)
    got = records.where(h & F.col(vector).isNotNull()).select(id, vector).limit(most).collect()
    got.sort(key=lambda r: r[0])
    return np.array([r[1] for r in got], np.float64)


@dataclass
class Cells:
    """The centroids (at most MAX_CELLS), their metric, and the assigned records with cell_id."""

    metric: str
    centroids: np.ndarray
    records: DataFrame
    stats: DataFrame
    id: str = "id"
    vector: str = "vector"
    radius: np.ndarray | None = None  # by cell; of empty ones -inf


def assign_cells(vector: Column, centroids: np.ndarray, metric: str) -> Column:
    c = np.asarray(centroids)

    @F.pandas_udf(T.IntegerType())
    def run(s):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(s):
            return pd.Series([], dtype="int32")
        return pd.Series(block(metric, np.array(s.tolist(), float), c).argmin(1).astype("int32"))

    return run(vector)


def build(records: DataFrame, metric: str = "euclidean", *, id: str = "id", vector: str = "vector", cells: int | None = None, seed: int = 42, path: str | None = None) -> Cells:
    """Fits centroids on at most 65536 records and assigns every record with a vector to the nearest.

    The assigned records are written partitioned by cell_id, so a probe reads its cells' files only.
    stats: cell_id, n, radius (largest distance to the centroid, in the metric's bounding geometry).
    """
    key, _ = parse(metric)
    n = records.count()
    x = sample_rows(records, id, vector, n)
    if not len(x):
        raise ValueError("no vectors to index")
    k = cells or max(1, min(MAX_CELLS, len(x) // 8, int(math.sqrt(n))))
    unit = key in metrics.UNIT_GEOMETRY
    if unit:
        x = x / np.maximum(np.linalg.norm(x, axis=1), EPS)[:, None]
    c = lloyd(x, k, seed=seed, spherical=unit)
    return build_from(records, c, metric, id, vector, path)


def build_from(records: DataFrame, c: np.ndarray, metric: str, id: str = "id", vector: str = "vector", path: str | None = None) -> Cells:
    """The same from given centroids. With a path the index is kept there, for open_cells."""
    unit = parse(metric)[0] in metrics.UNIT_GEOMETRY
    geometry = metric if metrics.supports_centroid_bound(metric) and not unit else "euclidean"
    v = metrics.unit(F.col(vector)) if unit else F.col(vector).cast("array<double>")
    placed = records.where(F.col(vector).isNotNull()).withColumn("cell_id", assign_cells(v, c, "euclidean"))
    spark = records.sparkSession
    path = path or scratch_path(spark, "cells")
    placed.repartition("cell_id").write.partitionBy("cell_id").parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    centre = F.broadcast(_centroid_table(spark, c))  # at most MAX_CELLS rows
    u = metrics.unit(F.col(vector)) if unit else F.col(vector)
    far = stored.join(centre, "cell_id").withColumn("__d", metrics.distance(geometry, u, F.col("centroid")))
    stats = far.groupBy("cell_id").agg(F.count("*").alias("n"), F.max("__d").alias("radius"))
    # empty cells keep their place
    centre.join(stats, "cell_id", "left").select("cell_id", "centroid", F.coalesce("n", F.lit(0)).alias("n"), "radius").coalesce(1).write.parquet(f"{path}/centroids")
    return open_cells(spark, path, metric, placed.schema, id, vector)


def open_cells(spark: SparkSession, path: str, metric: str, schema: T.StructType, id: str = "id", vector: str = "vector") -> Cells:
    """An index kept at path; schema is that of its records and cell_id."""
    cells = spark.read.schema("cell_id int, centroid array<double>, n bigint, radius double").parquet(f"{path}/centroids")
    rows = cells.orderBy("cell_id").collect()  # at most MAX_CELLS rows
    held = [(r["cell_id"], r["n"], r["radius"]) for r in rows if r["n"]]
    stats = spark.createDataFrame(held, "cell_id int, n bigint, radius double")
    radius = np.array([-np.inf if r["radius"] is None else r["radius"] for r in rows])
    return Cells(metric, np.array([r["centroid"] for r in rows]), spark.read.schema(schema).parquet(f"{path}/rows"), stats, id, vector, radius)


def _centroid_table(spark, c: np.ndarray) -> DataFrame:  # noqa: ANN001
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(c)]
    return spark.createDataFrame(rows, "cell_id int, centroid array<double>")


def _probes(index: Cells, queries: DataFrame, query_id: str, query_vector: str) -> DataFrame:
    """query_id, __q, cell_id, to_centre, order of every query's cells; the cells are bounded."""
    unit = parse(index.metric)[0] in metrics.UNIT_GEOMETRY
    geometry = "euclidean" if unit or not metrics.supports_centroid_bound(index.metric) else index.metric
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("__q"))
    u = metrics.unit(F.col("__q")) if unit else F.col("__q")
    d = metrics.distance(geometry, u, F.col("centroid"))
    w = Window.partitionBy("query_id").orderBy("to_centre", "cell_id")
    cells = F.broadcast(_centroid_table(queries.sparkSession, index.centroids))
    return q.crossJoin(cells).withColumn("to_centre", d).withColumn("order", F.row_number().over(w)).drop("centroid")


def search(index: Cells, queries: DataFrame, k: int, *, nprobe: int = 8, per_cell: int | None = None, query_id: str = "query_id", query_vector: str = "vector", where: Column | None = None) -> DataFrame:
    """Approximate hits from the nprobe nearest cells of each query, scored exactly. per_cell keeps
    the rows of a cell with the nearest routing codes only."""
    check_k(k)
    if per_cell is None:
        def near(ids: list, q: np.ndarray) -> np.ndarray:
            return _nearest_cells(_to_centres(index, q), nprobe)

        return top_k(_scan(index, queries, near, k, query_id, query_vector, where), k)
    probes = _probes(index, queries, query_id, query_vector).where(F.col("order") <= nprobe)
    rows = index.records.where(where) if where is not None else index.records
    both = rows.select(F.col(index.id).alias("id"), F.col(index.vector).alias("__v"), "cell_id").join(probes, "cell_id")
    gap = F.abs(routing_code(F.col("__v")) - routing_code(F.col("__q")))
    w = Window.partitionBy("query_id", "cell_id").orderBy(gap, "id")
    both = both.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_cell)
    return top_k(both.select("query_id", "id", metrics.distance(index.metric, F.col("__q"), F.col("__v")).alias("distance")), k)


def lower_bound(metric: str, to_centre: Column, radius: Column) -> Column:
    """The smallest distance any row of a cell can have, by the triangle inequality."""
    key, _ = parse(metric)
    e = F.greatest(F.lit(0.0), to_centre - radius)
    if key == "cosine":
        return e * e / 2
    if key == "angular":
        return F.acos(F.greatest(F.lit(-1.0), 1 - e * e / 2)) / math.pi
    return e


def search_pruned(index: Cells, queries: DataFrame, k: int, *, query_id: str = "query_id", query_vector: str = "vector", first: int = 2) -> DataFrame:
    """Exact hits that skip cells: the k-th distance within the nearest `first` cells bounds the
    search, and only cells whose lower bound isn't above it are read. Ties are never pruned."""
    if not metrics.supports_centroid_bound(index.metric):
        raise ValueError(f"no bound for {index.metric}")
    qkind = queries.schema[query_id].dataType
    rows = index.records.select(F.col(index.id).alias("id"), F.col(index.vector).alias("v"), "cell_id")

    def kept(ids: list, q: np.ndarray) -> np.ndarray:
        far = _to_centres(index, q)
        probed = _nearest_cells(np.where(np.isfinite(index.radius), far, np.inf), first)
        near = top_k(_cell_scan(rows, ids, q, qkind, k, index.metric, probed), k)
        place = {i: n for n, i in enumerate(ids)}
        tau, have = np.full(len(ids), np.inf), np.zeros(len(ids))
        for r in near.groupBy("query_id").agg(F.max("distance").alias("tau"), F.count("*").alias("have")).collect():  # a block's queries
            tau[place[r["query_id"]]], have[place[r["query_id"]]] = r["tau"], r["have"]
        bound = _bound(index.metric, np.maximum(0, far - index.radius))
        return ((have < k)[:, None] | (bound <= tau[:, None] + 1e-9)) & np.isfinite(index.radius)

    return top_k(_scan(index, queries, kept, k, query_id, query_vector), k)


def _bound(metric: str, e: np.ndarray) -> np.ndarray:
    """lower_bound of distances e beyond the cell's radius."""
    key, _ = parse(metric)
    if key == "cosine":
        return e * e / 2
    if key == "angular":
        return np.arccos(np.maximum(-1.0, 1 - e * e / 2)) / math.pi
    return e


def _to_centres(index: Cells, q: np.ndarray) -> np.ndarray:
    """Distances of queries to the centroids, in the metric's bounding geometry."""
    unit = parse(index.metric)[0] in metrics.UNIT_GEOMETRY
    geometry = "euclidean" if unit or not metrics.supports_centroid_bound(index.metric) else index.metric
    u = q / np.maximum(np.linalg.norm(q, axis=1), EPS)[:, None] if unit else q
    return np.asarray(block(geometry, u, index.centroids))


def _nearest_cells(far: np.ndarray, count: int) -> np.ndarray:
    probed = np.zeros(far.shape, bool)
    np.put_along_axis(probed, np.argsort(far, axis=1, kind="stable")[:, :count], True, axis=1)
    return probed


def _cell_scan(rows: DataFrame, ids: list, q: np.ndarray, qkind: T.DataType, k: int, metric: str, probed: np.ndarray) -> DataFrame:
    return scan(rows.where(F.col("cell_id").isin(np.flatnonzero(probed.any(0)).tolist())), ids, q, qkind, k, metric, probed)


def _scan(index: Cells, queries: DataFrame, choose: Callable[[list, np.ndarray], np.ndarray], k: int, query_id: str, query_vector: str, where: Column | None = None) -> DataFrame:
    """query_id, id, distance over the cells that choose names for each query of a block (a matrix of
    queries by cells): their files are read once per block, and each task sends k rows per query."""
    rows = index.records.where(where) if where is not None else index.records
    rows = rows.select(F.col(index.id).alias("id"), F.col(index.vector).alias("v"), "cell_id")
    qkind = queries.schema[query_id].dataType
    hits = None
    for ids, q in _queries(queries, query_id, query_vector):
        part = _cell_scan(rows, ids, q, qkind, k, index.metric, choose(ids, q))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        raise ValueError("no queries")
    return hits


def routing_code(vector: Column) -> Column:
    """The sum of the coordinates with alternating signs."""
    return F.aggregate(F.transform(vector.cast("array<double>"), lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)), F.lit(0.0), lambda s, v: s + v)


def bounding_boxes(index: Cells) -> DataFrame:
    """cell_id, low, high: the smallest and largest value of every coordinate, per cell."""
    c = index.records.select("cell_id", F.posexplode(index.vector).alias("i", "v"))
    m = c.groupBy("cell_id", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = F.array_sort(F.collect_list(F.struct("i", "lo", "hi")))  # one entry per coordinate
    return m.groupBy("cell_id").agg(F.transform(rows, lambda r: r["lo"]).alias("low"), F.transform(rows, lambda r: r["hi"]).alias("high"))
