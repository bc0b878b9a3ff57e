"""Exact k nearest neighbours: hits are (query_id, rank, id, distance), ties by the smaller id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions import metrics
from lumenq.functions.metrics import block, parse

QUERY_BYTES = 32_000_000


def check_k(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError("k must be greater than zero")
    return k


def search(records: DataFrame, query: list[float], k: int, metric: str = "euclidean", *, id: str = "id", vector: str = "vector", where: Column | None = None, keep: list[str] | None = None, strict: bool = True) -> DataFrame:
    """The k records nearest to one query: id, distance, then the columns in keep.

    The filter applies before the ranking, so a selective one still fills k. Null vectors never
    match. The plan is a scan of id and vector, and TakeOrderedAndProject.
    """
    check_k(k)
    rows = records.where(where) if where is not None else records
    q = F.lit([float(x) for x in query])
    d = metrics.distance(metric, q, F.col(vector), strict=strict)
    hits = rows.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), d.alias("distance"), *(keep or []))
    return hits.where("distance IS NOT NULL").orderBy("distance", "id").limit(k)


def _queries(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """The queries in blocks of at most QUERY_BYTES of vectors, one at a time."""
    rows = queries.select(query_id, vector).where(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).dropDuplicates()
    n = rows.count()
    width = rows.agg(F.max(F.size(vector))).first()[0] or 1
    blocks = max(1, -(-n * width * 8 // QUERY_BYTES))
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b).collect()
        got.sort(key=lambda r: r[0])
        if got:
            yield [r[0] for r in got], np.array([r[1] for r in got], np.float64)


def _keep(held: dict, number: int, ids: np.ndarray, d: np.ndarray, k: int) -> None:
    """Adds candidates to a query's k best (by distance, then id); NaN distances are none."""
    ok = ~np.isnan(d)
    ids, d = ids[ok], d[ok]
    if len(d) > k:
        at = d <= np.partition(d, k - 1)[k - 1]
        ids, d = ids[at], d[at]
    if number in held:
        ids, d = np.concatenate([held[number][0], ids]), np.concatenate([held[number][1], d])
    order = np.lexsort((ids, d))[:k]
    held[number] = (ids[order], d[order])


def _partial(q: np.ndarray, k: int, metric: str, probed: np.ndarray | None = None, flush: int = 8192):
    """mapInArrow: (id, v[, cell_id]) -> the task's k best (query number, id, distance). probed tells
    which cells a query is to see, as a matrix of queries by cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t.filter(pc.equal(pc.list_value_length(t["v"]), q.shape[1])).combine_chunks()
            kind = t.schema.field("id").type
            if not t.num_rows:
                continue
            x = pc.list_flatten(t["v"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            names = np.array(t["id"].to_pylist(), dtype=object if pa.types.is_string(kind) or pa.types.is_binary(kind) else None)
            if probed is None:
                parts = [(np.arange(len(q)), np.arange(len(x)))]
            else:
                cell = t["cell_id"].to_numpy()
                parts = [(np.flatnonzero(probed[:, c]), np.flatnonzero(cell == c)) for c in np.unique(cell)]
            for asked, rows in parts:
                for lo in range(0, len(rows), flush):
                    for qlo in range(0, len(asked), 512):
                        some, here = asked[qlo : qlo + 512], rows[lo : lo + flush]
                        for number, d in zip(some.tolist(), block(metric, q[some], x[here])):
                            _keep(held, number, names[here], d, k)
        if held:
            n = np.concatenate([np.full(len(v[0]), i) for i, v in held.items()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(n.astype(np.int32)), pa.array(np.concatenate([v[0] for v in held.values()]).tolist(), kind), pa.array(np.concatenate([v[1] for v in held.values()]), pa.float64())],
                names=["n", "id", "distance"],
            )

    return run


def scan(rows: DataFrame, ids: list, q: np.ndarray, qkind: T.DataType, k: int, metric: str, probed: np.ndarray | None = None) -> DataFrame:
    """query_id, id, distance: every task's k best of a bounded block of queries over rows (id, v)."""
    schema = T.StructType([T.StructField("n", T.IntegerType()), rows.schema["id"], T.StructField("distance", T.DoubleType())])
    part = rows.mapInArrow(_partial(q, k, metric, probed), schema)
    names = rows.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("n", T.IntegerType()), T.StructField("query_id", qkind)]))
    return part.join(F.broadcast(names), "n").select("query_id", "id", "distance")  # one row per query of the block


def search_batch(records: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", *, id: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "vector", where: Column | None = None) -> DataFrame:
    """The k nearest records of every query: query_id, rank (from 1), id, distance.

    The records are scanned once per block of queries (32 MB of query vectors, checked), distances
    are computed a block at a time, and each task sends at most k rows per query over the shuffle.
    Records with a null vector or one of another length, and pairs for which the metric isn't
    defined, don't take part. Repeated queries count once.
    """
    check_k(k)
    parse(metric)
    rows = (records.where(where) if where is not None else records).select(F.col(id).alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    spark = records.sparkSession
    kind, qkind = rows.schema["id"].dataType, queries.schema[query_id].dataType
    hits = None
    for ids, q in _queries(queries, query_id, query_vector):
        part = scan(rows, ids, q, qkind, k, metric)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", qkind), T.StructField("rank", T.IntegerType()), T.StructField("id", kind), T.StructField("distance", T.DoubleType())]))
    return top_k(hits, k)


def top_k(hits: DataFrame, k: int, places: int | None = None) -> DataFrame:
    """The k best hits of each query, ranked from 1, ties by id. With places, distances that agree
    to so many decimals tie: sums of floats depend on the order of adding."""
    by = F.col("distance") if places is None else F.round("distance", places)
    w = Window.partitionBy("query_id").orderBy(by, "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= check_k(k)).select("query_id", "rank", "id", *[c for c in hits.columns if c not in ("query_id", "id")])


def rerank(hits: DataFrame, scores: Column, k: int) -> DataFrame:
    """Hits scored anew (larger is better): the k best by -score, as their distance."""
    return top_k(hits.drop("rank").withColumn("distance", -scores.cast("double")), k)


def get_records(records: DataFrame, ids: DataFrame, *, id: str = "id", order: str = "position") -> DataFrame:
    """The record of every wanted id in the wanted order; repeated ids repeat, unknown ones have null columns."""
    return ids.join(records, id, "left").orderBy(order)


def list_records(records: DataFrame, offset: int = 0, limit: int | None = None, *, id: str = "id") -> DataFrame:
    """Records in the order of their ids, a page of them."""
    rows = records.orderBy(id)
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows
