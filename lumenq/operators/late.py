"""Token-level multi-vectors: the sum over query tokens of the best dot product with a document's tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.operators.knn import _keep, check_k, search_batch, top_k

CELLS = 4_000_000  # products of tokens held at once


def maxsim(query: Column, doc: Column) -> Column:
    """MaxSim of two array<array<float>> columns; null when either has no token."""
    q, d = query.cast("array<array<double>>"), doc.cast("array<array<double>>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    best = F.transform(q, lambda a: F.array_max(F.transform(d, lambda b: dot(a, b))))
    return F.when((F.size(q) > 0) & (F.size(d) > 0), F.aggregate(best, F.lit(0.0), lambda s, v: s + v))


def _score(q: np.ndarray, starts: np.ndarray, k: int):  # noqa: ANN202
    """mapInArrow: (id, tokens) -> the task's k best (query number, id, distance) of a block of queries,
    whose tokens are the rows of q from starts on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for b in batches:
            kind = b.schema.field("id").type
            ids = np.array(b.column(0).to_pylist(), dtype=object if pa.types.is_string(kind) or pa.types.is_binary(kind) else None)
            lists = b.column(1)
            width = pc.list_value_length(pc.list_flatten(lists)).to_numpy(zero_copy_only=False)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(n)), n)
            good = (n > 0) & (np.bincount(at, weights=width != q.shape[1], minlength=len(n)) == 0)
            if not good.any():
                continue
            lists = lists.filter(pa.array(good))
            ids, n = ids[good], n[good]
            x = pc.list_flatten(pc.list_flatten(lists)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            first = np.r_[0, np.cumsum(n)]
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CELLS // max(1, len(q)), side="right")) - 1)
                best = np.maximum.reduceat(x[first[lo] : first[hi]] @ q.T, first[lo:hi] - first[lo], axis=0)
                score = np.add.reduceat(best, starts, axis=1)
                for j in range(len(starts)):
                    _keep(held, j, ids[lo:hi], -score[:, j], k)
                lo = hi
        if held:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(v[0]), i) for i, v in held.items()]).astype(np.int32)),
                    pa.array(np.concatenate([v[0] for v in held.values()]).tolist(), kind),
                    pa.array(np.concatenate([v[1] for v in held.values()]), pa.float64()),
                ],
                names=["n", "id", "distance"],
            )

    return run


def search_late(records: DataFrame, queries: DataFrame, k: int, *, id: str = "id", tokens: str = "tokens", query_id: str = "query_id", query_tokens: str = "tokens", at_once: int = 1000) -> DataFrame:
    """query_id, rank, id, distance (minus MaxSim) over all records.

    The queries, any number of them, go to the tasks in blocks of about at_once; the records are
    scanned once per block, token products are computed a block at a time, and each task sends at
    most k rows per query over the shuffle. Records and queries without tokens, or with tokens of
    another length than the block's, don't take part; repeated queries count once.
    """
    check_k(k)
    spark = records.sparkSession
    rows = records.select(F.col(id).alias("id"), F.col(tokens).cast("array<array<double>>").alias("tokens")).where("id IS NOT NULL AND size(tokens) > 0")
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_tokens).cast("array<array<double>>").alias("q")).where("query_id IS NOT NULL AND size(q) > 0").dropDuplicates()
    asked = asked.withColumn("width", F.size(F.col("q")[0]))
    kind, qkind = rows.schema["id"].dataType, asked.schema["query_id"].dataType
    hits = None
    for width, n in sorted((r["width"], r["count"]) for r in asked.groupBy("width").count().collect()):  # one row per length
        blocks = -(-n // at_once)
        for b in range(blocks):
            few = asked.where((F.col("width") == width) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
            few = sorted((r for r in few if all(t is not None and len(t) == width for t in r["q"])), key=lambda r: r["query_id"])
            if not few:
                continue
            starts = np.cumsum([0, *[len(r["q"]) for r in few[:-1]]])
            q = np.array([t for r in few for t in r["q"]], np.float64)
            part = rows.mapInArrow(_score(q, starts, k), T.StructType([T.StructField("n", T.IntegerType()), T.StructField("id", kind), T.StructField("distance", T.DoubleType())]))
            names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(few)], T.StructType([T.StructField("n", T.IntegerType()), T.StructField("query_id", qkind)]))
            part = part.join(F.broadcast(names), "n").select("query_id", "id", "distance")  # one row per query of the block
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = spark.createDataFrame([], T.StructType([T.StructField("query_id", qkind), T.StructField("id", kind), T.StructField("distance", T.DoubleType())]))
    return top_k(hits, k, 9)


def search_late_bounded(records: DataFrame, queries: DataFrame, k: int, candidates: int, **names: str) -> DataFrame:
    """The same from a bounded frontier: for every query token the `candidates` best document tokens
    name the documents that are scored exactly."""
    check_k(k)
    check_k(candidates)
    id, tokens = names.get("id", "id"), names.get("tokens", "tokens")
    query_id, query_tokens = names.get("query_id", "query_id"), names.get("query_tokens", "tokens")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_tokens).alias("__q")).where("query_id IS NOT NULL").dropDuplicates()
    mark = "\x01"
    one = lambda name, n: F.concat(F.col(name).cast("string"), F.lit(mark), F.col(n).cast("string"))
    asked = q.select("query_id", F.posexplode("__q").alias("n", "vector")).select(one("query_id", "n").alias("token"), "vector")
    held = records.select(F.col(id).alias("id"), F.posexplode(tokens).alias("m", "vector")).select(one("id", "m").alias("id"), "vector")
    near = search_batch(held, asked, candidates, "inner-product", query_id="token")
    back = lambda name, kind: F.substring_index(name, mark, 1).cast(kind)
    pairs = near.select(back("query_id", q.schema["query_id"].dataType).alias("query_id"), back("id", records.schema[id].dataType).alias("id")).distinct()
    scored = records.select(F.col(id).alias("id"), F.col(tokens).alias("__d")).join(pairs, "id").join(q, "query_id")
    return top_k(scored.select("query_id", "id", (-maxsim(F.col("__q"), F.col("__d"))).alias("distance")), k, 9)
