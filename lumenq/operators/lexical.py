"""Full-text search by BM25, and sparse inner-product search, as joins of postings or
scored where the documents are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions.text import tokenize
from lumenq.operators.knn import check_k, top_k
from lumenq.util import broadcast_if_small, materialize, spread

K1, B = 1.2, 0.75


def _tokens(docs: DataFrame, id: str, text: str, tokenizer: str) -> DataFrame:
    """id, length, t: the tokens of the documents that have any."""
    rows = spread(docs.select(F.col(id).alias("id"), F.col(text).alias("t")))
    tokens = rows.select("id", tokenize(F.col("t"), tokenizer).alias("t")).where(F.size("t") > 0)
    return tokens.select("id", F.size("t").alias("length"), "t")


def _count(exploded: DataFrame) -> DataFrame:
    return exploded.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def postings(docs: DataFrame, *, id: str = "id", text: str = "text", tokenizer: str = "unicode") -> DataFrame:
    """id, length, term, tf of the documents with at least one token. Ids must be unique."""
    return _count(_tokens(docs, id, text, tokenizer).select("id", "length", F.explode("t").alias("term")))


TERMS_AT_ONCE = 500_000
QUERY_BLOCK = 64
DOC_BLOCK = 512


def _score(blocks: list, stats: tuple, k: int, k1: float, b: float):
    """mapInArrow: (id, t) -> the task's k best (query number, id, score). blocks: per block of
    queries the terms, their idf, and a 0/1 matrix of terms by queries with the queries' numbers."""
    n, avg = stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for lo in range(0, batch.num_rows, DOC_BLOCK):
                part = pa.Table.from_batches([batch.slice(lo, DOC_BLOCK)])
                lists = part["t"].combine_chunks()
                length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)
                row, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
                ids = np.array(part["id"].to_pylist(), dtype=None if pa.types.is_integer(kind) else object)
                norm = k1 * (1 - b + b * length / avg)
                for terms, idf, asked, numbers in blocks:
                    at = pc.index_in(flat, value_set=terms)
                    ok = pc.is_valid(at).to_numpy(zero_copy_only=False)
                    if not ok.any():
                        continue
                    tf = np.bincount(row[ok] * len(terms) + at.filter(pa.array(ok)).to_numpy(), minlength=len(ids) * len(terms)).reshape(len(ids), len(terms)).astype(float)
                    score = (tf * (k1 + 1) / (tf + norm[:, None]) * idf) @ asked
                    for j, number in enumerate(numbers):
                        hit = np.flatnonzero(score[:, j] > 0)
                        if not len(hit):
                            continue
                        cid, cs = ids[hit], score[hit, j]
                        if number in held:
                            cid, cs = np.concatenate([held[number][0], cid]), np.concatenate([held[number][1], cs])
                        if len(cs) > k:
                            order = np.lexsort((cid, -np.round(cs, 9)))[:k]
                            cid, cs = cid[order], cs[order]
                        held[number] = (cid, cs)
        if held:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(v[0]), i) for i, v in held.items()]).astype(np.int32)),
                    pa.array(np.concatenate([v[0] for v in held.values()]).tolist(), kind),
                    pa.array(np.concatenate([v[1] for v in held.values()])),
                ],
                names=["n", "id", "score"],
            )

    return run


def search_text(docs: DataFrame, queries: DataFrame, k: int, *, id: str = "id", text: str = "text", query_id: str = "query_id", query_text: str = "text", tokenizer: str = "unicode", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, rank, id, distance (minus the BM25 score). Query terms count once each; only
    documents with a positive score are hits; documents without text aren't part of the corpus.

    One pass counts the documents of the asked terms, a second scores each task's documents against
    all queries and sends k rows per query over the shuffle: no posting and no pair of query and
    document is shuffled. Queries go to the tasks in blocks of at most TERMS_AT_ONCE terms.
    """
    check_k(k)
    spark = docs.sparkSession
    tokens = _tokens(docs, id, text, tokenizer)
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokenize(F.col(query_text), tokenizer))).alias("term")).where("query_id IS NOT NULL")
    asked = materialize(asked.distinct(), "asked-terms")
    blocks = max(1, -(-asked.count() // TERMS_AT_ONCE))
    n, avg = tokens.agg(F.count("*"), F.avg("length")).first()
    kind, qkind = tokens.schema["id"].dataType, queries.schema[query_id].dataType
    wanted = broadcast_if_small(asked.select("term").distinct(), 200_000)
    df = tokens.select(F.explode(F.array_distinct("t")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    known = materialize(asked.join(df, "term").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "known-terms")
    hits = None
    for block in range(blocks):
        by: dict = {}
        for r in known.where(F.col("block") == block).collect():
            by.setdefault(r["query_id"], []).append((r["term"], r["df"]))
        if not by:
            continue
        names = sorted(by)
        parts = []
        for lo in range(0, len(names), QUERY_BLOCK):
            some = names[lo : lo + QUERY_BLOCK]
            freq = {t: d for q in some for t, d in by[q]}
            terms = sorted(freq)
            place = {t: i for i, t in enumerate(terms)}
            m = np.zeros((len(terms), len(some)))
            for j, q in enumerate(some):
                m[[place[t] for t, _ in by[q]], j] = 1
            d = np.array([freq[t] for t in terms], float)
            parts.append((pa.array(terms), np.log(1 + (n - d + 0.5) / (d + 0.5)), m, list(range(lo, lo + len(some)))))
        schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
        found = tokens.select("id", "t").mapInArrow(_score(parts, (n, avg), k, k1, b), schema)
        table = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("n", T.IntegerType()), T.StructField("query_id", qkind)]))
        found = found.join(F.broadcast(table), "n").select("query_id", "id", (-F.col("score")).alias("distance"))  # a bounded block
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], T.StructType([T.StructField("query_id", qkind), T.StructField("id", kind), T.StructField("distance", T.DoubleType())]))
    return top_k(hits, k, 9)


def sound_sparse(s: Column) -> Column:
    """Whether a sparse vector has ascending indices, as many finite values, none negative."""
    n = F.size(s["indices"])
    ascending = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (n < 2) | (F.element_at(s["indices"], i) < F.get(s["indices"], i)))
    finite = F.forall(s["values"], lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    return F.coalesce((n == F.size(s["values"])) & ascending & finite, F.lit(False))


def sparse_postings(records: DataFrame, *, id: str = "id", sparse: str = "sparse", strict: bool = True) -> DataFrame:
    """id, term, weight of sparse vectors struct<indices, values>. When strict, vectors with indices
    that don't ascend, lengths that differ, or weights that are negative or not finite are an error;
    otherwise such vectors are left out."""
    s = F.col(sparse)
    good = sound_sparse(s)
    rows = records.where(s.isNotNull())
    if strict:
        checked = F.when(good, s).otherwise(F.raise_error(F.lit("bad sparse vector")).cast(records.schema[sparse].dataType))
        rows = rows.withColumn("__s", checked)
    else:
        rows = rows.where(good).withColumn("__s", s)
    return rows.select(F.col(id).alias("id"), F.explode(F.arrays_zip(F.col("__s.indices").alias("i"), F.col("__s.values").alias("v"))).alias("z")).select("id", F.col("z.i").alias("term"), F.col("z.v").cast("double").alias("weight"))


def search_sparse(records: DataFrame, queries: DataFrame, k: int, *, id: str = "id", sparse: str = "sparse", query_id: str = "query_id", query_sparse: str = "sparse", strict: bool = True) -> DataFrame:
    """query_id, rank, id, distance (minus the inner product over shared terms); positive ones only."""
    check_k(k)
    posts = sparse_postings(records, id=id, sparse=sparse, strict=strict)
    asked = sparse_postings(queries, id=query_id, sparse=query_sparse, strict=strict).select(F.col("id").alias("query_id"), "term", F.col("weight").alias("asked"))
    hits = posts.join(broadcast_if_small(asked, 200_000), "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("asked")).alias("dot"))
    return top_k(hits.where("dot > 0").select("query_id", "id", (-F.col("dot")).alias("distance")), k, 9)


def densify(sparse: Column, dims: int) -> Column:
    """array<double> of a sparse vector."""
    at = F.map_from_arrays(sparse["indices"].cast("array<bigint>"), sparse["values"].cast("array<double>"))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(at, i.cast("bigint")), F.lit(0.0)))


def is_sparse(vector: Column) -> Column:
    """Whether a vector is stored sparse: fewer than half of its coordinates aren't zero."""
    return F.size(F.filter(vector, lambda x: x != 0)) * 2 < F.size(vector)
