"""One ranking from several differently scaled scores, by robust rank aggregation.

Each score becomes a rank among the query's items, divided by their number. Of an item's sorted
normalised ranks r1 <= ... <= rm, the k-th is at most that small with probability
P(Beta(k, m - k + 1) <= rk) if ranks were random. The smallest of these over k, times m, is the
item's significance; items are ordered by it. No score's range plays a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.llm.bloom import Bloom, bloom_of
from lumenq.util import broadcast_if_small, materialize, shuffle_partitions


def mid_ranks(rows: DataFrame, group: list[str], by: str, *, hot: int = 1_000_000) -> DataFrame:
    """rows with rank: the position of by (ascending, from 1) in its group, ties at their mean.

    A group of over hot rows is spread by ranges of by over tasks; a range's rank is its local rank
    plus the rows of the ranges before it. Only ranges that continue a group have such an offset: as
    many as partitions at most.
    """
    order = Window.partitionBy(*group).orderBy(by)
    ties = Window.partitionBy(*group, by)
    mean = lambda first, same: first + (same - 1) / F.lit(2.0)
    large = materialize(rows.groupBy(*group).count().where(F.col("count") > hot).select(*group), "hot-groups")
    if large.isEmpty():
        tied = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
        return rows.withColumn("rank", mean(F.rank().over(order), tied))
    large = broadcast_if_small(large, 100_000)
    usual = mid_ranks(rows.join(large, group, "left_anti"), group, by, hot=2**62)
    parts = rows.join(large, group, "left_semi").repartitionByRange(shuffle_partitions(rows.sparkSession), *group, by)
    parts = materialize(parts.withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*group, "__p").count()
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("__o", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = Window.partitionBy("__p", *group).orderBy(by)
    same = F.count("*").over(local.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = parts.withColumn("rank", mean(F.rank().over(local), same)).join(F.broadcast(offset), [*group, "__p"])
    return usual.unionByName(ranked.withColumn("rank", F.col("rank") + F.col("__o")).drop("__p", "__o"))


def significance(ranks: list[Column]) -> Column:
    """The corrected minimum of the beta order-statistic probabilities of normalised ranks."""
    m = len(ranks)
    r = F.array_sort(F.array(*ranks))
    probs = []
    for k in range(1, m + 1):
        x = r[k - 1]
        probs.append(reduce(lambda a, b: a + b, [F.lit(float(comb(m, j))) * F.pow(x, F.lit(j)) * F.pow(1 - x, F.lit(m - j)) for j in range(k, m + 1)]))
    return F.least(F.lit(1.0), m * F.least(*probs)) if m > 1 else F.least(F.lit(1.0), probs[0])


def aggregate_ranks(items: DataFrame, scores: DataFrame, query: str, item: str, leg: str, score: str, legs: list[str]) -> DataFrame:
    """query, item, significance, mean_rank and the normalised rank of each leg.

    items: the query's items; scores: their scores per leg, smaller is better. Null and NaN scores
    are none; of several scores of an item in a leg the best counts; an item without a score in a
    leg stands last there (1.0). Legs that aren't listed are left out, items that aren't in items too.
    """
    every = items.select(query, item).where(F.col(query).isNotNull() & F.col(item).isNotNull()).distinct()
    size = every.groupBy(query).agg(F.count("*").alias("__n"))
    usable = scores.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(leg).isin(legs))
    best = materialize(usable.groupBy(query, leg, item).agg(F.min(score).alias("__s")), "leg-scores")
    ranked = mid_ranks(best, [query, leg], "__s")
    wide = ranked.groupBy(query, item).agg(*[F.min(F.when(F.col(leg) == x, F.col("rank"))).alias(f"__{i}") for i, x in enumerate(legs)])
    both = every.join(wide, [query, item], "left").join(size, query)
    cols = [F.coalesce(F.col(f"__{i}") / F.col("__n"), F.lit(1.0)) for i in range(len(legs))]
    named = both.select(query, item, *[c.alias(f"rank_{x}") for c, x in zip(cols, legs)])
    ranks = [F.col(f"rank_{x}") for x in legs]
    return named.withColumns({"significance": significance(ranks), "mean_rank": reduce(lambda a, b: a + b, ranks) / len(legs)})


def _asked_terms(bloom: Bloom):  # noqa: ANN202
    """mapInArrow: (index_name, id, terms) -> per row its length n and the terms that may be asked for,
    each once; and rows without an id: the number of rows and the sum of n of an index in this batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            lists = t["terms"].combine_chunks()
            flat = pc.list_flatten(lists)
            if not len(flat):
                continue
            row, term, tf = pc.list_parent_indices(lists), pc.struct_field(flat, "term_id"), pc.cast(pc.struct_field(flat, "tf"), pa.int64())
            keep = pc.and_(pc.fill_null(pc.greater(tf, 0), False), pc.is_valid(term))
            row, term, tf = (x.filter(keep).to_numpy(zero_copy_only=False) for x in (row, term, tf))
            n = np.bincount(row, weights=tf, minlength=t.num_rows).astype(np.int64)
            ok = bloom.has(term.view(np.uint64))
            per = pa.table({"row": row[ok], "term": term[ok], "tf": tf[ok]}).group_by(["row", "term"]).aggregate([("tf", "sum")]).sort_by("row")
            at = per["row"].to_numpy()
            some = np.unique(at)
            hits = pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(at, some), len(at)].astype(np.int32)), pa.StructArray.from_arrays([per["term"].combine_chunks(), per["tf_sum"].combine_chunks()], names=["term", "tf"]))
            mine = t.take(pa.array(some))
            yield from pa.table({"index_name": mine["index_name"], "id": mine["id"], "rows": pa.nulls(len(some), pa.int64()), "n": n[some], "hits": hits}).combine_chunks().to_batches()
            live = n > 0
            total = pa.table({"index_name": t["index_name"].filter(pa.array(live)), "n": n[live]}).group_by("index_name").aggregate([("n", "count"), ("n", "sum")])
            k = total.num_rows
            yield from pa.table({"index_name": total["index_name"], "id": pa.nulls(k, t["id"].type), "rows": total["n_count"], "n": total["n_sum"], "hits": pa.nulls(k, hits.type)}).combine_chunks().to_batches()

    return run


def fit(candidates: DataFrame, asked: DataFrame, current: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score: minus the BM25 of the query's terms in the candidate's current row.

    candidates: query_id, id; asked: query_id, query_terms (array of term ids, each once); current:
    index_name, record_id, terms, one row per record. One pass over the current rows keeps of each its
    length and the terms that some query asks for (by a Bloom filter of these); only they are counted
    for the document frequencies, and meet the candidates. Candidates without a row, or with none of
    the terms, get no score; an occurrence is a tf above 0.
    """
    wanted = asked.select(F.explode(F.col("query_terms").cast("array<bigint>")).alias("h")).where("h IS NOT NULL").distinct()
    rows = current.select("index_name", F.col("record_id").alias("id"), "terms").where("id IS NOT NULL AND size(terms) > 0")
    kinds = f"index_name {rows.schema['index_name'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}"
    slim = materialize(rows.mapInArrow(_asked_terms(bloom_of(wanted)), f"{kinds}, rows bigint, n bigint, hits array<struct<term: bigint, tf: bigint>>"), "asked-terms")
    totals = slim.where("id IS NULL").groupBy("index_name").agg(F.sum("rows").alias("docs"), (F.sum("n") / F.sum("rows")).alias("avg"))
    held = slim.where("id IS NOT NULL")
    df = held.select("index_name", F.explode("hits.term").alias("term")).groupBy("index_name", "term").agg(F.count("*").alias("df"))
    df = materialize(df, "asked-frequencies")
    both = candidates.join(asked, "query_id").join(held.select("index_name", "id", "n", "hits"), "id")
    hit = F.filter("hits", lambda t: F.array_contains("query_terms", t["term"]))
    tf = both.select("query_id", "id", "index_name", "n", F.inline(hit))
    joined = tf.join(broadcast_if_small(df, 200_000), ["index_name", "term"]).join(broadcast_if_small(totals, 100_000), "index_name")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("avg")))
    return joined.groupBy("query_id", "id").agg((-F.sum(weight)).alias("score"))
