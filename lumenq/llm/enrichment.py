"""How characteristic a term is of a record: hypergeometric enrichment.

The record is a draw of n tokens from the M tokens of its group, of which K are the term. The score
is the negative natural logarithm of the probability of drawing the term k times or more, adjusted
for the number of terms of the record (Benjamini-Hochberg). A term that is everywhere is expected
and counts little; one mention of a term seen nowhere else has a probability of n / M only, so
repeated use of a term that a few records share stands above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.terms import term_counts
from lumenq.util import broadcast_if_small, materialize

# Coefficients of the Stirling series of the log-gamma function (fixed values: B(2n) / (2n (2n - 1)))
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of x > 0, to about 1e-14."""
    x = np.asarray(x, np.float64)
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        small = y < 10
        low += np.where(small, np.log(np.where(small, np.maximum(y, 1e-300), 1)), 0)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    tail = np.zeros_like(y)
    for c in reversed(STIRLING):
        tail = tail * z + c
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail / y - low


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def log_upper_tail(k: np.ndarray, n: np.ndarray, marked: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log P(X >= k) of a hypergeometric X: n draws from total, marked of them marked."""
    k, n, marked, total = (np.asarray(v, np.float64) for v in (k, n, marked, total))
    top = np.minimum(n, marked)
    x = np.maximum(k, np.maximum(0, n + marked - total))
    start = log_choose(marked, np.minimum(x, marked)) + log_choose(total - marked, n - x) - log_choose(total, n)
    log_sum = np.zeros_like(x)  # log of the sum of terms over the first one
    log_term = np.zeros_like(x)
    live = np.flatnonzero((x < top) & (k > 0))
    while len(live):
        x1 = x[live]
        ratio = (marked[live] - x1) * (n[live] - x1) / ((x1 + 1) * (total[live] - marked[live] - n[live] + x1 + 1))
        log_term[live] += np.log(ratio)
        log_sum[live] = np.logaddexp(log_sum[live], log_term[live])
        x[live] = x1 + 1
        more = (x[live] < top[live]) & ((ratio > 0.95) | (log_term[live] > log_sum[live] - 40))
        live = live[more]
    out = np.minimum(start + log_sum, 0.0)
    return np.where(k <= 0, 0.0, np.where(k > top, -np.inf, out))


def _per_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp, rec, items -> grp, rec, term, k, n: the occurrences of each term and of all terms."""
    for b in batches:
        t = pa.Table.from_batches([b])
        items = t["items"].combine_chunks()
        row = pc.list_parent_indices(items)
        flat = pc.list_flatten(items)
        if len(flat) == 0:
            continue
        term, n = pc.struct_field(flat, "term"), pc.struct_field(flat, "n")
        keep = pc.and_(pc.fill_null(pc.greater(n, 0), False), pc.is_valid(term))
        per = pa.table({"row": row, "term": term, "n": n}).filter(keep).group_by(["row", "term"]).aggregate([("n", "sum")])
        if not per.num_rows:
            continue
        at = per["row"].to_numpy()
        k = per["n_sum"].to_numpy()
        length = np.bincount(at, weights=k, minlength=t.num_rows).astype(np.int64)[at]
        rec = t.take(pa.array(at))
        yield from pa.table({"grp": rec["grp"], "rec": rec["rec"], "term": per["term"], "k": pa.array(k.astype(np.int64)), "n": pa.array(length)}).combine_chunks().to_batches()


def record_terms(rows: DataFrame, group: str, record: str, items: str, term: str, count: str) -> DataFrame:
    """grp, rec, term, k, n over one row per record; see terms.term_counts for what counts."""
    shaped = rows.select(
        F.col(f"`{group}`").alias("grp"),
        F.col(f"`{record}`").alias("rec"),
        F.transform(F.col(f"`{items}`"), lambda x: F.struct(x[term].alias("term"), x[count].cast("bigint").alias("n"))).alias("items"),
    ).where(F.size("items") > 0)
    kind = shaped.schema["items"].dataType.elementType["term"].dataType
    out = T.StructType(
        [shaped.schema["grp"], shaped.schema["rec"], T.StructField("term", kind), T.StructField("k", T.LongType()), T.StructField("n", T.LongType())]
    )
    return shaped.mapInArrow(_per_record, out)


@F.pandas_udf(T.DoubleType())
def _surprise(k, n, marked, total):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series(-log_upper_tail(k.to_numpy(), n.to_numpy(), marked.to_numpy(), total.to_numpy()))


def enrichment(rows: DataFrame, wanted: DataFrame, group: str, record: str, items: str, term: str, count: str) -> DataFrame:
    """grp, rec, term, k, n, occurrences, records, surprise, score of the terms of the wanted records.

    rows: one row per record, all records of the groups: the counts are over these. wanted: group
    and record of those to be scored (repeated rows count once; records unknown, or without any
    occurrence, give no row). surprise is the negative log probability, score the same adjusted for
    the number of terms of the record, 0 at least. Terms join their counts by (group, term); a term that
    stands in very many records is split over tasks by the engine's skew handling.
    """
    rows = materialize(rows.select(group, record, items), "enrichment-rows")
    counts = materialize(term_counts(rows, group, items, term, count), "enrichment-counts")
    total = counts.where("term IS NULL").select("grp", F.col("occurrences").alias("total"))
    chosen = rows.join(wanted.select(group, record).distinct(), [group, record], "left_semi")
    mine = record_terms(chosen, group, record, items, term, count)
    known = counts.where("term IS NOT NULL").select("grp", "term", "occurrences", "records")
    both = mine.join(known, ["grp", "term"]).join(broadcast_if_small(total, 100_000), "grp")
    scored = both.withColumn("surprise", _surprise("k", "n", "occurrences", "total"))
    w = Window.partitionBy("grp", "rec").orderBy(F.desc("surprise"), "term")
    every = Window.partitionBy("grp", "rec")
    at = scored.withColumn("__j", F.row_number().over(w)).withColumn("__m", F.count("*").over(every))
    adjusted = F.col("surprise") - F.log(F.col("__m") / F.col("__j"))
    onward = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    score = F.greatest(F.lit(0.0), F.max(adjusted).over(onward))
    return at.withColumn("score", score).select("grp", "rec", "term", "k", "n", "occurrences", "records", "surprise", "score")
