"""The current version of versioned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """One row per key: the payload of the row with the largest order columns.

    Repeated rows collapse. Rows with a null key are void. Null order values stand below all
    others. Rows that tie in every order column are told apart by a hash of their payload, so the
    result doesn't depend on the input's order. A key that holds a large share of all rows is
    reduced before the shuffle (max_by has partial aggregates).
    """
    kept = rows.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*[F.col(c) for c in payload]))
    best = F.max_by(F.struct(*[F.col(c) for c in payload]), rank)
    return kept.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")
