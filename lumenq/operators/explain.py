"""What a search read and what it would cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class CostModel:
    """Price per million requests and per GiB read. The defaults."""

    per_million_requests: float = 0.40
    per_gib: float = 0.0

    def cost(self, requests: int, read_bytes: int) -> float:
        return requests / 1e6 * self.per_million_requests + read_bytes / 2**30 * self.per_gib


def guarantee(*, exact: bool, truncated: bool = False, filtered_cells: bool = False) -> str:
    """exact, approximate, or budget-complete: exact only when no budget cut anything off."""
    if exact and not truncated:
        return "exact"
    return "budget-complete" if exact else "approximate"


def report(cells: DataFrame, searched: DataFrame, rows: DataFrame, passed: DataFrame) -> DataFrame:
    """One row of counters: cells in all, searched, skipped; rows considered, and passed by the filter."""
    a = cells.agg(F.count("*").alias("segments_total"), F.coalesce(F.sum("n"), F.lit(0)).alias("records_total"))
    b = searched.select("cell_id").distinct().agg(F.count("*").alias("segments_searched"))
    c = rows.agg(F.count("*").alias("records_considered"))
    d = passed.agg(F.count("*").alias("rows_passed_filter"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).withColumn("segments_skipped", F.col("segments_total") - F.col("segments_searched"))


def physical_plan(df: DataFrame) -> str:
    """The formatted physical plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
