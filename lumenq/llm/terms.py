"""How often every distinct term occurs, by recursive radix spilling.

Each task first reduces its own rows to one partial count per term. The partials are written to
the shared folder, split by leading bits of a hash of the term. A split that holds more than
max_rows partials is split again by the next bits, until every leaf fits. Each leaf is then
aggregated by DuckDB, which reads the leaf's files as a stream under a memory limit and spills to
the shared folder. A term that stands in every record has at most one partial per flush of a task,
so no leaf is unbounded because of one hot term.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.util import broadcast_if_small, materialize, scratch_path, shuffle_partitions

HASH_BITS = 64
FLUSH_ROWS = 400_000


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns grp, items list<struct<term, n>> -> grp, term, occurrences, records; a row with null
    term holds the group's totals."""
    held: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        t = pa.concat_tables(held).group_by(["grp", "term"]).aggregate([("occurrences", "sum"), ("records", "sum")])
        return pa.table({"grp": t["grp"], "term": t["term"], "occurrences": t["occurrences_sum"], "records": t["records_sum"]})

    for batch in batches:
        table = pa.Table.from_batches([batch])
        items = table["items"].combine_chunks()
        flat = pc.list_flatten(items)
        if len(flat) == 0:
            continue
        row = pc.list_parent_indices(items)
        n = pc.cast(pc.struct_field(flat, "n"), pa.int64())
        term = pc.struct_field(flat, "term")
        grp = pc.take(table["grp"].combine_chunks(), row)
        keep = pc.and_(pc.fill_null(pc.greater(n, 0), False), pc.is_valid(term))
        t = pa.table({"grp": grp, "row": row, "term": term, "n": n}).filter(keep)
        if t.num_rows == 0:
            continue
        per = t.group_by(["grp", "row", "term"]).aggregate([("n", "sum")])
        by_term = per.group_by(["grp", "term"]).aggregate([("n_sum", "sum"), ("row", "count")])
        total = per.group_by(["grp"]).aggregate([("n_sum", "sum"), ("row", "count_distinct")])
        held.append(pa.table({"grp": by_term["grp"], "term": by_term["term"], "occurrences": by_term["n_sum_sum"], "records": by_term["row_count"]}))
        held.append(pa.table({"grp": total["grp"], "term": pa.nulls(total.num_rows, term.type), "occurrences": total["n_sum_sum"], "records": total["row_count_distinct"]}))
        rows += held[-1].num_rows + held[-2].num_rows
        if rows > FLUSH_ROWS:
            one = merged()
            if one.num_rows > FLUSH_ROWS // 2:
                yield from one.combine_chunks().to_batches(max_chunksize=50_000)
                held, rows = [], 0
            else:
                held, rows = [one], one.num_rows
    if held:
        yield from merged().combine_chunks().to_batches(max_chunksize=50_000)


def _leaf_counts(base: str, memory: str) -> object:
    """A function for mapInArrow: rows (leaf path) -> the leaf's counts, aggregated by DuckDB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.dataset as ds
        import pyarrow.fs as pfs

        for batch in batches:
            for leaf in batch.column(0).to_pylist():
                fs, path = pfs.FileSystem.from_uri(leaf)
                leaf_data = ds.dataset(path, filesystem=fs, format="parquet")  # noqa: F841 (read by name below)
                con = duckdb.connect()
                con.execute("SET threads=1")
                con.execute(f"SET memory_limit='{memory}'")
                spill = ""
                if isinstance(fs, pfs.LocalFileSystem):  # the shared folder is mounted
                    spill = f"{pfs.FileSystem.from_uri(base)[1]}/duckdb-{uuid.uuid4().hex}"
                    con.execute(f"SET temp_directory='{spill}'")
                else:  # DuckDB can't spill there; leaves are sized to fit the limit
                    con.execute("SET temp_directory=''")
                con.register("leaf_data", leaf_data)
                out = con.sql(
                    "SELECT grp, term, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(records) AS BIGINT) AS records "
                    "FROM leaf_data GROUP BY grp, term"
                )
                yield from out.to_arrow_reader(50_000)
                con.close()
                if spill and os.path.isdir(spill):
                    import shutil

                    shutil.rmtree(spill, ignore_errors=True)

    return run


def radix_counts(partials: DataFrame, *, max_rows: int = 2_000_000, memory: str = "256MB") -> DataFrame:
    """grp, term, occurrences, records summed over partials of the same columns.

    max_rows bounds the partials of a leaf; memory is DuckDB's limit per task. A leaf whose hash
    bits are used up is aggregated as it is (DuckDB spills).
    """
    spark = partials.sparkSession
    root = scratch_path(spark, "radix")
    bits = max(4, (shuffle_partitions(spark) - 1).bit_length())
    level, depth, leaves = 0, bits, []
    rows = partials.withColumn("h", F.xxhash64("grp", "term"))
    while True:
        path = f"{root}/level={level}"
        (
            rows.withColumn("radix", F.shiftrightunsigned("h", HASH_BITS - depth))
            .repartition(1 << bits, "radix")
            .write.partitionBy("radix")
            .parquet(path)
        )
        stored = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("radix", T.LongType())])).parquet(path)
        sizes = stored.groupBy("radix").count().collect()  # at most 2**bits rows a split
        over = [r["radix"] for r in sizes if r["count"] > max_rows and depth + bits <= HASH_BITS]
        leaves += [f"{path}/radix={r['radix']}" for r in sizes if r["radix"] not in set(over)]
        if not over:
            break
        rows = stored.where(F.col("radix").isin(over)).drop("radix")
        level, depth = level + 1, depth + bits
    kind = partials.schema
    if not leaves:
        return spark.createDataFrame([], kind)
    many = spark.createDataFrame([(x,) for x in leaves], "leaf string").repartition(min(len(leaves), 4 * (1 << bits)))
    return many.mapInArrow(_leaf_counts(root, memory), kind)


def term_counts(rows: DataFrame, group: str, items: str, term: str, count: str, **how: object) -> DataFrame:
    """Per group and term: occurrences (sum of counts) and records (rows holding the term).

    rows: one row per record; items: an array of structs with fields term and count. A term may
    stand twice in one array (its counts add up); counts that are null, zero or negative are no
    occurrence; null and empty arrays count nothing. A row with a null term holds the group's
    totals: all occurrences, and the records with any occurrence. A null group is a group of its
    own. Empty input gives an empty result; further columns are ignored.
    """
    shaped = rows.select(
        F.col(f"`{group}`").alias("grp"),
        F.transform(F.col(f"`{items}`"), lambda x: F.struct(x[term].alias("term"), x[count].cast("bigint").alias("n"))).alias("items"),
    )
    kind = shaped.schema["items"].dataType.elementType["term"].dataType
    out = T.StructType(
        [
            T.StructField("grp", shaped.schema["grp"].dataType),
            T.StructField("term", kind),
            T.StructField("occurrences", T.LongType()),
            T.StructField("records", T.LongType()),
        ]
    )
    partials = shaped.where(F.size("items") > 0).mapInArrow(_partials, out)
    return radix_counts(partials, **how)


def marked_terms(counts: DataFrame, *, common_share: float = 0.25, rare_records: int = 2) -> DataFrame:
    """counts of term_counts with the group's totals and a mark: 'common' when more than
    common_share of the group's records hold the term, else 'rare' when at most rare_records do,
    else null."""
    kept = materialize(counts, "term-counts")
    totals = kept.where("term IS NULL").select(
        F.col("grp").alias("__g"), F.col("records").alias("group_records"), F.col("occurrences").alias("group_occurrences")
    )
    joined = kept.where("term IS NOT NULL").join(broadcast_if_small(totals, 100_000), F.col("grp").eqNullSafe(F.col("__g"))).drop("__g")
    mark = F.when(F.col("records") > F.col("group_records") * F.lit(common_share), "common").when(F.col("records") <= rare_records, "rare")
    return joined.withColumn("mark", mark)
