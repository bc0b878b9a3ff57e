"""Shared plumbing: the cluster's shared folder, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []
_roots: set[str] = set()


@atexit.register
def _clean() -> None:
    for path in _made:
        shutil.rmtree(path, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset and the master is local
    (tests), a temporary one is made and set; on a cluster a folder of one machine is no use, so there
    an unset one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lumenq-")
        _made.append(path)
        spark.sparkContext.setCheckpointDir(f"file://{path}")
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN201
    """The filesystem of a path, and the path, as the JVM knows them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, below one folder of the application, which the filesystem
    removes when the driver ends."""
    root = f"{shared_dir(spark)}/lumenq-{spark.sparkContext.applicationId}"
    if root not in _roots:
        fs, p = hadoop_path(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _roots.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a compact table in the shared folder and reads it back: lineage is cut, and a
    lost executor loses nothing, since the files belong to no executor."""
    path = scratch_path(df.sparkSession, label)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint when it is proven to have at most most_rows rows; otherwise df as
    it is, for Spark to join by shuffle. The proof costs a count of at most most_rows + 1 rows."""
    if df.limit(most_rows + 1).count() <= most_rows:
        return F.broadcast(df)
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def distinct_projection(df: DataFrame, keep: list[str], spread: list[str]) -> DataFrame:
    """The columns keep of df's rows, rows that are equal in all columns of df once.

    Rows are told apart by 128 hash bits of all columns (null marks included), so the shuffle
    carries keep and two numbers instead of the whole row. Rows meet by the columns spread, so that
    later steps on these find them together; a value of spread that holds more than half a
    partition's share of the rows (twice as many values as partitions at most) is spread over all
    partitions by the hash.
    """
    nulls = F.lit(0).cast("bigint")
    for i, c in enumerate(df.columns):
        nulls = nulls + F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i % 62)).otherwise(0)
    cols = [F.col(f"`{c}`") for c in df.columns]
    parts = shuffle_partitions(df.sparkSession)
    sizes = df.groupBy(*spread).count()
    rows = sizes.agg(F.sum("count")).first()[0] or 0
    hot = materialize(sizes.where(F.col("count") > rows / (2 * parts)).select(*[F.col(c).alias(f"__hot_{c}") for c in spread], F.lit(True).alias("__hot")), "hot")
    out = df.select(*keep, F.xxhash64(nulls, *cols).alias("__h1"), F.xxhash64(*reversed(cols), nulls).alias("__h2"))
    salt = F.lit(0).cast("bigint")
    if not hot.isEmpty():
        same = [F.col(c).eqNullSafe(F.col(f"__hot_{c}")) for c in spread]
        out = out.join(F.broadcast(hot), same, "left")  # at most 2 * parts rows
        salt = F.when(F.col("__hot"), F.pmod("__h1", F.lit(parts))).otherwise(0)
    return out.repartition(*[F.col(c) for c in spread], salt).select(*keep, "__h1", "__h2").dropDuplicates().select(*keep)


def spread(df: DataFrame) -> DataFrame:
    """df for row-by-row work in Python: over all cores where a scan has fewer parts than there are
    cores (a small file of one row group), else as it is."""
    sc = df.sparkSession.sparkContext
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    if df.rdd.getNumPartitions() >= sc.defaultParallelism:
        return df
    return df.repartition(sc.defaultParallelism)
