"""Applying a change feed of upserts and deletes.

The feed is a stream of keyed changes with a sequence. State kept per key is the payload, the
sequence and the tombstone of the newest change seen; a change with a smaller sequence leaves it as
it is, so late, repeated and out-of-order deliveries do no harm. Each micro-batch emits the state of
the keys it touched, and writes it under its batch number: a batch that is run again overwrites its
own folder, so the output is idempotent. `live` reads the newest version of every key back.

State lives in RocksDB (off the heap, snapshots in the checkpoint folder), spread over the key's
hash; changes of a hot key are reduced to one row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.util import scratch_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flatten_writes(writes: DataFrame, payload: list[str]) -> DataFrame:
    """Rows ns, id, sequence, payload (null for a delete) of batched writes.

    writes: ns, hlc, writer (hex, either case), upsert_rows list<struct<id, ...>>, deletes
    list<string>. The sequence is (hlc, writer bytes, 0 for deletes and 1 for upserts, position):
    within a write deletes come first and a later entry replaces an earlier one. Null lists are
    empty; entries with a null or empty id are void; a null ns is a namespace of its own; a null
    hlc or writer stands below all others.
    """
    kinds = writes.schema["upsert_rows"].dataType.elementType
    empty = F.lit(None).cast(T.StructType([T.StructField(p, kinds[p].dataType) for p in payload]))
    version = [F.col("hlc"), F.unhex("writer")]
    # One generator over upserts and deletes together: the writes are read once.
    puts = F.transform(
        F.coalesce("upsert_rows", F.array().cast(writes.schema["upsert_rows"].dataType)),
        lambda x, i: F.struct(x["id"].alias("id"), F.lit(1).alias("kind"), i.alias("at"), F.struct(*[x[p].alias(p) for p in payload]).alias("row")),
    )
    drops = F.transform(
        F.coalesce("deletes", F.array().cast("array<string>")),
        lambda x, i: F.struct(x.alias("id"), F.lit(0).alias("kind"), i.alias("at"), empty.alias("row")),
    )
    return (
        writes.select("ns", *[v.alias(n) for v, n in zip(version, ("__hlc", "__writer"))], F.explode(F.concat(drops, puts)).alias("__c"))
        .where("__c.id IS NOT NULL AND __c.id <> ''")
        .select(
            "ns",
            F.col("__c.id").alias("id"),
            F.struct(F.col("__hlc").alias("hlc"), F.col("__writer").alias("writer"), F.col("__c.kind").alias("kind"), F.col("__c.at").alias("at")).alias("sequence"),
            F.col("__c.row").alias("payload"),
        )
    )


def newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the newest change: sequence, payload and tombstone (true when it is a delete). On a
    streaming DataFrame this is the keyed state; on a batch one the same in one step."""
    state = F.max_by(F.struct("sequence", "payload"), F.col("sequence"))
    return changes.groupBy(*keys).agg(state.alias("s")).select(
        *keys, "s.sequence", "s.payload", (F.col("s.sequence.kind") == 0).alias("tombstone")
    )


class ChangeTable:
    """The batch-versioned output of a feed in the folder at path."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def write(self, batch: DataFrame, number: int) -> None:
        """The sink of a micro-batch; writing the same number again replaces it."""
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/version={number}")

    def run(self, changes: DataFrame, **options: str) -> None:
        """Applies what the stream holds now, and returns. Called again with the same path it goes
        on behind what it had applied."""
        spark = self.spark
        held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        try:
            stream = (
                newest(changes, self.keys)
                .writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.path}/checkpoint")
                .trigger(availableNow=True)
            )
            for k, v in options.items():
                stream = stream.option(k, v)
            stream.foreachBatch(self.write).start().awaitTermination()
        finally:
            if held is None:
                spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
            else:
                spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)

    def versions(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/version=*")

    def newest(self) -> DataFrame:
        """The newest row of every key, tombstones included."""
        rows = self.versions()
        if rows.select("version").distinct().count() <= 1:
            return rows.drop("version")
        rest = [c for c in rows.columns if c not in [*self.keys, "version"]]
        best = F.max_by(F.struct(*rest), F.col("version"))
        return rows.groupBy(*self.keys).agg(best.alias("b")).select(*self.keys, "b.*")

    def live(self) -> DataFrame:
        """The live rows: keys and payload."""
        return self.newest().where(~F.col("tombstone")).select(*self.keys, "payload.*")


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream over the Parquet files of a folder, or over a single file."""
    head, _, tail = path.rpartition("/")
    glob = f"{head}/[{tail[0]}]{tail[1:]}" if tail.endswith(".parquet") else path
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(glob)


def apply_feed(spark: SparkSession, path: str, payload: list[str]) -> ChangeTable:
    """The table that the writes in the files at path leave behind."""
    schema = spark.read.parquet(path).schema
    rows = schema["upsert_rows"].dataType.elementType
    pruned = T.StructType(
        [
            *[schema[c] for c in ("ns", "hlc", "writer")],
            T.StructField("upsert_rows", T.ArrayType(T.StructType([f for f in rows.fields if f.name in {"id", *payload}]))),
            schema["deletes"],
        ]
    )
    table = ChangeTable(spark, scratch_path(spark, "feed"), ["ns", "id"])
    table.run(flatten_writes(stream_of(spark, path, pruned), payload))
    return table
