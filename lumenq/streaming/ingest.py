"""Streaming ingest into a collection: micro-batches appended once each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from lumenq.sources.collection import Collection
from lumenq.util import hadoop_path


def ingest(changes: DataFrame, collection: Collection, checkpoint: str, *, available_now: bool = True, interval: str = "2 seconds"):  # noqa: ANN201
    """Starts a query that applies a stream of (id, vector, text, metadata, op, seq) to a collection.

    Of the changes of an id the one of the largest seq wins, in whatever batches they arrive; op is put
    or delete. A batch that is run again after a failure is recognised by its number and the stream's
    id, which its checkpoint holds, and left out; several streams may feed one collection.
    """
    path = collection.path

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, p = hadoop_path(spark, f"{checkpoint.rstrip('/')}/metadata")
        s = fs.open(p)
        stream = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8"))["id"]
        s.close()
        rows = batch.persist()
        try:
            Collection(spark, path).apply(rows, number, stream)
        finally:
            rows.unpersist()

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
