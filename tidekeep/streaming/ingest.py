"""Streaming ingest: every micro-batch of a write log becomes one run of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import encode_deletes, latest
from ..store import Store


def ingest(log: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a stream of (seq, key, value[, is_deleted]) rows into an open store.

    A batch keeps the last version of each key and is added as the newest run, which
    compacts the levels as any other run does.  What order batches come in doesn't matter:
    the last `seq` taken of each key is kept beside the stream's checkpoint, and a row that
    isn't later than that is left out.  So is a batch that is replayed after a failure, or
    it writes the same pairs again, which leaves the state as it is.
    """
    taken = f"{checkpoint}/taken"

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        plain = encode_deletes(batch) if "is_deleted" in batch.columns else batch
        new = plain.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
        if store.files.exists(taken):
            known = spark.read.parquet(taken).groupBy("key").agg(F.max("seq").alias("known"))
            new = new.join(known, "key", "left").where(F.col("known").isNull() | (F.col("seq") > F.col("known"))).drop("known")
        new = new.select("seq", "key", "value").persist()
        try:
            if not new.isEmpty():
                store.load(new)
                new.select("key", "seq").write.mode("append").parquet(taken)
        finally:
            new.unpersist()

    writer = log.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_state(log: DataFrame) -> DataFrame:
    """The latest state of a streaming log, for output mode `update` or `complete`; state is one row a key."""
    return latest(log)
