"""Flush epochs of a write log, and the shape of the levels that they leave.

A memory table holds `capacity` distinct keys.  When a write comes while it is full, it is
flushed first and the write opens the next epoch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flush_epochs(log: DataFrame, capacity: int, store: str = "store") -> DataFrame:
    """(store, epoch, first_seq, last_seq, min_key, max_key, num_keys, num_writes, flushed) of each store's log (store, seq, key).

    Where an epoch ends depends on where the one before did, so a store is one pass in the
    order of seq.  Rows arrive sorted and a task holds one epoch's keys, at most `capacity`;
    different stores run side by side.  The last epoch, full or not, is still in memory.
    """
    names = [store, "epoch", "first_seq", "last_seq", "min_key", "max_key", "num_keys", "num_writes", "flushed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, epoch, keys, first, last, writes = None, 0, set(), None, None, 0

        def row(flushed: bool) -> tuple:
            return (now, epoch, first, last, min(keys), max(keys), len(keys), writes, flushed)

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for own, seq, key in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if own != now or len(keys) >= capacity:
                    if keys:
                        rows.append(row(own == now))
                    epoch = epoch + 1 if own == now else 0
                    now, keys, first, writes = own, set(), seq, 0
                keys.add(key)
                last, writes = seq, writes + 1
            if len(rows) > 10_000:
                yield batch_of(rows)
                rows = []
        if keys:
            rows.append(row(False))
        if rows:
            yield batch_of(rows)

    ordered = log.select(F.col(store).cast("int"), F.col("seq").cast("long"), F.col("key").cast("int")).repartition(store).sortWithinPartitions(store, "seq")
    return ordered.mapInArrow(run, f"{store} int, epoch int, first_seq long, last_seq long, min_key int, max_key int, num_keys int, num_writes long, flushed boolean")


def level_shape(flushes: DataFrame, capacity: int, count: str = "flushes") -> DataFrame:
    """(level, num_pairs) after so many flushes of distinct keys: level i has a run of capacity * 2**i if bit i is set."""
    bits = flushes.select(F.col(count).cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(30))).alias("level"))
    return bits.where("(n >> level) & 1 = 1").select("level", (F.lit(capacity).cast("long") * F.expr("shiftleft(1L, level)")).alias("num_pairs"))


def memtable_status(epochs: DataFrame, capacity: int, store: str = "store") -> DataFrame:
    """(store, size, capacity, fill_percent) of what is still in memory."""
    held = epochs.where("not flushed")
    return held.select(store, F.col("num_keys").alias("size"), F.lit(capacity).alias("capacity"), F.round(F.col("num_keys") * 100.0 / capacity, 1).alias("fill_percent"))
