"""Latest-wins state and merges of sorted runs.

All of these are hash aggregations or equality joins on the key.  Aggregations combine on
the map side, so that a key with any number of versions sends one row a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TOMBSTONE


def latest(log: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """The last version of every key; `seq` must be unique within a key."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value))


def encode_deletes(log: DataFrame) -> DataFrame:
    """A log with is_deleted as one with tombstone values."""
    return log.withColumn("value", F.when(F.col("is_deleted"), F.lit(TOMBSTONE)).otherwise(F.col("value"))).drop("is_deleted")


def merge_runs(newer: DataFrame, older: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """Pairs of both runs, of equal keys those of the newer.

    Tombstones stay unless the target is the last level, where nothing older is left to hide.
    """
    n, o = newer.select("key", F.col("value").alias("new_value")), older.select("key", F.col("value").alias("old_value"))
    out = n.join(o, "key", "full_outer").select("key", F.coalesce("new_value", "old_value").alias("value"))
    return out.where(F.col("value") != TOMBSTONE) if drop_tombstones else out


def priority_union(sources: list[DataFrame], rank: str = "source") -> DataFrame:
    """Of every key, the pair of the first source that has it, and that source's place in the list."""
    tagged = reduce(DataFrame.unionByName, [s.select("key", "value").withColumn(rank, F.lit(k)) for k, s in enumerate(sources)])
    return by_priority(tagged, rank)


def by_priority(pairs: DataFrame, rank: str = "level") -> DataFrame:
    """Of every key, the pair of the least rank; ties must not occur within a rank."""
    return pairs.groupBy("key").agg(F.min_by(F.struct("value", rank), rank).alias("_p")).select("key", "_p.value", f"_p.{rank}")
