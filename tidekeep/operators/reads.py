"""Point, batched and range reads of a state of (key, value) pairs.

Filters are plain comparisons on the key, which reach the Parquet scan of stored runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TOMBSTONE
from .ranks import with_rank


def point_get(state: DataFrame, key: int) -> DataFrame:
    """The pair of one key, a tombstone included; no row if there is none."""
    return state.where(F.col("key") == key)


def range_scan(state: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs with low <= key <= high; an inverted range is empty."""
    return state.where(F.col("key").between(low, high))


def sorted_scan(state: DataFrame, low: int, high: int) -> DataFrame:
    """The same in key order."""
    return range_scan(state, low, high).orderBy("key")


def live(state: DataFrame) -> DataFrame:
    """Pairs that aren't deleted."""
    return state.where(F.col("value") != TOMBSTONE)


def scan_counts(state: DataFrame, low: int, high: int) -> DataFrame:
    """found_n (deleted ones included), shown_n and hidden_n of a range."""
    dead = F.col("value") == TOMBSTONE
    return range_scan(state, low, high).agg(F.count("*").alias("found_n"), F.count(F.when(~dead, 1)).alias("shown_n"), F.count(F.when(dead, 1)).alias("hidden_n"))


def multi_get(state: DataFrame, probes: DataFrame) -> DataFrame:
    """Every probed key with its value and whether it is found, deleted or not_found."""
    status = F.when(F.col("value").isNull(), "not_found").when(F.col("value") == TOMBSTONE, "deleted").otherwise("found")
    return probes.select("key").join(state, "key", "left").select("key", status.alias("status"), "value")


def in_order(state: DataFrame) -> DataFrame:
    """(pos, value): values in key order, positions from 1."""
    return with_rank(state).select((F.col("rank") + 1).cast("int").alias("pos"), "value")


def by_value_order(pairs: DataFrame) -> DataFrame:
    """Pairs ordered by key, then value, as a run writer sorts its input."""
    return pairs.orderBy("key", "value")
