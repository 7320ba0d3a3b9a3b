"""Positions in key order without moving all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that the key range is cut into; their sizes are the only thing that is summed in one place.
BUCKETS = 4096


def with_rank(pairs: DataFrame, key: str = "key", rank: str = "rank") -> DataFrame:
    """Pairs of unique int keys with their 0-based position in key order.

    The key range is cut into equal buckets.  Keys are unique, so a bucket has at most its
    width in rows; sizes of the buckets (at most BUCKETS + 1 rows) give each its first
    position, and rows are ranked within their bucket.
    """
    span = pairs.agg(F.min(F.col(key).cast("long")).alias("_low"), F.max(F.col(key).cast("long")).alias("_high"))
    span = span.select("_low", F.greatest(F.ceil((F.col("_high") - F.col("_low") + 1) / BUCKETS), F.lit(1)).cast("long").alias("_width"))
    placed = pairs.join(F.broadcast(span)).withColumn("_bucket", F.floor((F.col(key) - F.col("_low")) / F.col("_width")).cast("int")).drop("_low", "_width")  # one row
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("_bucket", before.alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return placed.withColumn("_inside", inside).join(F.broadcast(first), "_bucket").withColumn(rank, (F.col("_first") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_first")
