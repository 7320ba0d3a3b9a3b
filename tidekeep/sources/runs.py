"""Sorted runs as Parquet directories.

A run is sorted by key inside each file and range-partitioned across files, so that key
ranges of row groups don't overlap and a pushed filter skips all but a few of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAIRS, Options

#: Pairs in a file; a run of fewer is one file.
FILE_PAIRS = 20_000_000


def write_run(pairs: DataFrame, path: str, options: Options, most: int) -> None:
    """Write pairs of unique keys, of which there are at most `most`; the plan of `pairs` runs once."""
    files = max(1, -(-most // FILE_PAIRS))
    laid = pairs.select(F.col("key").cast("int").alias("key"), F.col("value").cast("int").alias("value"))
    laid = laid.repartition(1) if files == 1 else laid.repartitionByRange(files, "key")  # a merge above stays in many tasks
    rate = 0.6185 ** options.bits_per_entry  # what that many bits give at best
    writer = laid.sortWithinPartitions("key").write.mode("errorifexists")
    writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, most // files))).option("parquet.bloom.filter.fpp#key", f"{max(rate, 1e-9):.9f}")
    writer.parquet(path)


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pairs of several runs, of which only the named ones are opened."""
    return spark.read.schema(PAIRS).parquet(*paths) if paths else spark.createDataFrame([], PAIRS)


def describe(pairs: DataFrame, unique: bool = False) -> tuple[int, int, int] | None:
    """(min_key, max_key, num_pairs), None if empty.  Unless keys are known to be unique, they are checked."""
    keys = F.count("*") if unique else F.count_distinct("key")
    row = pairs.agg(F.min("key"), F.max("key"), F.count("*"), keys).first()
    if not row[2]:
        return None
    if row[2] != row[3]:
        raise ValueError("a run must not hold a key twice")
    return row[0], row[1], row[2]
