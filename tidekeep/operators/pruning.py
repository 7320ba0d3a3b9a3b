"""Run metadata, key-range (zone) pruning and Bloom filters over runs.

A table of runs has (run, key); its manifest is one row a run: (run, min_key, max_key, num_pairs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import positions


def manifest_of(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("num_pairs"))


def zone_overlap(manifest: DataFrame, low: int, high: int) -> DataFrame:
    """Runs whose key range meets [low, high]."""
    return manifest.where((F.col("max_key") >= low) & (F.col("min_key") <= high))


def zone_contains(probes: DataFrame, manifest: DataFrame, width: int) -> DataFrame:
    """(key, run) of every run whose range has the probed key.

    A range join without a nested loop: ranges are spread over the key cells of `width`
    that they touch, probes fall in one cell, and the join is an equality on cells.  Take
    about the usual span of a run for `width`, so that each is in a few cells.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    zones = manifest.select("run", "min_key", "max_key", F.explode(F.sequence(cell("min_key"), cell("max_key"))).alias("cell"))
    asked = probes.select("key", cell("key").alias("cell"))
    return asked.join(zones, "cell").where(F.col("key").between(F.col("min_key"), F.col("max_key"))).select("key", "run")


def bloom_size(manifest: DataFrame, bits_per_entry: int = 10) -> DataFrame:
    """(run, num_bits, num_bytes) of each run's filter."""
    bits = F.col("num_pairs") * bits_per_entry
    return manifest.select("run", bits.alias("num_bits"), F.ceil(bits / 8).cast("long").alias("num_bytes"))


def bloom_positions(runs: DataFrame, manifest: DataFrame, bits_per_entry: int = 10, hash_count: int = 3) -> DataFrame:
    """(run, pos): set bits of every run's filter."""
    sized = runs.join(manifest.select("run", (F.col("num_pairs") * bits_per_entry).alias("num_bits")), "run")
    return sized.select("run", F.explode(positions(F.col("key"), hash_count, F.col("num_bits"))).alias("pos")).distinct()


def bloom_probe(pairs: DataFrame, runs: DataFrame, manifest: DataFrame, bits_per_entry: int = 10, hash_count: int = 3) -> DataFrame:
    """Of probed (key, run), those that the run's filter does not exclude.

    A pair stays when all its positions are set; duplicate positions of one key count once.
    """
    bits = bloom_positions(runs, manifest, bits_per_entry, hash_count)
    sized = pairs.join(manifest.select("run", (F.col("num_pairs") * bits_per_entry).alias("num_bits")), "run")
    asked = sized.select("key", "run", F.array_distinct(positions(F.col("key"), hash_count, F.col("num_bits"))).alias("_all"))
    hits = asked.select("key", "run", F.size("_all").alias("need"), F.explode("_all").alias("pos")).join(bits, ["run", "pos"])
    return hits.groupBy("key", "run", "need").agg(F.count("*").alias("hit")).where("hit = need").select("key", "run")


def read_path(probes: DataFrame, runs: DataFrame, manifest: DataFrame, width: int, bits_per_entry: int = 10, hash_count: int = 3) -> DataFrame:
    """(key, value, run, zone_n, maybe_n) of every probed key over runs (run, key, value), of which a higher number is newer.

    Of the runs whose key range has the key (zone_n), the Bloom filters leave some (maybe_n),
    and only those are searched; the newest that has the key gives value and run, both null if
    none does.
    """
    zones = zone_contains(probes, manifest, width)
    maybe = bloom_probe(zones, runs.select("run", "key"), manifest, bits_per_entry, hash_count)
    searched = maybe.join(runs.select("run", "key", "value"), ["run", "key"], "left").groupBy("key").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("run"))).alias("value"), F.max(F.when(F.col("value").isNotNull(), F.col("run"))).alias("run"), F.count("*").alias("maybe_n")
    )
    counted = zones.groupBy("key").agg(F.count("*").alias("zone_n"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return probes.select("key").join(counted, "key", "left").join(searched, "key", "left").select("key", "value", "run", none("zone_n"), none("maybe_n"))


def bloom_quality(pairs: DataFrame, runs: DataFrame, manifest: DataFrame, bits_per_entry: int = 10, hash_count: int = 3) -> DataFrame:
    """One row: probed pairs, those the filters let through, and of these the ones that aren't in the run."""
    maybe = bloom_probe(pairs, runs, manifest, bits_per_entry, hash_count)
    real = runs.select("key", "run").distinct().withColumn("real", F.lit(1))
    through = maybe.join(real, ["key", "run"], "left").agg(F.count("*").alias("maybe_n"), F.count(F.when(F.col("real").isNull(), 1)).alias("false_n"))
    return pairs.agg(F.count("*").alias("probe_n")).join(through)  # one row each
