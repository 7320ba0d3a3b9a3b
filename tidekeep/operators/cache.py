"""Simulation of a page cache with CLOCK eviction, and statistics of its hash table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.murmur import murmur3_32


class Clock:
    """A cache of `capacity` pages.  Pages enter with their reference bit set; a hit sets it again.

    The hand passes over pages, clearing set bits, and takes the first that is clear; the
    freed slot is the next to be filled.
    """

    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ValueError("a cache holds one page at least")
        self.pages: list[str | None] = [None] * capacity
        self.bits = [False] * capacity
        self.slot: dict[str, int] = {}
        self.free: list[int] = []
        self.filled = self.hand = 0

    def __len__(self) -> int:
        return len(self.slot)

    def access(self, page: str) -> tuple[bool, str | None]:
        """Whether it was a hit, and the page evicted to make room."""
        if page in self.slot:
            self.bits[self.slot[page]] = True
            return True, None
        evicted = self.evict() if len(self.slot) == len(self.pages) else None
        if self.free:
            at = self.free.pop()
        else:
            at, self.filled = self.filled, self.filled + 1
        self.pages[at], self.bits[at], self.slot[page] = page, True, at
        return False, evicted

    def evict(self) -> str:
        if not self.slot:
            raise ValueError("nothing to evict")
        while True:
            at = self.hand
            self.hand = (at + 1) % len(self.pages)
            page = self.pages[at]
            if page is None:
                continue
            if self.bits[at]:
                self.bits[at] = False
                continue
            self.remove(page)
            return page

    def remove(self, page: str) -> bool:
        at = self.slot.pop(page, None)
        if at is None:
            return False
        self.pages[at], self.bits[at] = None, False
        self.free.append(at)
        return True


def clock_trace(trace: DataFrame, capacity: int) -> DataFrame:
    """(trace_id, step, page, hit, evicted) of traces (trace_id, step, page); each trace has a cache of its own.

    Rows of a trace arrive in order of step, and a task holds only the cache.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = None, Clock(capacity)
        for frame in frames:
            hits, gone = [], []
            for own, page in zip(frame["trace_id"], frame["page"], strict=True):
                if own != now:
                    now, cache = own, Clock(capacity)
                hit, evicted = cache.access(page)
                hits.append(hit)
                gone.append(evicted)
            yield frame.assign(hit=pd.Series(hits, index=frame.index, dtype=bool), evicted=pd.Series(gone, index=frame.index, dtype=object))

    picked = trace.select(F.col("trace_id").cast("int"), F.col("step").cast("int"), F.col("page").cast("string"))
    return picked.repartition("trace_id").sortWithinPartitions("trace_id", "step").mapInPandas(run, "trace_id int, step int, page string, hit boolean, evicted string")


def hit_rate(simulated: DataFrame) -> DataFrame:
    """(trace_id, accesses, hits, evictions) of simulated traces."""
    return simulated.groupBy("trace_id").agg(F.count("*").alias("accesses"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count("evicted").alias("evictions"))


def bucket_count(wanted: int) -> int:
    """The power of two that a table of so many buckets gets."""
    return 1 << max(0, wanted - 1).bit_length()


def with_bucket(pages: DataFrame, buckets: int) -> DataFrame:
    """Pages (file_name, offset) with the bucket that their text form falls in."""
    name = F.concat_ws(":", "file_name", F.col("offset").cast("string"))
    return pages.withColumn("bucket", (murmur3_32(name) % bucket_count(buckets)).cast("int"))


def bucket_stats(pages: DataFrame, buckets: int) -> DataFrame:
    """One row: size, num_buckets, load_factor, max_chain, mean_chain of buckets in use, empty_buckets."""
    n = bucket_count(buckets)
    chains = with_bucket(pages, buckets).groupBy("bucket").agg(F.count("*").alias("chain"))
    return chains.agg(
        F.coalesce(F.sum("chain"), F.lit(0)).alias("size"),
        F.lit(n).alias("num_buckets"),
        (F.coalesce(F.sum("chain"), F.lit(0)) / n).alias("load_factor"),
        F.coalesce(F.max("chain"), F.lit(0)).alias("max_chain"),
        F.coalesce(F.avg("chain"), F.lit(0.0)).alias("mean_chain"),
        (F.lit(n) - F.count("*")).alias("empty_buckets"),
    )
