"""Schemas and options shared by all parts of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: The value that stands for a deleted key at the API.
TOMBSTONE = -1
INT_MIN, INT_MAX = -(2**31), 2**31 - 1

#: Pairs in a leaf page, and children of an internal node.
LEAF_PAIRS, FANOUT = 512, 1025

PAIRS = T.StructType([T.StructField("key", T.IntegerType(), False), T.StructField("value", T.IntegerType(), False)])
LOG = T.StructType([T.StructField("seq", T.LongType(), False), *PAIRS.fields, T.StructField("is_deleted", T.BooleanType(), False)])
MANIFEST = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        T.StructField("sst_number", T.IntegerType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("min_key", T.IntegerType(), False),
        T.StructField("max_key", T.IntegerType(), False),
        T.StructField("num_pairs", T.LongType(), False),
    ]
)


@dataclass
class Options:
    """capacity: distinct keys held before a run is written; the Bloom options hold for every run."""

    capacity: int = 1000
    bits_per_entry: int = 10
    hash_count: int = 3
    search_mode: str = "btree"

    def __post_init__(self) -> None:
        if self.capacity < 1 or self.bits_per_entry < 1 or self.hash_count < 1:
            raise ValueError("capacity, bits_per_entry and hash_count must be positive")
        if self.search_mode not in ("btree", "binary"):
            raise ValueError("search_mode is btree or binary")
