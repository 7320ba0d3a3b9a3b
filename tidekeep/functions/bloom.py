"""Bloom filter positions as integer expressions, equal in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
_GOLDEN = 0x9E3779B9


def position(key: Column, i: Column, bits: Column) -> Column:
    """Bit of hash i: (u32(key) + i * u32(key xor golden ratio)) mod bits, in 64-bit arithmetic."""
    k = key.cast("long")
    return (k.bitwiseAND(F.lit(_MASK)) + i.cast("long") * k.bitwiseXOR(F.lit(_GOLDEN)).bitwiseAND(F.lit(_MASK))) % bits.cast("long")


def positions(key: Column, hash_count: int, bits: Column) -> Column:
    """Array of the positions of hashes 0 to hash_count - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(hash_count - 1)), lambda i: position(key, i, bits))
