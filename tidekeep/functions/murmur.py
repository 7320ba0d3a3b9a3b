"""MurmurHash3 (x86, 32 bits) of strings, as an expression on unsigned 32-bit numbers held in longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
_C1, _C2, _ADD, _FINAL = 0xCC9E2D51, 0x1B873593, 0xE6546B64, (0x85EBCA6B, 0xC2B2AE35)
_ALL = 0xFFFFFFFF


def _times(x: Column, c: int) -> Column:
    """Modulo 2**32, in halves, so that no product leaves 63 bits."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(x, 16)
    return (low * F.lit(c) + F.shiftleft((high * F.lit(c)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_ALL))


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 32 - by)).bitwiseAND(F.lit(_ALL))


def _shifted(x: Column, by: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, by))


def _word(digits: Column, at: Column) -> Column:
    """Up to four bytes from byte `at` of hexadecimal digits, the first lowest; those beyond the end are 0."""
    byte = lambda k: F.coalesce(F.conv(F.nullif(F.substring(digits, 2 * (at + k) + 1, F.lit(2)), F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long"))
    out = byte(0)
    for k in (1, 2, 3):
        out = out.bitwiseOR(F.shiftleft(byte(k), 8 * k))
    return out


def murmur3_32(text: Column, seed: int = 0) -> Column:
    """The hash of the text's UTF-8 as a non-negative long; null stays null."""
    digits = F.hex(F.encode(text, "utf-8"))
    size = F.octet_length(text)
    whole = F.floor(size / 4).cast("int")
    scramble = lambda w: _times(_rotated(_times(w, _C1), 15), _C2)
    step = lambda h, k: (_times(_rotated(h.bitwiseXOR(scramble(_word(digits, 4 * k))), 13), 5) + F.lit(_ADD)).bitwiseAND(F.lit(_ALL))
    body = F.aggregate(F.slice(F.sequence(F.lit(0), whole), F.lit(1), whole), F.lit(seed).cast("long"), step)
    tail = F.when(size % 4 == 0, F.lit(0).cast("long")).otherwise(scramble(_word(digits, 4 * whole)))

    def final(h: Column) -> Column:
        h = _times(_shifted(h, 16), _FINAL[0])
        return _shifted(_times(_shifted(h, 13), _FINAL[1]), 16)

    mixed = F.transform(F.array(body.bitwiseXOR(tail).bitwiseXOR(size.cast("long"))), final)  # once, though it is used often
    return F.when(text.isNotNull(), F.element_at(mixed, 1))
