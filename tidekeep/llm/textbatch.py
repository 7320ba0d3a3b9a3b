"""Array views of Arrow text columns.

Text operators work on UTF-8 bytes of many documents at once.  The helpers here hand out
bounded blocks of documents (never part of one), find words and lines in them and hash
them, all with numpy, so that no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text in a block; one longer document is a block of its own.
BLOCK_BYTES = 500_000

_SEED = np.uint64(0xA24BAED4963EE407)
_FIRST = np.uint64(0xD1B54A32D192ED03)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
_WIDE = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The code of what x stands for, followed by what y stands for; not linear in either."""
    return mix(mix(x + _FIRST) * _SEED + y)


def _padded(data: np.ndarray) -> np.ndarray:
    """The bytes, followed by eight more: what `_chunk` reads from."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[:-8] = data
    return out


def _chunk(padded: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The (at most eight) bytes from each `at` as numbers; size may be more."""
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return np.ascontiguousarray(eight[at]).view("<u8").ravel() & _MASKS[np.minimum(size, 8)]


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit codes of byte spans: of up to seven bytes exact (never shared), of more a hash with the top bit set.

    No code is linear in the bytes, so no arrangement of repeated parts makes two spans alike.
    """
    size, padded = ends - starts, _padded(data)
    out = _chunk(padded, starts, size)
    out |= np.minimum(size, 7).astype(np.uint64) << np.uint64(56) & np.where(size < 8, np.uint64(2**64 - 1), np.uint64(0))
    more = np.flatnonzero(size >= 8)
    if not len(more):
        return out
    code = mix(out[more] + size[more].astype(np.uint64) * _SEED)
    on = np.flatnonzero((size[more] > 8) & (size[more] <= _WIDE))
    done = 8
    while len(on):
        rows = more[on]
        code[on] = chain(code[on], _chunk(padded, starts[rows] + done, size[rows] - done))
        done += 8
        on = on[size[rows] > done]
    wide = np.flatnonzero(size[more] > _WIDE)
    if len(wide):
        raw = memoryview(np.ascontiguousarray(data))
        spans = zip(starts[more[wide]].tolist(), ends[more[wide]].tolist(), strict=True)
        code[wide] = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in spans), "<u8")
    out[more] = code | np.uint64(1 << 63)
    return out


def same_bytes(data: np.ndarray, at: np.ndarray, other: np.ndarray, its: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[at : at + size] equals other[its : its + size], pair by pair."""
    a, b = _padded(data), _padded(other)
    out, on, done = np.ones(len(at), bool), np.flatnonzero(size > 0), 0
    while len(on):
        if done >= _WIDE:  # what is long is compared at once
            x, y = memoryview(np.ascontiguousarray(data)), memoryview(np.ascontiguousarray(other))
            for k in on.tolist():
                out[k] = x[at[k] : at[k] + size[k]] == y[its[k] : its[k] + size[k]]
            return out
        left = size[on] - done
        equal = _chunk(a, at[on] + done, left) == _chunk(b, its[on] + done, left)
        out[on[~equal]] = False
        done += 8
        on = on[equal & (left > 8)]
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(some, own, codes): a span for each different one, the place in `some` of each span's equal, and the codes of `some`.

    Spans are equal if their bytes are: those of one code are compared.
    """
    codes = span_codes(data, starts, ends)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(fresh) - 1
    some = order[fresh]
    size = ends - starts
    check = np.flatnonzero(size >= 8)
    check = check[some[own[check]] != check]
    lead = some[own[check]]
    odd = check[(size[check] != size[lead]) | ~same_bytes(data, starts[check], data, starts[lead], np.minimum(size[check], size[lead]))]
    if len(odd):  # two spans of one code: each stands for itself
        own[odd] = len(some) + np.arange(len(odd))
        some = np.concatenate([some, odd])
    return some, own, codes[some]


def run_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """Codes of every run of `width` codes, one for each place that a run begins at."""
    have, size, out, filled = codes, 1, None, 0
    while True:
        if width & size:  # runs of powers of two, the least first, one after another
            out = have if out is None else chain(out[: max(len(codes) - filled - size + 1, 0)], have[filled:])
            filled += size
        if filled == width:
            return out[: max(len(codes) - width + 1, 0)]
        have, size = chain(have[: max(len(have) - size, 0)], have[size:]), 2 * size


class Block:
    """Some whole documents: `data` is their UTF-8, document i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first = data, offsets, first
        self.count = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words in bytes, and each document's first word (count + 1 entries)."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.count + 1, np.int64)
        dark = np.zeros(len(self.data) + 1, bool)
        np.logical_not(SPACES[self.data], out=dark[:-1])
        begins = dark[:-1].copy()
        begins[1:] &= ~dark[:-2]
        cut = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        begins[cut] |= dark[cut]
        stops = np.zeros(len(self.data) + 1, bool)
        stops[1:] = dark[:-1] & ~dark[1:]
        cut = self.offsets[1:][self.offsets[1:] > 0]
        stops[cut] |= dark[cut - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_codes(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words (of `data` in place of the block's own, if given) and each document's first word."""
        starts, ends, first = self.words()
        return span_codes(self.data if data is None else data, starts, ends), first


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's texts in order, in blocks of about `limit` bytes; null is the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def quoted(name: str) -> str:
    """A column name as schema strings and expressions want it."""
    return "`" + name.replace("`", "``") + "`"


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of every run of `width` words inside one document, and the runs' document."""
    count = np.maximum(np.diff(first) - (width - 1), 0)
    doc = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + within, doc


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive `bounds`."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
