"""Byte-level BPE, encoding and decoding, on padded matrices.

Texts are cut into the tokenizer's matches by array operations on character classes.
Equal matches of a block are encoded once: they are put in buckets by length, one row of a
padded matrix each, and in every round each row merges its leftmost pair of least rank.
Pairs are looked up in an open-addressing hash table; rows without a pair left leave the
matrix.  Rows beyond `LONG` symbols (a match of thousands of letters) are merged alone, all
occurrences of the least pair in a round, which gives the same ids in far fewer rounds.

Null and empty texts give no ids.  Equal texts give equal rows.  Lone surrogates cannot
occur: Spark strings are UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textbatch import Block, blocks, distinct, quoted, same_bytes, span_codes

#: Longest row, in symbols, that the matrix takes.
LONG = 256
NONE = np.int32(2**31 - 1)
#: Bytes of text in a block: the more, the more often a match is there already.
BLOCK = 2_000_000

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            points = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            table[points] = kind
    return table


def _codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte each begins at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    if len(at) == len(data):
        return lead, at
    more = np.zeros(len(data) + 3, np.uint32)
    more[: len(data)] = data & 0x3F
    two, three, four = lead >= 0xC0, lead >= 0xE0, lead >= 0xF0
    points = lead.copy()
    k = at[two & ~three]
    points[two & ~three] = (lead[two & ~three] & 0x1F) << 6 | more[k + 1]
    k = at[three & ~four]
    points[three & ~four] = (lead[three & ~four] & 0x0F) << 12 | more[k + 1] << 6 | more[k + 2]
    k = at[four]
    points[four] = (lead[four] & 0x07) << 18 | more[k + 1] << 12 | more[k + 2] << 6 | more[k + 3]
    return points, at


def matches(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all matches of the pattern (every byte is in one), and each document's first match.

    The pattern is: contractions | ?letters | ?numbers | ?others | spaces before the last | spaces.
    """
    if not len(block.data):
        return np.zeros(0, np.int64), np.zeros(block.count + 1, np.int64)
    points, at = _codepoints(block.data)
    n = len(points)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, block.offsets)] = True
    edge[n] = True
    first = edge[:-1]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[0] = 255
    dark = kind != SPACE
    run = first | (kind != before)
    cut = run.copy()
    # white space: its last character stands apart if something follows; a plain space joins what follows
    follows = np.zeros(n, bool)
    follows[:-1] = dark[1:] & ~edge[1:-1]
    last = ~dark & follows
    cut |= last
    plain = np.zeros(n, bool)
    plain[1:] = last[:-1] & (points[:-1] == 0x20)
    cut &= ~(plain & dark)
    # contractions: an apostrophe that begins a match and the letters after it
    quote = np.flatnonzero((points == 0x27) & cut)
    if len(quote):
        end = np.flatnonzero(edge)
        limit = end[np.searchsorted(end, quote, "right")]
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = pad[quote + 1], pad[quote + 2]
        ok1 = np.isin(one, [ord(c) for c in "stmd"]) & (quote + 1 < limit)
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        ok2 = pair & (quote + 2 < limit) & ~ok1
        for which, size in ((ok1, 1), (ok2, 2)):
            q = quote[which]
            cut[q + 1] = False
            nxt = q + 1 + size
            nxt = nxt[nxt < n]
            cut[nxt] |= (kind[nxt] == LETTER) | first[nxt]
    starts = at[cut]
    return starts, np.searchsorted(starts, block.offsets)


class HashTable:
    """Open addressing with linear probing from non-negative 64-bit keys to 32-bit values, in numpy."""

    def __init__(self, room: int) -> None:
        bits = max(10, int(np.ceil(np.log2(room + 1))) + 2)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        self.room, self.filled = room, 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys; in each round every free slot takes one of those that want it."""
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self._keys[at] < 0
            self._keys[at[free]] = keys[todo[free]]
            won = self._keys[at] == keys[todo]
            self._values[at[won]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self._mask
        self.filled += len(keys)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, NONE for those not there."""
        slot = self._slot(keys)
        found = self._keys[slot]
        hit = found == keys
        out = np.where(hit, self._values[slot], NONE)
        todo = np.flatnonzero(~hit & (found >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self._mask
            found = self._keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self._values[slot[hit]]
            on = ~hit & (found >= 0)
            todo, slot = todo[on], slot[on]
        return out


class PairMerger:
    """Merges rows of symbols; a pair's value is the merged symbol, and less goes first."""

    def __init__(self, symbols: dict) -> None:
        """symbols: every string (or bytes) of the vocabulary and its rank, which is also its id."""
        left, right, merged = [], [], []
        for whole, rank in symbols.items():
            for k in range(1, len(whole)):
                a, b = symbols.get(whole[:k]), symbols.get(whole[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self._pairs = HashTable(len(left))
        self._pairs.put(np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(merged, np.int32))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the merged pair, NONE where there is none or where right is padding (-1)."""
        return self._pairs.get(left.astype(np.int64) << 32 & 0x7FFFFFFF00000000 | (right.astype(np.int64) & 0xFFFFFFFF))

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Merge the rows of an (n, width) matrix of ids, padded with -1; result padded alike."""
        n, width = rows.shape
        done = np.full((n, width), -1, np.int32)
        if width == 1:
            return rows.astype(np.int32)
        live, cells = np.arange(n), rows.astype(np.int32)
        ranks = self.rank(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(n, width - 1)
        while True:
            place = ranks.argmin(axis=1)  # the leftmost of the least
            least = ranks[np.arange(len(live)), place]
            stay = least != NONE
            if not stay.all():
                done[live[~stay], : cells.shape[1]] = cells[~stay]
                live, cells, ranks, place, least = live[stay], cells[stay], ranks[stay], place[stay], least[stay]
            if not len(live):
                return done
            # compaction: drop the right half of the pair, which shortens every row by one
            w = cells.shape[1]
            line = np.arange(len(live))
            keep = np.ones(cells.shape, bool)
            keep[line, place + 1] = False
            cells[line, place] = least
            cells = cells[keep].reshape(len(live), w - 1)
            keep = np.ones(ranks.shape, bool)
            keep[line, place] = False
            if w == 2:
                done[live, :1] = cells
                return done
            ranks = ranks[keep].reshape(len(live), w - 2)
            has = place < w - 2
            ranks[line[has], place[has]] = self.rank(cells[line[has], place[has]], cells[line[has], place[has] + 1])
            has = place > 0
            ranks[line[has], place[has] - 1] = self.rank(cells[line[has], place[has] - 1], cells[line[has], place[has]])

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row.  All occurrences of the least pair merge together unless that makes a pair that should have gone first."""
        ids = ids.astype(np.int32)
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            gap = np.diff(at) == 1
            if gap.any():  # of a run of overlapping pairs, every other one
                lead = np.concatenate([[True], ~gap])
                start = np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            for only in (at, at[:1]):
                merged = ids.copy()
                merged[only] = least
                kept = np.ones(len(ids), bool)
                kept[only + 1] = False
                new = merged[kept]
                again = self.rank(new[:-1], new[1:])
                half = only[only + 2 < len(ids)]
                early = self.rank(np.full(len(half), least, np.int32), ids[half + 2])
                if len(only) == 1 or ((not len(again) or not (again[self._touched(only, kept, len(new))] <= least).any()) and not (early <= least).any()):
                    break
            ids, ranks = new, again
        return ids

    @staticmethod
    def _touched(only: np.ndarray, kept: np.ndarray, n: int) -> np.ndarray:
        place = (np.cumsum(kept) - 1)[only]
        out = np.concatenate([place, place - 1])
        return out[(out >= 0) & (out < n - 1)]


class ByteBPE(PairMerger):
    """A vocabulary of byte strings whose rank is their id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.joined = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.begin = np.cumsum(self.lengths) - self.lengths
        super().__init__(ranks)
        self.added: dict[bytes, int] = {}
        codes = span_codes(self.joined, self.begin, self.begin + self.lengths)
        order = np.argsort(codes)
        self.whole_code, self.whole_id = codes[order], order.astype(np.int32)

    @classmethod
    def from_file(cls, path: str) -> ByteBPE:
        """A .tiktoken file: one base64 token and its rank a line."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    @classmethod
    def from_json(cls, path: str) -> ByteBPE:
        """A tokenizers file of a byte-level BPE whose merges are in the order of its ids; its added tokens are cut out of texts."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token.encode() not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][a + b] for a, b in merges]
        if order != sorted(order) or spec["normalizer"] or spec["model"]["ignore_merges"] or not spec["pre_tokenizer"]["use_regex"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level BPE with merges in the order of ids")
        own = cls(ranks)
        own.added = added
        return own

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans, one after another, and how many each has.  Equal spans are encoded once."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        some, own, codes = distinct(data, starts, ends)
        ids, count = self._encode_distinct(data, starts[some], ends[some], codes)
        begin = np.cumsum(count) - count
        begin = begin[own]
        count = count[own]
        place = np.cumsum(count) - count
        return ids[np.arange(int(count.sum())) + np.repeat(begin - place, count)], count

    def _encode_distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(starts), ends - starts
        count = np.ones(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.minimum(np.searchsorted(self.whole_code, codes), len(self.whole_code) - 1)
        whole = self.whole_code[at] == codes
        token = self.whole_id[at]
        check = np.flatnonzero(whole & (size >= 8))
        whole[check] = (self.lengths[token[check]] == size[check]) & same_bytes(data, starts[check], self.joined, self.begin[token[check]], np.minimum(size[check], self.lengths[token[check]]))
        rows = np.flatnonzero(whole)
        parts.append((rows, token[rows][:, None]))
        rest = np.flatnonzero(~whole)
        rest = rest[np.argsort(size[rest], kind="stable")]
        short = rest[size[rest] <= LONG]
        width = size[short]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(width)) + 1, [len(short)]]) if len(short) else np.zeros(1, int)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            step = max(1, 2_000_000 // int(width[a]))
            for c in range(a, b, step):
                rows = short[c : min(b, c + step)]
                cells = self.byte_ids[data[starts[rows][:, None] + np.arange(int(width[a]))]]
                parts.append((rows, self.merge_rows(cells)))
        parts += [(np.array([r]), self.merge_long(self.byte_ids[data[starts[r] : ends[r]]])[None, :]) for r in rest[size[rest] > LONG]]
        for rows, cells in parts:
            count[rows] = (cells >= 0).sum(axis=1)
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for rows, cells in parts:
            real = cells >= 0
            out[(begin[rows][:, None] + np.arange(cells.shape[1]))[real]] = cells[real]
        return out, count

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's documents and the bounds of each document's ids (count + 1 entries)."""
        starts, first = matches(block)
        ends = np.append(starts[1:], len(block.data)) if len(starts) else starts
        ids, count = self.encode_spans(block.data, starts, ends)
        bounds = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=bounds[1:])
        return ids, bounds[first]

    def encode_with_added(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """As encode_block, but an added token's string in a text becomes that token (the earliest first, of those the longest)."""
        if not self.added:
            return self.encode_block(block)
        pattern = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        raw = block.data.tobytes()
        at = []
        if pattern.search(raw):  # else there is none in any document
            cuts = block.offsets.tolist()
            at = [(m.start() + a, m.end() + a, self.added[m[0]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for m in pattern.finditer(raw[a:b])]
        if not at:
            return self.encode_block(block)
        starts, ends, tokens = (np.array(x) for x in zip(*at, strict=True))
        edges = np.unique(np.concatenate([block.offsets, starts, ends]))
        ids, bounds = self.encode_block(Block(block.data, edges, block.first))
        k = np.searchsorted(edges, starts)
        keep = np.ones(len(ids), bool)
        for a, b in zip(bounds[k].tolist(), bounds[k + 1].tolist(), strict=True):
            ids[a], keep[a + 1 : b] = -1, False
        ids[bounds[k]] = tokens
        left = np.concatenate([[0], np.cumsum(keep)])
        return ids[keep], left[bounds[np.searchsorted(edges, block.offsets)]]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for."""
        size = self.lengths[ids]
        to = np.cumsum(size)
        if not len(size):
            return np.zeros(0, np.uint8)
        return self.joined[np.arange(int(to[-1])) + np.repeat(self.begin[ids] - (to - size), size)]


@lru_cache(4)
def load(path: str) -> ByteBPE:
    """One vocabulary a process and path."""
    return ByteBPE.from_json(path) if path.endswith(".json") else ByteBPE.from_file(path)


def encode(docs: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and `ids` (array of int) of each document; null and empty texts give an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK):
                ids, bounds = bpe.encode_block(block)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.count), lists], [key, "ids"])

    picked = docs.select(quoted(key), quoted(text))
    return picked.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """`key` and `data` (binary): the bytes of each array of ids; a null array gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            out = [None if row is None else bpe.decode(np.asarray(row, np.int32)).tobytes() for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "data"])

    picked = encoded.select(quoted(key), quoted(ids))
    return picked.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, data binary")


def round_trip(docs: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text, decode the ids, and digest both: n_tokens, ids_sha256, decoded_sha256.

    One pass over the table without a shuffle; memory is that of one block of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK):
                ids, bounds = bpe.encode_block(block)
                raw, data = ids.astype("<u4"), bpe.decode(ids)
                size = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(bpe.lengths[ids], out=size[1:])
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                cut = size[bounds].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.count),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in spans]),
                        pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    picked = docs.select(quoted(key), quoted(text))
    return picked.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
