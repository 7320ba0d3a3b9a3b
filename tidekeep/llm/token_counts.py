"""Exact token counts of a piece-wise BPE model at every prefix, by dynamic programming.

A sequence of pieces is what BPE gives for their joined text if and only if it gives every
adjacent pair for that pair's text.  So the last piece of the encoding of a prefix is the
one piece that ends there and agrees with the last piece of the prefix before it, and one
pass over the text yields the exact count of every prefix.  `PrefixCounter.prefixes` keeps
these counts: where to cut a text for a budget, or what a truncated text costs, is then a
lookup without encoding again.

No piece goes on after a space has followed a letter, nor over a character outside the
vocabulary (which costs its UTF-8 bytes).  Texts therefore fall into segments, and the
pass runs once over the distinct segments of a block, all at the same position at a time.
Segments beyond `LONG` characters take the same pass alone, in time linear in their length.

Null and empty texts count 0 tokens.  Special strings inside texts are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .bpe import NONE, HashTable, PairMerger, _codepoints
from .textbatch import Block, blocks, distinct, quoted

SPACE = 0x2581
LONG = 256
#: Pairs of pieces whose agreement a process remembers; beyond it the memory starts anew.
PAIRS = 1 << 20


class PrefixCounter:
    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = range(model.get_piece_size())
        pieces = [(-model.get_score(i), i, model.id_to_piece(i)) for i in rows if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any("▁" in p.lstrip("▁") for _, _, p in pieces):
            raise ValueError("a piece goes on after an inner space; segments would not be independent")
        spaces = {len(p) for _, _, p in pieces if set(p) == {"▁"}}
        if any(p.startswith("▁▁") and set(p) != {"▁"} for _, _, p in pieces):
            raise ValueError("a run of spaces is part of a longer piece")
        self.longest_space = max(spaces)
        runs = [0] + [len(x) for x in model.encode([" " * k for k in range(1, 4 * self.longest_space)])]
        self.space_runs = np.array([0, 1, *runs[1:]][: self.longest_space])  # by number of spaces, the one before the text included
        if any(self.spaces(np.array([k + 1]))[0] != n for k, n in enumerate(runs) if k):
            raise ValueError("runs of spaces are not counted by their longest piece")
        self.texts = [p for _, _, p in sorted(pieces) if not p.startswith("▁▁")]
        self.ids = {p: k for k, p in enumerate(self.texts)}
        self.merger = PairMerger(self.ids)
        self.size = np.array([len(p) for p in self.texts])
        self.longest = int(self.size.max())
        self.known = np.zeros(0x110000, bool)
        self.single = np.full(0x110000, -1, np.int32)
        for p, k in self.ids.items():
            if len(p) == 1:
                self.known[ord(p)], self.single[ord(p)] = True, k
        self.bare = self.ids["▁"]
        points = np.frombuffer("".join(self.texts).encode("utf-32-le"), np.uint32)
        self.begin = np.cumsum(self.size) - self.size
        self.points = points
        # pieces that the merges can't make never end a prefix
        made = self._join(np.arange(len(self.texts)), None)
        self._grow([(k, self.texts[k]) for k in np.flatnonzero(made).tolist()])
        self._reach = {p for p, ok in zip(self.texts, made.tolist(), strict=True) if ok}
        self._agree = HashTable(PAIRS)

    def _grow(self, pieces: list[tuple[int, str]]) -> None:
        """A tree of characters: `_next` leads from node and character to the next node, `_ends` has the piece that ends there, or -1."""
        nodes: dict[tuple[int, str], int] = {}
        ends = [-1]
        for k, piece in pieces:
            at = 0
            for c in piece:
                if (at, c) not in nodes:
                    nodes[at, c] = len(ends)
                    ends.append(-1)
                at = nodes[at, c]
            ends[at] = k
        self._ends = np.array(ends, np.int32)
        self._next = HashTable(len(nodes))
        self._next.put(np.array([at << 21 | ord(c) for at, c in nodes], np.int64), np.array(list(nodes.values()), np.int32))

    def spaces(self, n: np.ndarray) -> np.ndarray:
        """Tokens of runs of n spaces: pieces of the greatest length, then those of what is left."""
        return n // self.longest_space + self.space_runs[n % self.longest_space]

    def _join(self, left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
        """Whether the merges give just these pieces for their joined text."""
        la = self.size[left]
        lb = self.size[right] if right is not None else np.zeros(len(left), int)
        width = int((la + lb).max())
        col = np.arange(width)
        at = self.begin[left][:, None] + col
        if right is not None:
            at = np.where(col < la[:, None], at, self.begin[right][:, None] + col - la[:, None])
        inside = col < (la + lb)[:, None]
        cells = np.where(inside, self.single[self.points[np.where(inside, at, 0)]], -1).astype(np.int32)
        cells = np.pad(cells, ((0, 0), (0, max(0, 3 - width))), constant_values=-1)
        out = self.merger.merge_rows(cells)
        if right is None:
            return (out[:, 0] == left) & (out[:, 1] < 0)
        return (out[:, 0] == left) & (out[:, 1] == right) & (out[:, 2] < 0)

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        known = self._agree.get(keys)
        new = known == NONE
        if new.any():
            fresh = np.unique(keys[new])
            if self._agree.filled + len(fresh) > self._agree.room:
                self._agree = HashTable(max(PAIRS, len(fresh)))
            a, b = fresh >> 32, fresh & 0xFFFFFFFF
            values = np.concatenate([self._join(a[k : k + 50_000], b[k : k + 50_000]) for k in range(0, len(fresh), 50_000)]).astype(np.int32)
            self._agree.put(fresh, values)
            known[new] = values[np.searchsorted(fresh, keys[new])]
        return known == 1

    def _pass(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every position of the segments (row by row), and whether the encoding begins with a bare space."""
        width = int(size.max())
        row_of = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(row_of)) - np.repeat(np.cumsum(size) - size, size)
        place = begin[row_of] + within
        ends, lens, rows, toks = [], [], [], []
        alive, node = np.arange(len(row_of)), np.zeros(len(row_of), np.int64)
        for n in range(1, min(self.longest, width) + 1):
            ok = within[alive] + n <= size[row_of[alive]]
            alive = alive[ok]
            node = self._next.get(node[ok] << 21 | points[place[alive] + n - 1].astype(np.int64))
            ok = node != NONE
            alive, node = alive[ok], node[ok].astype(np.int64)
            token = self._ends[node]
            hit = token >= 0
            rows.append(row_of[alive[hit]]), toks.append(token[hit])
            ends.append(within[alive[hit]] + n), lens.append(np.full(int(hit.sum()), n))
        ends, lens, rows, toks = map(np.concatenate, (ends, lens, rows, toks))
        order = np.argsort(ends, kind="stable")
        ends, lens, rows, toks = ends[order], lens[order], rows[order], toks[order]
        cuts = np.searchsorted(ends, np.arange(1, width + 2))
        last = np.full((len(size), width + 1), -1, np.int32)
        count = np.zeros((len(size), width + 1), np.int64)
        bare = np.zeros((len(size), width + 1), bool)
        for i in range(1, width + 1):
            c = slice(cuts[i - 1], cuts[i])
            r, t, j = rows[c], toks[c], i - lens[c]
            before = last[r, j]
            start = j == 0
            good = start.copy()
            other = np.flatnonzero(~start & (before >= 0))
            good[other] = self.agree(before[other], t[other])
            r, t, j, start = r[good], t[good], j[good], start[good]
            last[r, i] = t
            count[r, i] = count[r, j] + 1
            bare[r, i] = np.where(start, t == self.bare, bare[r, j])
        keep = np.arange(1, width + 1) <= size[:, None]
        return count[:, 1:][keep], bare[:, 1:][keep]

    def _long(self, text: str) -> tuple[list[int], list[bool]]:
        """The same pass over one segment of any length."""
        last, count, bare, memo = [-1], [0], [False], {}
        for i in range(1, len(text) + 1):
            for n in range(1, min(self.longest, i) + 1):
                piece = text[i - n : i]
                if piece not in self._reach:
                    continue
                t, j = self.ids[piece], i - n
                if j and (last[j], t) not in memo:
                    memo[last[j], t] = bool(self.agree(np.array([last[j]]), np.array([t]))[0])
                if not j or memo[last[j], t]:
                    last.append(t), count.append(count[j] + 1), bare.append(bare[j] if j else t == self.bare)
                    break
        return count[1:], bare[1:]

    def _segments(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per segment the place of its first entry in the flat counts, which equal segments share; counts and bare flags."""
        some, own, _ = distinct(points.astype("<u4").view(np.uint8), 4 * begin, 4 * end)
        size = (end - begin)[some]
        order = np.argsort(size, kind="stable")
        counts, bares, at, done, k = [], [], np.zeros(len(some), np.int64), 0, 0
        short = int(np.searchsorted(size[order], LONG, "right"))
        while k < short:
            low = int(size[order[k]])
            to = min(short, int(np.searchsorted(size[order], max(low + low // 4, 8), "right")), k + max(1, 400_000 // max(low, 1)))
            rows = order[k:to]
            c, b = self._pass(points, begin[some[rows]], size[rows])
            at[rows] = done + np.cumsum(size[rows]) - size[rows]
            counts.append(c), bares.append(b)
            done, k = done + len(c), to
        for r in order[short:]:
            c, b = self._long(points[begin[some[r]] : end[some[r]]].astype("<u4").tobytes().decode("utf-32-le"))
            at[r] = done
            counts.append(np.array(c)), bares.append(np.array(b, bool))
            done += len(c)
        return at[own], np.concatenate(counts or [np.zeros(0, np.int64)]), np.concatenate(bares or [np.zeros(0, bool)]), end - begin

    def _layout(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Code points with the space that the model puts before every text that isn't empty, and document bounds."""
        points, at = _codepoints(block.data)
        bounds = np.searchsorted(at, block.offsets)
        full = np.flatnonzero(np.diff(bounds))
        points = np.insert(np.where(points == 0x20, SPACE, points), bounds[full], SPACE)
        shift = np.zeros(block.count + 1, np.int64)
        shift[full + 1] = 1
        return points, bounds + np.cumsum(shift)

    def _steps(self, points: np.ndarray, bounds: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where parts of the text end and what they add to the count.

        With `every`, also the count at each position relative to that before the part it is in.
        """
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        blank = points == SPACE
        body = self.known[points] & ~blank

        def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pad = np.zeros(n + 2, bool)
            pad[1:-1] = flag
            return np.flatnonzero(pad[1:-1] & (~pad[:-2] | edge[:-1])), np.flatnonzero(pad[1:-1] & (~pad[2:] | edge[1:])) + 1

        part_at, part_add = [], []
        odd = np.flatnonzero(~body & ~blank)
        width = 1 + (points[odd] >= 0x80) + (points[odd] >= 0x800) + (points[odd] >= 0x10000)
        part_at.append(odd + 1), part_add.append(width.astype(np.int64))
        rs, re = runs(blank)
        bs, be = runs(body)
        spaced = np.zeros(n + 1, bool)
        spaced[re] = True
        spaced[edge.nonzero()[0]] = False
        lead = spaced[bs]
        begin = bs - lead
        at, counts, bares, size = self._segments(points, begin, be)
        run_size = (re - rs).astype(np.int64)
        total_run = self.spaces(run_size)
        run_no = np.searchsorted(re, bs)  # the run that ends where a spaced body begins
        part_at.append(re), part_add.append(total_run)
        local = None
        final, final_bare = counts[at + size - 1], bares[at + size - 1]
        own = np.zeros(len(bs), np.int64)
        own[lead] = run_size[run_no[lead]]
        spent = self.spaces
        adjust = np.where(lead, np.where(final_bare, spent(own) + final - 1, spent(np.maximum(own - 1, 0)) + final) - spent(own), final)
        part_at.append(be), part_add.append(adjust)
        if every:
            local = np.zeros(n + 1, np.int64)
            length = be - bs
            seg = np.repeat(np.arange(len(bs)), length)
            within = np.arange(len(seg)) - np.repeat(np.cumsum(length) - length, length)
            entry = at[seg] + lead[seg] + within
            c, b, ld, o = counts[entry], bares[entry], lead[seg], own[seg]
            local[bs[seg] + within + 1] = np.where(ld, np.where(b, spent(o) + c - 1, spent(np.maximum(o - 1, 0)) + c) - spent(o), c)
            rseg = np.repeat(np.arange(len(rs)), run_size)
            rin = np.arange(len(rseg)) - np.repeat(np.cumsum(run_size) - run_size, run_size)
            local[rs[rseg] + rin + 1] = spent(rin + 1)
            local[odd + 1] = width
        return np.concatenate(part_at), np.concatenate(part_add), local

    def totals(self, block: Block) -> np.ndarray:
        """Tokens of each document of the block."""
        points, bounds = self._layout(block)
        if not len(points):
            return np.zeros(block.count, np.int64)
        at, add, _ = self._steps(points, bounds, False)
        sums = np.zeros(len(points) + 1, np.int64)
        np.add.at(sums, at, add)
        sums = np.cumsum(sums)
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def prefixes(self, text: str) -> np.ndarray:
        """Exact token count of text[:k] for every k from 0 to len(text)."""
        data = np.frombuffer(text.encode(), np.uint8)
        block = Block(data, np.array([0, len(data)]), 0)
        points, bounds = self._layout(block)
        if not len(points):
            return np.zeros(1, np.int64)
        at, add, local = self._steps(points, bounds, True)
        sums = np.zeros(len(points) + 1, np.int64)
        np.add.at(sums, at, add)
        start = np.zeros(len(points) + 1, np.int64)
        start[at] = at
        sums = np.cumsum(sums)
        # the last part that ended before each position
        done = np.maximum.accumulate(start)
        before = np.concatenate([[0], done[:-1]])
        out = sums[before] + local
        out[0] = 0
        return np.concatenate([[0], out[2:]])

    def fit(self, text: str, budget: int) -> int:
        """Most characters of the text whose encoding has no more than `budget` tokens, so that no longer prefix fits."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])


@lru_cache(4)
def load(path: str) -> PrefixCounter:
    """One model a process and path."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and `counts` (array of int): entry k is the exact token count of the first k characters.

    Null and empty texts give [0].  The counts answer any truncation or budget without encoding again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(model_path)
        for batch in batches:
            for k, value in enumerate(batch.column(1).to_pylist()):
                counts = pa.array([counter.prefixes(value or "").astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), counts], [key, "counts"])

    picked = docs.select(quoted(key), quoted(text))
    return picked.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, counts array<int>")


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, n_bytes, n_tokens and over_limit of every whole text; one pass, no shuffle, a block in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(model_path)
        for batch in batches:
            for block in blocks(batch.column(1), 4_000_000):
                tokens = counter.totals(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.count), pa.array(np.diff(block.offsets), pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                    [key, "n_bytes", "n_tokens", "over_limit"],
                )

    picked = docs.select(quoted(key), quoted(text))
    return picked.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, n_bytes long, n_tokens long, over_limit boolean")
