"""Bulk-synchronous best-fit packing of token sequences.

Documents are tokenized, and only those beyond the capacity are cut: into pieces of full
capacity, the first piece taking what is over.  Pieces are range-sorted by length, so that
each has its rank among those of its length from counts by partition.

Packing goes in rounds over a table of gaps, a row for each open sequence with room.  In a
round the gaps are range-sorted by size, and each gets its rank among those of its size.
Then, from the longest length down, pieces sweep to their successor, the least gap size
that holds them, and from there upwards: pieces and gaps meet by rank, so that no two
pieces want the same place, and a gap takes as many of one length as fit.  The sweep needs
the counts by length and by size only, at most `CAPACITY` each; every task then looks the
gaps up that it holds, places the pieces and hands on what is left of the gap.  Lengths
take part in classes, each down to half the last, and a class meets until all its pieces
have a place.  Sequences open as fast as the tokens that are left, or pieces longer than
every gap, need them for certain.

Between rounds the table of gaps is written to the shared folder.  A gap takes a piece or
more in each round that its class has pieces for it, so that there are some rounds for each
halving, whatever the number of documents.

Null and empty texts are one piece, the end token alone.  Repeated rows are pieces of their
own; an empty table gives no rows.  Pieces of one length are dealt by a hash of their row,
so that copies don't gather.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import cut
from .textbatch import blocks, quoted

CAPACITY = 1024
#: Lengths up to this one are the last class.
LAST_CLASS = 16
#: Gaps in a partition.
GAP_ROWS = 50_000
_ROW = (1 << 33) - 1


def pieces(docs: DataFrame, tokenizer_path: str, end: int, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document: its ids and the end token, cut at the capacity."""
    names = [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(tokenizer_path)
        for batch in batches:
            for block in blocks(batch.column(1), bpe.BLOCK):
                ids, bounds = coder.encode_with_added(block)
                ids = np.insert(ids, bounds[1:], end)
                bounds = bounds + np.arange(block.count + 1)
                total = np.diff(bounds)
                count = -(-total // capacity)
                doc = np.repeat(np.arange(block.count), count)
                no = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = (total - 1) % capacity + 1  # length of the first piece
                start = np.where(no == 0, 0, head[doc] + (no - 1) * capacity)
                length = np.where(no == 0, head[doc], capacity)
                raw, at = memoryview(ids.astype("<u4").tobytes()), bounds[doc] + start
                spans = list(zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True))
                columns = [batch.column(0).slice(block.first, block.count).take(pa.array(doc)), pa.array(no.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, bounds[-1]), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    picked = docs.select(quoted(key), quoted(text))
    return picked.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


@dataclass(frozen=True)
class Meeting:
    """`gaps` gaps of `size`, from rank `first_gap`, take `each` pieces of `length`, from rank `first_piece`.

    Gap number j of them takes the pieces first_piece + j * each, and on.
    """

    length: int
    first_piece: int
    size: int
    first_gap: int
    each: int
    gaps: int


def sweep(pieces: dict[int, int], gaps: dict[int, int], placed: dict[int, int]) -> list[Meeting]:
    """Where pieces (number by length) meet gaps (number by size), the longest first, each in the least size that holds it."""
    sizes, met, out = sorted(gaps), dict.fromkeys(gaps, 0), []
    for length in sorted(pieces, reverse=True):
        left, rank = pieces[length], placed.get(length, 0)
        at = bisect.bisect_left(sizes, length)
        while left and at < len(sizes):
            size = sizes[at]
            free = gaps[size] - met[size]
            if not free:
                at += 1
                continue
            each = min(size // length, left)
            some = min(free, left // each)
            out.append(Meeting(length, rank, size, met[size], each, some))
            met[size] += some
            rank, left = rank + each * some, left - each * some
    return out


def _openings(left: dict[int, int], gaps: dict[int, int], floor: int, capacity: int) -> int:
    """Sequences that are surely needed beyond those that are open: for all tokens, or for the pieces that no gap holds."""
    tokens = sum(length * n for length, n in left.items()) - sum(size * n for size, n in gaps.items())
    largest = max(gaps, default=0)
    stuck = sum(length * n for length, n in left.items() if length > max(largest, floor))
    return max(0, -(-tokens // capacity), -(-stuck // capacity))


@dataclass(frozen=True)
class Ranked:
    """Rows in the order of a range sort by `by`: a row's rank among equals is its row number plus the shift of its partition."""

    frame: DataFrame
    by: str
    counts: dict[int, int]
    codes: np.ndarray

    @classmethod
    def of(cls, frame: DataFrame, by: str, ties: Column, parts: int) -> Ranked:
        dealt = frame.repartitionByRange(parts, F.desc(by), ties).sortWithinPartitions(F.desc(by))
        # row numbers by partition, fixed before the cut
        rows = cut(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))), tidy=False)
        # a partition holds a range of values: at most partitions + capacity rows in all
        groups = rows.groupBy("_part", by).agg(F.count("*").alias("n"), F.min("_row").alias("first")).collect()
        counts: dict[int, int] = {}
        codes = []
        for part, value, n, first in sorted(groups):
            codes.append((part << 32 | value, counts.get(value, 0) - first))
            counts[value] = counts.get(value, 0) + n
        return cls(rows.coalesce(parts), by, counts, np.array(sorted(codes), np.int64).reshape(-1, 2))

    def rank(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Values and ranks of a batch's rows."""
        part, row, value = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_part", "_row", self.by))
        return value, row + self.codes[np.searchsorted(self.codes[:, 0], part << 32 | value), 1]


def _met(gaps: Ranked, meetings: list[Meeting], capacity: int) -> tuple[DataFrame, DataFrame]:
    """What the gaps take, (length, rank, sequence_id, offset), and what is left of them, (sequence_id, size)."""
    table = np.array(sorted((m.size, m.first_gap, m.gaps, m.length, m.first_piece, m.each) for m in meetings), np.int64).reshape(-1, 6)
    step = max(gaps.counts.values(), default=0) + 1
    begin = table[:, 0] * step + table[:, 1]
    codes = gaps.codes
    rank = Ranked(None, "size", {}, codes).rank  # without the frame, for the tasks

    def look(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size, own = rank(batch)
        at = np.searchsorted(begin, size * step + own, "right") - 1
        hit = at >= 0
        hit[hit] = (table[at[hit], 0] == size[hit]) & (own[hit] < table[at[hit], 1] + table[at[hit], 2])
        return batch.column(0).to_numpy(), size, own, np.where(hit, at, -1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, size, own, at = look(batch)
            rows = np.flatnonzero(at >= 0)
            _, first_gap, _, length, first_piece, each = table[at[rows]].T
            row = np.repeat(np.arange(len(rows)), each)
            k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            piece = first_piece[row] + (own[rows] - first_gap)[row] * each[row] + k
            yield pa.RecordBatch.from_arrays([pa.array(length[row]), pa.array(piece), pa.array(sequence[rows][row]), pa.array(capacity - size[rows][row] + k * length[row])], ["length", "rank", "sequence_id", "offset"])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, size, _, at = look(batch)
            size = size - np.where(at >= 0, table[at, 3] * table[at, 5], 0) if len(table) else size
            yield pa.RecordBatch.from_arrays([pa.array(sequence[size > 0]), pa.array(size[size > 0])], ["sequence_id", "size"])

    return gaps.frame.mapInArrow(placed, "length long, rank long, sequence_id long, offset long"), gaps.frame.mapInArrow(left, "sequence_id long, size long")


def place(counts: dict[int, int], spark: SparkSession, capacity: int = CAPACITY) -> DataFrame | None:
    """(length, rank, sequence_id, offset) of `counts` pieces by length, in rounds; None if there are none."""
    left, done = dict(counts), dict.fromkeys(counts, 0)
    sizes: dict[int, int] = {}
    table, found, opened, floor = None, [], 0, capacity
    while left:
        floor = floor // 2 if floor > LAST_CLASS else 0
        while taking := {length: n for length, n in left.items() if length > floor}:
            more = _openings(left, sizes, floor, capacity)
            if more:
                new = spark.range(opened, opened + more, 1, max(1, more // GAP_ROWS)).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("size"))
                table, opened = new if table is None else table.unionByName(new), opened + more
            gaps = Ranked.of(table, "size", F.xxhash64("sequence_id"), max(1, -(-(sum(sizes.values()) + more) // GAP_ROWS)))
            meetings = sweep(taking, gaps.counts, done)
            placed, table = _met(gaps, meetings, capacity)
            found.append(placed)
            sizes = dict(gaps.counts)
            for m in meetings:
                sizes[m.size] -= m.gaps
                rest = m.size - m.each * m.length
                sizes[rest] = sizes.get(rest, 0) + m.gaps
                done[m.length] += m.each * m.gaps
                left[m.length] -= m.each * m.gaps
            sizes = {size: n for size, n in sizes.items() if n and size}
            left = {length: n for length, n in left.items() if n}
    return reduce(DataFrame.unionByName, found) if found else None


def assign(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `pieces`, of which `length` counts, with sequence_id and offset."""
    spark, names = cut_up.sparkSession, cut_up.columns
    cut_up = cut(cut_up)  # a range sort reads its input twice; texts are tokenized once
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = Ranked.of(cut_up, "length", F.xxhash64(*(quoted(c) for c in names if c != "ids")), parts)
    codes = Ranked(None, "length", {}, pieces.codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(codes.rank(batch)[1])], [*names, "_rank"])

    kinds = ", ".join(f"{quoted(name)} {kind}" for name, kind in cut_up.dtypes)
    ranked = pieces.frame.mapInArrow(run, f"{kinds}, _rank long")
    placed = place(pieces.counts, spark, capacity)
    if placed is None:
        return cut_up.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    placed = placed.select(F.col("length").alias("_length"), F.col("rank").alias("_at"), "sequence_id", "offset")
    return ranked.join(placed, (F.col("length") == F.col("_length")) & (F.col("_rank") == F.col("_at"))).select(*map(quoted, names), "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, end: int, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Where every piece of every document goes: (key, piece, start, length, ids_crc32, sequence_id, offset)."""
    return assign(pieces(docs, tokenizer_path, end, capacity, False, text, key), capacity)


def sequences(docs: DataFrame, tokenizer_path: str, end: int, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), at most `capacity` ids each."""
    placed = assign(pieces(docs, tokenizer_path, end, capacity, True, text, key), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
