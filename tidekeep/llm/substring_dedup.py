"""Removal of word runs that repeat from another document, by prefix-partitioned suffix subtrees.

Every position that begins `WINDOW` words is a suffix, cut at that depth.  Suffixes are
split into groups that fit in memory by a prefix of variable length: first the `ANCHOR`
words that begin at the window's least-hashed run of so many words (its anchor), and where
a group is too large, all `WINDOW` words.  Equal windows have equal anchors, so a group
needs no suffix of another, and neighbouring suffixes mostly share theirs, so they travel
as one record.  Anchors are counted first; only records whose anchor several documents have
are fetched, a piece of the text each, and meet.  Texts travel of documents that have such
records, and at the end of those that lose words; a scan knows them by a filter of bounded
size, and what it holds for besides finds no partner in the join.

In a group, words become numbers and suffixes are sorted by doubling: ranks of 1, 2, 4, ...
32 words, then of all 50.  In that order, suffixes that share 50 words stand together: these
are the subtree's deep internal nodes.  In a node, the suffixes of all documents but the
least are repeats, and neighbouring ones join into maximal repeats.  Words are compared by
their bytes; hashes only choose the group.

Nothing grows with a hot group:

* A task settles, before anything is sent, windows that a lesser document of the same block
  of text has too; it sends one for each block and window, whatever the number of copies.
* Anchors that at least one in `RARER_THAN` documents have are found first, by lossy counts
  over all documents.  They are an anchor only where a window has no other.  Their groups
  are dealt over `SALTS`, and what is left of each part, one suffix for each node, meets by
  its whole window.
* A group's records come by document.  A task holds a slice of them, and of what went
  before the records that brought new nodes, up to `CARRIED` bytes; of a group with more,
  the suffixes that match none of these meet by their whole window as well.

Which anchors count as hot, and how large slices are, is a matter of speed alone.

A window goes if its words also start in a document of a smaller id; all windows are judged
on the input.  Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged.

Null and empty texts have no words; texts of fewer than `WINDOW` words lose none.  Rows
without an id lose nothing and are no source; rows that share an id are not smaller than
each other.  An empty table gives no rows.  Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import KeyFilter, cut, key_code, key_filter, passing
from .textbatch import Block, blocks, distinct, quoted, run_codes, span_codes, windows

WINDOW = 50
ANCHOR = 10
#: Bytes of text that are looked at together before they are sent.
BLOCK = 2_000_000
#: Bytes of records that a task sorts at a time, and that it remembers of the group it is in.
SLICE, CARRIED = 2_000_000, 2_000_000
HOT, RARER_THAN, LEAST_HOT = 1 << 14, 1000, 64
SALTS = 64
_COLUMNS = ["code", "salt", "doc", "row", "first", "last", "text"]
_SCHEMA = "code long, salt int, doc long, row long, first long, last long, text binary"


def anchors(codes: np.ndarray, at: np.ndarray, hot: np.ndarray, width: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor of each window: the least of its runs' codes, hot ones (sorted) after all others."""
    low, size, reach = run_codes(codes, anchor) >> np.uint64(1), 1, width - anchor + 1
    if len(hot):
        known = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
        low = np.where(known, low | np.uint64(1 << 63), low)
    while 2 * size <= reach:  # runs across documents are never asked for
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    return np.minimum(low[: len(low) - (reach - size)], low[reach - size :])[at]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def hot_anchors(docs: DataFrame, least: int | None = None) -> np.ndarray:
    """Sorted codes of at most `HOT` anchors that at least 1 in `RARER_THAN` documents (and `LEAST_HOT`) have."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times, seen = none, np.zeros(0, np.int64), 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                codes, first = block.word_codes()
                at, doc = windows(first, WINDOW)
                seen += block.count
                if not len(at):
                    continue
                own = anchors(codes, at, none)
                some, count = np.unique(own[_runs(own, doc)], return_counts=True)
                merged, place = np.unique(np.concatenate([often, some[count > 1]]), return_inverse=True)
                total = np.bincount(place, np.concatenate([times, count[count > 1]]), len(merged)).astype(np.int64)
                keep = total * RARER_THAN * 2 >= seen
                if keep.sum() > 4 * HOT:
                    keep &= total > np.partition(total, -4 * HOT)[-4 * HOT]
                often, times = merged[keep], total[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(often, np.uint64(0)).view(np.int64)), pa.array(np.append(times, 0)), pa.array(np.append(np.zeros(len(often), np.int64), seen))], ["code", "n", "docs"])

    counted = cut(docs.select("text").mapInArrow(run, "code long, n long, docs long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    every = counted.agg(F.sum("docs")).first()[0] or 0
    enough = max(every / RARER_THAN, LEAST_HOT) if least is None else least
    found = counted.where((F.col("code") != 0) & (F.col("n") >= enough)).orderBy(F.desc("n"), "code").limit(HOT).select("code").collect()  # at most HOT
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _batch(code: np.ndarray, salt: np.ndarray, doc: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, text: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(code).view(np.int64)), pa.array(salt.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (doc, row, first, last)), text]
    return pa.RecordBatch.from_arrays(columns, _COLUMNS)


def _spans(doc: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Repeats, which pass the groups by; they are dealt by document."""
    return _batch(doc.astype(np.int64).view(np.uint64), np.zeros(len(doc)), doc, row, first, last, pa.nulls(len(doc), pa.binary()))


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    raw = memoryview(np.ascontiguousarray(data))
    return pa.array([bytes(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())


def _settled(ids: np.ndarray, at: np.ndarray, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Windows of which a lesser document has the same words, among these; ids are the words' numbers."""
    order = np.lexsort((doc, code))
    head = _runs(code[order])
    lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    later = doc[order] > doc[lead]
    a, b = at[order[later]], at[lead[later]]
    same, step, width = np.zeros(len(a), bool), 20_000, np.arange(WINDOW)
    for k in range(0, len(a), step):
        same[k : k + step] = (ids[a[k : k + step, None] + width] == ids[b[k : k + step, None] + width]).all(axis=1)
    out = np.zeros(len(at), bool)
    out[order[later][same]] = True
    return out


def _routed(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(code, doc, row, first, last): runs of neighbouring suffixes of one anchor, without their text; code is null for repeats inside a block."""
    names = _COLUMNS[:1] + _COLUMNS[2:6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_of, rows_of = (batch.column(k).to_numpy() for k in range(2))
            for block in blocks(batch.column(2), BLOCK):
                starts, ends, first = block.words()
                at, own = windows(first, WINDOW)
                if not len(at):
                    continue
                _, ids, codes = distinct(block.data, starts, ends)
                codes = codes[ids]
                doc, row = docs_of[block.first : block.first + block.count][own], rows_of[block.first : block.first + block.count][own]
                gone = _settled(ids.astype(np.int32), at, run_codes(codes, WINDOW)[at], doc)
                code = anchors(codes, at, hot)
                lead = np.flatnonzero(_runs(own, gone, np.where(gone, np.uint64(0), code)))
                last = np.append(lead[1:], len(at)) - 1
                begin = at[lead] - first[own[lead]]
                yield pa.RecordBatch.from_arrays([pa.array(code[lead].view(np.int64), mask=gone[lead]), *(pa.array(x.astype(np.int64)) for x in (doc[lead], row[lead], begin, begin + last - lead + WINDOW))], names)

    return docs.where(F.col("doc").isNotNull()).select("doc", "row", "text").mapInArrow(run, "code long, doc long, row long, first long, last long")


def _shared(routed: DataFrame) -> DataFrame:
    """Repeats, and the runs whose anchor several documents have; others can't repeat."""
    # hot anchors are negative: they need no count, nor do repeats, and they are dealt by document
    key = Window.partitionBy(F.when(F.col("code") >= 0, F.col("code")).otherwise(F.xxhash64("doc", "first")))
    met = routed.withColumns({"low": F.min("doc").over(key), "high": F.max("doc").over(key)})
    return met.where("code is null or code < 0 or low < high").drop("low", "high")


def _records(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs with their piece of the text, from the documents that have some."""
    asked = runs.groupBy("doc", "row").agg(F.collect_set(F.struct("code", "first", "last")).alias("runs"))
    some = key_filter(runs.select(key_code("doc", "row").alias("code")).distinct())
    found = passing(docs, key_code("doc", "row"), some).join(asked.hint("merge"), ["doc", "row"]).select("doc", "row", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_of, rows_of = (batch.column(k).to_numpy() for k in range(2))
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            code, begin, end = (lists.flatten().field(k).to_numpy() for k in ("code", "first", "last"))
            for block in blocks(batch.column(2), BLOCK):
                starts, ends, first = block.words()
                mine = slice(block.first, block.first + block.count)
                own = np.repeat(np.arange(block.count), np.diff(bounds)[mine])
                some = slice(bounds[block.first] - bounds[0], bounds[block.first + block.count] - bounds[0])
                c, a, b = code[some].view(np.uint64), begin[some], end[some]
                doc = docs_of[mine][own]
                salt = np.where(c >> np.uint64(63) > 0, 1 + (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % SALTS, 0)
                yield _batch(c, salt, doc, rows_of[mine][own], a, b, _slices(block.data, starts[first[own] + a], ends[first[own] + b - 1]))

    return found.mapInArrow(run, _SCHEMA)


def suffix_nodes(ids: np.ndarray, at: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Ranks, in the order of their words, of the suffixes at `at`, cut at `width` words: equal for equal ones.

    By doubling: the rank of 2k words is that of a pair of ranks of k words.
    """
    have, size = ids.astype(np.int64), 1

    def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.unique(x * (int(have.max()) + 1) + y, return_inverse=True)[1]

    while 2 * size <= width:
        have, size = paired(have[:-size], have[size:]), 2 * size
    return paired(have[at], have[at + width - size])


class Subtrees:
    """Repeats of suffixes that come group by group, in a group by document.

    Of the group that it is in, it remembers the records that brought new nodes.
    """

    def __init__(self, limit: int | None = CARRIED) -> None:
        self.limit, self.group, self.full = limit, None, False
        self.texts: list[bytes] = []
        self.docs = np.zeros(0, np.int64)

    def add(self, code: np.ndarray, salt: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """The spans of these records that repeat, and what is left to meet by its whole window."""
        first_group = (code[0], salt[0])
        if first_group != self.group:
            self.group, self.full, self.texts, self.docs = first_group, False, [], self.docs[:0]
        old = len(self.texts)
        every = self.texts + texts
        docs = np.concatenate([self.docs, doc])
        code, salt = (np.concatenate([np.repeat(x[:1], old), x]) for x in (code, salt))
        sizes = np.array([len(t) for t in every], np.int64)
        block = Block(np.frombuffer(b"".join(every), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), 0)
        starts, ends, first = block.words()
        at, own = windows(first, WINDOW)
        some, ids, codes = distinct(block.data, starts, ends)
        node = suffix_nodes(ids, at)
        group = np.cumsum(_runs(code, salt))[own]
        order = np.lexsort((docs[own], node, group))
        head = _runs(group[order], node[order])
        lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        repeat, fresh = np.zeros(len(at), bool), np.zeros(len(at), bool)
        repeat[order] = docs[own][order] > docs[own][lead]
        fresh[order] = own[lead] >= old  # of a node that isn't remembered
        repeat &= own >= old
        first_of = ~repeat & (own >= old)  # all places in a node's least document
        fresh &= first_of
        hit = np.flatnonzero(repeat)
        if len(hit):
            new = _runs(own[hit], hit - np.arange(len(hit)))
            a, b = hit[new], hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
            begin, rec = start[own[a] - old] + at[a] - first[own[a]], own[a] - old
            yield _spans(doc[rec], row[rec], begin, begin + b - a + WINDOW)
        # what goes on to meet by its whole window: all of a salted group, and of a full one what isn't remembered
        left = (first_of & (salt[own] > 0)) | (fresh & self.full & (group == group[0]))
        same = (code == code[-1]) & (salt == salt[-1])
        if self.group != (code[-1], salt[-1]):
            self.group, self.full = (code[-1], salt[-1]), False
        if not self.full:
            keep, of = np.zeros(len(every), bool), np.empty(len(at), np.int64)
            of[order] = own[lead]  # the record that stands for a window's node
            keep[of[fresh]] = True
            keep[:old] = True
            keep &= same
            if self.limit is not None and int(sizes[keep].sum()) > self.limit:
                self.full = True
                most = keep & (np.cumsum(np.where(keep, sizes, 0)) <= self.limit)
                left |= fresh & (keep & ~most)[of]
                keep = most
            self.texts, self.docs = [every[k] for k in np.flatnonzero(keep).tolist()], docs[keep]
        rest = np.flatnonzero(left)
        if len(rest):
            rec, place = own[rest] - old, at[rest]
            begin = start[rec] + place - first[own[rest]]
            yield _batch(run_codes(codes[ids], WINDOW)[place] >> np.uint64(1), np.full(len(rest), -1), doc[rec], row[rec], begin, begin + WINDOW, _slices(block.data, starts[place], ends[place + WINDOW - 1]))


def _grouped(records: DataFrame, limit: int | None) -> DataFrame:
    """Spans of the repeats in these records' groups, and records that are left to meet by their whole window (salt -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Subtrees(limit)
        for batch in batches:
            known = batch.column(6).is_null()
            yield pa.RecordBatch.from_arrays(batch.filter(known).columns, _COLUMNS)
            batch = batch.filter(pc.invert(known))
            code, salt, doc, row, first = (batch.column(k).to_numpy() for k in range(5))
            texts = batch.column(6).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            k = 0
            while k < len(texts):
                to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SLICE, "right")))
                yield from trees.add(code[k:to].view(np.uint64), salt[k:to], doc[k:to], row[k:to], first[k:to], texts[k:to])
                k = to

    return records.repartition("code", "salt").sortWithinPartitions("code", "salt", "doc").mapInArrow(run, _SCHEMA)


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = CARRIED, least_hot: int | None = None) -> DataFrame:
    """(doc, row, first, last): words [first, last) of a document that windows from lesser documents cover; row is a hash of its text.

    Spans of one document may touch or overlap.  `limit` is what a task remembers of one
    group in bytes, `least_hot` the number of documents from which an anchor is hot.
    """
    named = docs.select(F.col(quoted(key)).cast("long").alias("doc"), F.xxhash64(quoted(text)).alias("row"), F.col(quoted(text)).alias("text"))
    routed = cut(_shared(_routed(named, hot_anchors(named, least_hot))))
    first = cut(_grouped(_records(named, routed.where("code is not null")), limit))
    second = cut(_grouped(first.where("text is not null"), None))  # a group is one window, of which one record is remembered
    spans = [x.select("doc", "row", "first", "last") for x in (routed.where("code is null"), first.where("text is null"), second.where("text is null"))]
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def _with_spans(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, KeyFilter]:
    """(all, spans, code): all columns of docs as a struct, and a flat array of first, last of each repeat, null if there is none.

    Rows for whose code the filter holds come twice and are to be left out: they are also there with their spans and no code.
    """
    found = repeats(docs, text, key)
    spans = found.groupBy("doc", "row").agg(F.flatten(F.collect_list(F.array("first", "last"))).alias("spans"))
    some = key_filter(found.select(key_code("doc", "row").alias("code")).distinct())
    named = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("all"), F.col(quoted(key)).cast("long").alias("own"), F.xxhash64(quoted(text)).alias("hash"))
    named = named.withColumn("code", key_code("own", "hash"))
    whole = named.select("all", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "code")
    # a merge join, as its shuffle keeps the two Python steps out of one task, where each would have a process
    met = passing(named.drop("code"), key_code("own", "hash"), some).join(spans.hint("merge"), (F.col("own") == F.col("doc")) & (F.col("hash") == F.col("row")), "left")
    return whole.unionByName(met.select("all", "spans", F.lit(None).cast("long").alias("code"))), some


def _kept(block: Block, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and removed words of each document, the kept words joined by spaces, and the documents' bounds in that."""
    starts, ends, first = block.words()
    marks = np.zeros(len(starts) + 1, np.int64)
    spans = spans.cast(pa.list_(pa.int64()))
    sizes = np.diff(np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1])
    flat = spans.flatten().to_numpy()
    sizes = np.where(spans.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    base = np.repeat(first[:-1], sizes // 2)
    np.add.at(marks, base + flat[0::2], 1)
    np.add.at(marks, base + flat[1::2], -1)
    gone = np.cumsum(marks[:-1]) > 0
    removed = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(gone, out=removed[1:])
    keep = np.flatnonzero(~gone)
    doc = np.searchsorted(first, keep, "right") - 1
    edge = np.zeros(len(block.data) + 2, np.int8)
    edge[starts[keep]] += 1
    edge[ends[keep]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    more = np.zeros(len(keep), bool)
    more[:-1] = doc[1:] == doc[:-1]
    data = np.append(block.data, np.uint8(32))
    data[ends[keep[more]]] = 32
    inside[ends[keep[more]]] = True
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=at[1:])
    return np.diff(first), removed[first[1:]] - removed[first[:-1]], data[inside], at[block.offsets]


def removal_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every document."""
    picked = docs.select(quoted(key), quoted(text))
    spanned, twice = _with_spans(picked, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~twice.holds(batch.column(2))))
            own, texts = batch.column(0).flatten()
            for block in blocks(texts):
                words, removed, data, bounds = _kept(block, batch.column(1).slice(block.first, block.count))
                raw, cuts = data.tobytes(), bounds.tolist()
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([own.slice(block.first, block.count), pa.array(words), pa.array(removed), pa.array(digests, pa.string())], [key, "n_words", "n_removed", "kept_sha256"])

    return spanned.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns; the text is its kept words, joined by one space, where words were removed, and unchanged elsewhere."""
    at = docs.columns.index(text)
    names = docs.columns
    spanned, twice = _with_spans(docs, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~twice.holds(batch.column(2))))
            every = batch.column(0).flatten()
            for block in blocks(every[at]):
                columns = [c.slice(block.first, block.count) for c in every]
                _, removed, data, bounds = _kept(block, batch.column(1).slice(block.first, block.count))
                raw, cuts, old = data.tobytes(), bounds.tolist(), columns[at].to_pylist()
                new = [raw[a:b].decode() if n else t for a, b, n, t in zip(cuts[:-1], cuts[1:], removed.tolist(), old, strict=True)]
                columns[at] = pa.array(new, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return spanned.mapInArrow(run, docs.schema)
