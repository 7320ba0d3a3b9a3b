"""Quality rules: base counts, and a hashed n-gram likelihood ratio of a trusted target to the corpus.

Every run of `WIDTH` bytes of a text falls in one of `BUCKETS` hash buckets.  Two multinomials
over the buckets are counted: that of all documents, and that of trusted ones (labelled 1).
A document's score is the sum of log(p_target / p_corpus) over its n-grams, divided by their
number.  It is kept if the score reaches a threshold taken from the trusted documents'
own scores: their `LOW_SHARE` quantile less the distance of that quantile from the median.
Ratios are rounded to 2**-20 and summed as integers, so that a verdict does not depend on
how documents are dealt to tasks.

Both counts cover all rows, and the threshold all trusted ones; a task sends at most `BUCKETS`
rows of counts.  Quantiles are exact: their digits are found from counts, `DIGIT` bits a pass.

No text of a trusted document is dealt out: a scan knows them by a filter of bounded size, and
what it wrongly holds for is found from the ids alone.  Counts of those few texts are taken off
again, their scores are left out, and only they travel.  So results are exact whatever the filter lets pass.

Null and empty texts have no words and fail the base rules.  Without trusted documents, or
without documents, all ratios are 0 and only the base rules decide.  Repeated rows are
judged alike.  Other columns are ignored by `judge` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import KeyFilter, cut, key_code, key_filter, passing
from .textbatch import Block, blocks, mix, per_document, quoted, run_codes, span_codes, windows

WIDTH = 4
BUCKETS = 1 << 14
LOW_SHARE = 0.001
DIGIT = 16
SCALE = 1 << 20

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


@dataclass(frozen=True)
class Model:
    """Log ratios by bucket in units of 1 / SCALE, and the least score that is kept."""

    ratios: np.ndarray
    threshold: float


def _grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the block and each document's bounds; none crosses documents."""
    n = len(block.data) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(block.count + 1, np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(WIDTH):
        code |= block.data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    bucket = (code * np.uint32(0x9E3779B1)) ^ (code >> np.uint32(15))
    bucket = ((bucket * np.uint32(0x85EBCA77)) >> np.uint32(18)).astype(np.int64)
    size = np.maximum(np.diff(block.offsets) - WIDTH + 1, 0)
    if int(size.sum()) != n:
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, np.minimum(block.offsets[:-1], n), (size > 0).astype(np.int64))
        np.add.at(inside, np.minimum(block.offsets[:-1] + size, n), -(size > 0).astype(np.int64))
        bucket = bucket[np.cumsum(inside)[:-1] > 0]
    return bucket, np.concatenate([[0], np.cumsum(size)])


def corpus_counts(docs: DataFrame, some: KeyFilter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams by bucket over all rows of docs (code, text), and over those that the filter holds for; tasks send their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            held = some.holds(batch.column(0)) if some else np.zeros(len(batch), bool)
            for block in blocks(batch.column(1)):
                bucket, bounds = _grams(block)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[np.repeat(held[block.first : block.first + block.count], np.diff(bounds))], minlength=BUCKETS)
        found = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *(pa.array(t[found]) for t in total)], ["bucket", "n", "held"])

    out = np.zeros((2, BUCKETS), np.int64)
    for bucket, *n in docs.mapInArrow(run, "bucket int, n long, held long").groupBy("bucket").agg(F.sum("n"), F.sum("held")).collect():  # at most BUCKETS rows
        out[:, bucket] = n
    return out[0], out[1]


def log_ratios(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Add-one smoothed log(p_target / p_corpus), rounded to 1 / SCALE."""
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    p, q = np.log((target + 1) / (target.sum() + BUCKETS)), np.log((corpus + 1) / (corpus.sum() + BUCKETS))
    return np.rint((p - q) * SCALE).astype(np.int64)


def block_scores(block: Block, ratios: np.ndarray) -> np.ndarray:
    bucket, bounds = _grams(block)
    return per_document(ratios[bucket], bounds) / (np.maximum(np.diff(bounds), 1) * float(SCALE))


def _ordered(scores: np.ndarray) -> np.ndarray:
    """Codes that have the order of the scores."""
    bits = scores.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def at_places(scores: DataFrame, places: list[int]) -> list[float]:
    """Scores at these places, from 0, of the ascending order; a pass sends at most 1 << DIGIT counts for each place to the driver."""
    known, left = [0] * len(places), list(places)
    for shift in range(64 - DIGIT, -1, -DIGIT):
        heads = sorted(set(known))

        def run(batches: Iterator[pa.RecordBatch], shift: int = shift, heads: list[int] = heads) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(heads), 1 << DIGIT), np.int64)
            for batch in batches:
                code = _ordered(batch.column(0).to_numpy()) >> np.uint64(shift)
                digit = (code & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                for k, head in enumerate(heads):
                    total[k] += np.bincount(digit[code >> np.uint64(DIGIT) == np.uint64(head)], minlength=1 << DIGIT)
            head, digit = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(head.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(total[head, digit])], ["head", "digit", "n"])

        total = np.zeros((len(heads), 1 << DIGIT), np.int64)
        for head, digit, n in scores.mapInArrow(run, "head int, digit int, n long").groupBy("head", "digit").agg(F.sum("n")).collect():
            total[head, digit] = n
        for k, head in enumerate(known):
            ends = np.cumsum(total[heads.index(head)])
            digit = int(np.searchsorted(ends, left[k], "right"))
            left[k] -= int(ends[digit - 1]) if digit else 0
            known[k] = head << DIGIT | digit
    code = np.array(known, np.uint64)
    return np.where(code >> np.uint64(63), code ^ np.uint64(1 << 63), ~code).view(np.float64).tolist()


def quantiles(scores: DataFrame, shares: list[float]) -> list[float] | None:
    """Exact quantiles, interpolated between neighbours; None without scores."""
    n = scores.count()
    if not n:
        return None
    at = [share * (n - 1) for share in shares]
    low = at_places(scores, [p for x in at for p in (int(x), min(int(x) + 1, n - 1))])
    return [a + (b - a) * (x - int(x)) for x, a, b in zip(at, low[::2], low[1::2], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Count both multinomials over all rows and set the threshold from all trusted documents."""
    docs = docs.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    code = key_code("doc_id")
    chosen = cut(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).where("doc_id is not null").distinct())
    trusted = key_filter(chosen.select(code))
    # merge joins: ids are dealt out at any size, so that what travels grows in proportion, and no task holds two Python processes
    wrong = cut(passing(docs.select("doc_id"), code, trusted).join(chosen.hint("merge"), "doc_id", "left_anti").distinct())
    corpus, target = corpus_counts(docs.select(code, "text"), trusted)
    few = key_filter(wrong.select(code))
    if few.words.any():
        target = target - corpus_counts(passing(docs, code, few).join(wrong.hint("merge"), "doc_id").select(code, "text"))[0]
    ratios = log_ratios(target, corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(trusted.holds(batch.column(2))))
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.count), pa.array(block_scores(block, ratios))], ["doc_id", "score"])

    named = docs.where("length(text) > 0").select("doc_id", "text", code)
    scores = named.mapInArrow(run, f"doc_id {named.dtypes[0][1]}, score double")
    if few.words.any():
        scores = scores.join(wrong.hint("merge"), "doc_id", "left_anti")
    low, mid = quantiles(cut(scores.select("score")), [LOW_SHARE, 0.5]) or (float("-inf"), 0.0)
    return Model(ratios, low - (mid - low))


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """The base counts of each document of the block."""
    starts, ends, first = block.words()
    n_words = np.diff(first)
    begins_char = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    chars = begins_char[ends] - begins_char[starts]
    at, doc = windows(first, REPEAT_WINDOW)
    marks = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        seen = run_codes(span_codes(block.data, starts, ends), REPEAT_WINDOW)[at] ^ mix(doc.astype(np.uint64) + np.uint64(1))
        order = np.sort(seen)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, seen), len(twice) - 1)
            hit = at[twice[place] == seen]
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + REPEAT_WINDOW, -1)
    covered = (np.cumsum(marks[:-1]) > 0).astype(np.int64)
    return {
        "n_words": n_words,
        "word_chars": per_document(chars, first),
        "n_symbols": per_document(_SYMBOL[block.data], block.offsets),
        "n_dup_lines": _repeated_lines(block, starts),
        "n_repeat_words": per_document(covered, first),
    }


def _repeated_lines(block: Block, words: np.ndarray) -> np.ndarray:
    breaks = np.flatnonzero(block.data == 10)
    begin = np.union1d(breaks + 1, block.offsets[:-1])
    begin = begin[begin < len(block.data)]
    doc = np.searchsorted(block.offsets, begin, "right") - 1
    end = np.minimum(np.append(breaks, len(block.data))[np.searchsorted(breaks, begin)], block.offsets[doc + 1])
    has = np.searchsorted(words, end) > np.searchsorted(words, begin)
    begin, end, doc = begin[has], end[has], doc[has]
    line = span_codes(block.data, begin, end) ^ mix(doc.astype(np.uint64) + np.uint64(1))
    _, some = np.unique(line, return_index=True)
    return np.bincount(doc, minlength=block.count) - np.bincount(doc[some], minlength=block.count)


def _verdicts(block: Block, model: Model) -> list[pa.Array]:
    c = base_counts(block)
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    score = block_scores(block, model.ratios)
    return [*(pa.array(v.astype(np.int64)) for v in c.values()), pa.array(failed), pa.array(~failed & (score >= model.threshold)), pa.array(score)]


def judge(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, the base counts, base_failed, kept and score of every document; one pass, no shuffle."""
    names = [key, *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.count), *_verdicts(block, model)], names)

    picked = docs.select(quoted(key), quoted(text))
    return picked.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, {COLUMNS}")


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are kept, all columns unchanged; one pass, no shuffle and no join."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at)):
                yield batch.slice(block.first, block.count).filter(_verdicts(block, model)[6])

    return docs.mapInArrow(run, docs.schema)
