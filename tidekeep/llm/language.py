"""Language identification by rank-order n-gram profiles.

A text's letters, lower-cased, form words; every word with a blank on both sides gives its
n-grams of 1 to 3 characters.  A profile is the list of the `DEPTH` most frequent n-grams
(ties: the lesser code points first).  The distance of a document to a language is the sum,
over the document's profile, of how far each n-gram stands from its place in the language's
profile, and `DEPTH` for one that it lacks.  The nearest language wins (ties: the first by
name); the score is 1 minus the distance as a share of the greatest possible.

Profiles are learned from a bounded sample: documents of each language by a hash of their
id, as large a share as gives `PER_LANGUAGE` (all, if there are no more), of the `LANGUAGES`
most frequent languages.  Prediction reads the whole text and nothing else.

What score counts as known is taken from the corpus (`least_score`): of all documents that
are predicted as labelled, the `LOW_SHARE` quantile of scores, times `MARGIN`.  Texts in a
language that was not learned score less; they share letters, but few of the frequent n-grams.

Texts that are null or have no letter get `und` and score 0; so does every text when there
is nothing to learn from.  Equal texts get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LETTER, _classes, _codepoints
from .textbatch import Block, blocks, quoted

DEPTH = 300
#: Languages that are learned, the most frequent, and documents that each is learned from, about.
LANGUAGES, PER_LANGUAGE = 1000, 1000
#: The least score that counts as known: this share of the quantile of scores, which are counted in so many bins.
LOW_SHARE, MARGIN, BINS = 0.001, 2 / 3, 1000
BLANK = 0x20
UNKNOWN = "und"


@lru_cache(1)
def _folded() -> np.ndarray:
    """Every letter's lower-case code point; BLANK for what isn't a letter."""
    table = np.full(0x110000, BLANK, np.int64)
    for c in np.flatnonzero(_classes() == LETTER).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of the block and each document's bounds."""
    points, at = _codepoints(block.data)
    bounds = np.searchsorted(at, block.offsets)
    chars = np.insert(_folded()[points], bounds[:-1], BLANK)  # a blank before every document
    bounds = bounds + np.arange(block.count + 1)
    chars = np.append(chars, BLANK)
    letter = chars != BLANK
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of blanks, the one after a word
    keep[bounds[:-1]] = True
    keep[-1] = True
    new = np.concatenate([[0], np.cumsum(keep)])
    chars, bounds = chars[keep], new[bounds]
    letter = chars != BLANK
    n = len(chars)
    doc = np.repeat(np.arange(block.count + 1), np.append(np.diff(bounds), n - bounds[-1]))
    c = np.concatenate([chars, np.full(2, BLANK)])
    one, two, three = chars, c[:n] << 21 | c[1 : n + 1], c[:n] << 42 | c[1 : n + 1] << 21 | c[2 : n + 2]
    pad = np.concatenate([letter, [False, False]])
    is_two = letter | pad[1 : n + 1]
    # a blank after a word also stands before the next; the last of a document has nothing after it
    last = np.zeros(n, bool)
    last[np.append(bounds[1:], n) - 1] = True
    is_two &= ~(last & ~letter)
    is_three = is_two & pad[1 : n + 1]
    flags = np.stack([letter, is_two, is_three], 1)
    codes = np.stack([one, two, three], 1)[flags]
    size = flags.sum(axis=1)
    per_doc = np.bincount(doc, weights=size, minlength=block.count + 1).astype(np.int64)[: block.count]
    return codes, np.concatenate([[0], np.cumsum(per_doc)])


def ranked(codes: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    some, count = np.unique(codes, return_counts=True)
    return some[np.argsort(-count, kind="stable")[:depth]]


@dataclass(frozen=True)
class Profiles:
    """Sorted n-grams of all profiles and their rank in each language's (DEPTH: not there)."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, lists: dict[str, list[int]]) -> Profiles:
        names = sorted(lists)
        grams = np.unique(np.concatenate([np.array(lists[n], np.int64) for n in names])) if names else np.zeros(0, np.int64)
        ranks = np.full((len(grams), len(names)), DEPTH, np.int64)
        for k, n in enumerate(names):
            ranks[np.searchsorted(grams, np.array(lists[n], np.int64)), k] = np.arange(len(lists[n]))
        return cls(names, grams, ranks)

    def nearest(self, codes: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(codes)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = self.ranks[at]
        out = np.where((self.grams[at] == own)[:, None] & (there < DEPTH), np.abs(there - np.arange(len(own))[:, None]), DEPTH)
        total = out.sum(axis=0)
        k = int(total.argmin())
        return self.languages[k], 1 - int(total[k]) / (DEPTH * len(own))


def held_out(key: str = "doc_id") -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Profiles:
    """Profiles of all languages among the documents that aren't held out."""
    docs = docs.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text"), F.col(quoted(lang)).alias("lang"))
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    known = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # a hash of the id below the language's share of all hashes
    share = known.select("lang", (F.least(F.lit(1.0), PER_LANGUAGE / F.col("n")) * 2.0**62).alias("below"))
    sample = usable.join(F.broadcast(share), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < F.col("below")).select("lang", "text")  # LANGUAGES rows are sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                codes, bounds = ngrams(block)
                langs = np.repeat(np.array(names[block.first : block.first + block.count], object), np.diff(bounds))
                for name in set(names[block.first : block.first + block.count]):
                    some, count = np.unique(codes[langs == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(count)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= DEPTH)
    lists: dict[str, list[int]] = {}
    for name, gram, _ in sorted(top.select("lang", "gram", "place").collect(), key=lambda r: (r[0], r[2])):  # DEPTH rows a language
        lists.setdefault(name, []).append(gram)
    return Profiles.of(lists)


def predict_block(block: Block, profiles: Profiles) -> list[tuple[str, float]]:
    codes, bounds = ngrams(block)
    return [profiles.nearest(codes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, lang_pred and score of every document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = predict_block(block, profiles)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.count), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    [key, "lang_pred", "score"],
                )

    picked = docs.select(quoted(key), quoted(text))
    return picked.mapInArrow(run, f"{quoted(key)} {picked.dtypes[0][1]}, lang_pred string, score double")


def least_score(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang") -> float:
    """`MARGIN` times the `LOW_SHARE` quantile of scores, over all documents that are predicted as labelled; 0 if there are none.

    Scores are counted in `BINS` equal bins, whose counts come to the driver, so that the
    result doesn't depend on how documents are dealt to tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for block in blocks(batch.column(0)):
                found = zip(predict_block(block, profiles), labels[block.first : block.first + block.count], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([int(score * BINS) for (name, score), label in found if name == label], pa.int32())], ["bin"])

    labelled = docs.select(quoted(text), quoted(lang)).where(F.col(quoted(lang)).isNotNull())
    counts = labelled.mapInArrow(run, "bin int").groupBy("bin").agg(F.count("*").alias("n")).collect()  # BINS + 1 rows
    rank, below = LOW_SHARE * sum(r.n for r in counts), 0
    for r in sorted(counts, key=lambda r: r.bin):
        below += r.n
        if below >= rank:
            return MARGIN * r.bin / BINS
    return 0.0


def keep_known(docs: DataFrame, profiles: Profiles, least: float, text: str = "text") -> DataFrame:
    """Documents with a language of at least that score, all columns unchanged."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at)):
                good = [name != UNKNOWN and score >= least for name, score in predict_block(block, profiles)]
                yield batch.slice(block.first, block.count).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
