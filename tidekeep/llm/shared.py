"""Helpers of the corpus operators: shared folders, cut lineage and filters of bounded size."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder

FILTER_WORDS = 1 << 18
#: Of a filter that tasks hold: bits for each key, and its words at most (32 MB).
KEY_BITS, MOST_WORDS = 16, 1 << 22


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, set by spark.checkpoint.dir, as the session's checkpoint folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return context.getCheckpointDir()


def cut(frame: DataFrame, tidy: bool = True) -> DataFrame:
    """The frame, computed once and read back from the shared folder; lost executors don't undo it."""
    checkpoint_folder(frame.sparkSession)
    if tidy:  # shuffle files of what was cut before go when the driver collects its garbage; ask for it while nothing runs
        gc.collect()
        frame.sparkSession.sparkContext._jvm.System.gc()
    return frame.checkpoint()


def mostly(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids (id), and few others: a filter of fixed size before rows are dealt out.

    Two bits of one word stand for an id.  However many ids there are, at most FILTER_WORDS
    words are broadcast; with very many the filter lets all rows pass.
    """

    def word(code: Column) -> Column:
        return code.bitwiseAND(F.lit(FILTER_WORDS - 1))

    def bits(code: Column) -> Column:
        one = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(code, shift).bitwiseAND(F.lit(63)).cast("int"))
        return one(40).bitwiseOR(one(50))

    own = F.xxhash64("id")
    words = ids.select(word(own).alias("_word"), bits(own).alias("_set")).groupBy("_word").agg(F.bit_or("_set").alias("_set"))
    code = F.xxhash64("doc_id")
    passed = docs.withColumn("_word", word(code)).withColumn("_need", bits(code)).join(F.broadcast(words), "_word")
    return passed.where(F.col("_set").bitwiseAND(F.col("_need")) == F.col("_need")).select(docs.columns)


def key_code(*keys: str) -> Column:
    """The code that a KeyFilter knows a key by; null if a part of it is."""
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return F.when(known, F.xxhash64(*keys))


@dataclass(frozen=True)
class KeyFilter:
    """Holds for all keys that it was made of, and for few others; four bits of one word stand for a key."""

    words: np.ndarray

    @staticmethod
    def places(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        code = code.view(np.uint64)
        need = np.zeros(len(code), np.uint64)
        for shift in (28, 34, 40, 46):
            need |= np.uint64(1) << (code >> np.uint64(shift) & np.uint64(63))
        return (code & np.uint64(size - 1)).astype(np.int64), need

    def holds(self, codes: pa.Array) -> np.ndarray:
        """Whether each code may be a key's; never for nulls."""
        word, need = self.places(codes.fill_null(0).to_numpy(), len(self.words))
        return (self.words[word] & need == need) & codes.is_valid().to_numpy(zero_copy_only=False)


def key_filter(keys: DataFrame) -> KeyFilter:
    """Of the one column of keys, distinct `key_code`s; of more keys than fit its bound, it holds for more others."""
    n, size = keys.count(), min(1 << 10, MOST_WORDS)
    while size < MOST_WORDS and size * 64 < n * KEY_BITS:
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, need = KeyFilter.places(batch.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(need.view(np.int64))], ["word", "bits"])

    found = keys.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_WORDS rows
    words = np.zeros(size, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return KeyFilter(words)


def passing(docs: DataFrame, code: Column, some: KeyFilter) -> DataFrame:
    """Rows of docs for whose code the filter holds; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(some.holds(batch.column(batch.num_columns - 1))))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names)

    names = docs.columns
    return docs.select("*", code.alias("_code")).mapInArrow(run, docs.schema)
