"""Queries over the driver's tables, one for each operator, read as write logs.

`orders` is an upsert log (o_orderkey is the sequence, o_custkey the key, o_totalprice the
value); `events` one with deletes (event_type `error` writes a tombstone).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import btree, cache, epochs, merge, pruning, reads
from ..schema import TOMBSTONE, Options
from ..sources import manifest, sst
from ..sources.files import shared_folder
from ..sources.runs import write_run
from ..store import Store

Query = Callable[[SparkSession, str], DataFrame]

CAPACITY = 64
RUN_WRITES = 1000


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return t.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("int").alias("key"), F.floor("o_totalprice").cast("int").alias("value"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = t.select(F.col("event_id").alias("seq"), F.col("user_id").cast("int").alias("key"), F.round(F.col("value") * 100).cast("int").alias("value"), (F.col("event_type") == "error").alias("is_deleted"))
    return merge.encode_deletes(log)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest(_orders(spark, sf_dir))


def _event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest(_events(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of an insert-only log: disjoint key ranges."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return t.select(F.floor(F.col("o_orderkey") / float(RUN_WRITES)).cast("int").alias("run"), F.col("o_orderkey").cast("int").alias("key"))


def _wide_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight runs of the customer log: overlapping key ranges with gaps."""
    log = _orders(spark, sf_dir)
    last = log.agg(F.max("seq").alias("last"))
    run = F.floor(F.col("seq") * 8 / (F.col("last") + 1)).cast("int").alias("run")
    return log.join(F.broadcast(last)).groupBy(run, "key").agg(F.max_by("value", "seq").alias("value"))  # one row


def _fraction(log: DataFrame, low: float, high: float) -> DataFrame:
    """Writes whose sequence number lies in that share of the log."""
    last = log.agg(F.max("seq").alias("_last"))
    share = F.col("seq") / (F.col("_last") + 1)
    return log.join(F.broadcast(last)).where((share >= low) & (share < high)).drop("_last")  # one row


def _keys(spark: SparkSession, sf_dir: str, factor: int, shift: int) -> DataFrame:
    return _orders(spark, sf_dir).select((F.col("key") * factor + shift).cast("int").alias("key")).distinct()


def state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir)


def state_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_state(spark, sf_dir)


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the filter passes through the aggregation on the key and reaches the scan
    return reads.point_get(_state(spark, sf_dir), 42)


def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.range_scan(_state(spark, sf_dir), 100, 200)


def range_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.range_scan(_state(spark, sf_dir), 200, 100)


def sorted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.sorted_scan(_state(spark, sf_dir), -(2**31), 2**31 - 1)


def live_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.live(_event_state(spark, sf_dir))


def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan_counts(_event_state(spark, sf_dir), 20, 90)


def multi_get_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("int").alias("key")).distinct()
    return reads.multi_get(_event_state(spark, sf_dir), probes)


def inorder_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.in_order(_state(spark, sf_dir))


def pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.by_value_order(_orders(spark, sf_dir).select("key", "value"))


def merge_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _orders(spark, sf_dir)
    return merge.merge_runs(merge.latest(_fraction(log, 0.5, 1.0)), merge.latest(_fraction(log, 0.0, 0.5)))


def merge_last_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir)
    return merge.merge_runs(merge.latest(_fraction(log, 0.5, 1.0)), merge.latest(_fraction(log, 0.0, 0.5)), drop_tombstones=True)


def level_priority_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _orders(spark, sf_dir)
    parts = [(0, 0.8, 1.0), (1, 0.5, 0.8), (3, 0.0, 0.5)]
    tagged = [merge.latest(_fraction(log, a, b)).withColumn("level", F.lit(k)) for k, a, b in parts]
    return merge.by_priority(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]))


def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _orders(spark, sf_dir)
    return merge.priority_union([merge.latest(_fraction(log, 0.95, 1.0)), merge.latest(_fraction(log, 0.0, 0.95))])


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruning.manifest_of(_runs(spark, sf_dir))


def zone_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruning.zone_contains(_keys(spark, sf_dir, 11, 0), pruning.manifest_of(_runs(spark, sf_dir)), RUN_WRITES)


def zone_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruning.zone_overlap(pruning.manifest_of(_runs(spark, sf_dir)), 2500, 4500).select("run")


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pruning.manifest_of(_runs(spark, sf_dir))
    named = found.select(F.lit(0).alias("level"), F.col("run").alias("sst_number"), F.concat(F.lit("sst_"), F.col("run").cast("string"), F.lit(".txt")).alias("file_name"), "min_key", "max_key", "num_pairs")
    return manifest.lines_of(named)


MANIFEST_SAMPLE = ["# runs of a small store", "", "next_sst_number=9", "#", "0,8,sst_8.txt,3,77,61", "1,6,sst_6.txt,-4,70,118", "1,6,short.txt", "1,6,long.txt,1,2,3,4", "zero,6,word.txt,1,2,3", "3,31,sst_31.txt,-900,901,1802", "0,7,wide.txt,99999999999,1,1", "-1,7,below.txt,1,2,2", "  2,9,edges.txt,1,2,2  ", "2, 9,inner.txt,1,2,2"]


def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.parse_lines(spark.createDataFrame([(x,) for x in MANIFEST_SAMPLE], "line string"))


def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.parse_lines(manifest_lines(spark, sf_dir)).select("sst_number", "min_key", "max_key", "num_pairs")


def _order_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.flush_epochs(_orders(spark, sf_dir).withColumn("store", F.lit(0)), CAPACITY)


def flush_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_epochs(spark, sf_dir).select("epoch", "first_seq", "min_key", "max_key", "num_keys", "num_writes")


def flush_epochs_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    log = t.select((F.ascii("o_orderpriority") - 48).alias("store"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("int").alias("key"))
    found = epochs.flush_epochs(log, CAPACITY)
    return found.groupBy("store").agg(F.count(F.when(F.col("flushed"), 1)).alias("flushes"), F.sum("num_writes").alias("writes"))


def level_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    flushes = t.agg(F.floor((F.count("*") - 1) / CAPACITY).cast("long").alias("flushes"))
    return epochs.level_shape(flushes, CAPACITY)


def memtable_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.memtable_status(_order_epochs(spark, sf_dir), CAPACITY).drop("store")


def bloom_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return pruning.bloom_positions(runs, pruning.manifest_of(runs))


def bloom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruning.bloom_size(pruning.manifest_of(_runs(spark, sf_dir)))


def _wide_probes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    runs = _wide_runs(spark, sf_dir).select("run", "key")
    found = pruning.manifest_of(runs)
    return pruning.zone_contains(_keys(spark, sf_dir, 1, 1), found, 1 << 10), runs, found


def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruning.bloom_probe(*_wide_probes(spark, sf_dir))


def bloom_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruning.bloom_quality(*_wide_probes(spark, sf_dir))


def run_read_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _wide_runs(spark, sf_dir)
    return pruning.read_path(_keys(spark, sf_dir, 1, 1), runs, pruning.manifest_of(runs), 1 << 10)


def leaf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return btree.leaf_pages(_state(spark, sf_dir))


def internal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return btree.internal_levels(_state(spark, sf_dir), 16, 5)


def internal_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return btree.separators(_state(spark, sf_dir), 16, 5).select("level", "node", F.concat_ws(",", F.transform("keys", lambda k: k.cast("string"))).alias("keys"))


def route_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return btree.route(_state(spark, sf_dir), _keys(spark, sf_dir, 1, 3), 64)


def leaf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return btree.leaf_search(_state(spark, sf_dir), _keys(spark, sf_dir, 1, 3), 64)


def _run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary files of the runs of the insert-only log; a run has at most `RUN_WRITES` pairs."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return sst.images(t.select(F.floor(F.col("o_orderkey") / float(RUN_WRITES)).cast("int").alias("run"), F.col("o_orderkey").cast("int").alias("key"), F.floor("o_totalprice").cast("int").alias("value")))


def run_file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.headers(_run_files(spark, sf_dir))


def run_file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.pairs_of(_run_files(spark, sf_dir))


def page_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return btree.page_locality(_state(spark, sf_dir), _keys(spark, sf_dir, 1, 3), 64)


LOADS = 5


def _new_store(spark: SparkSession, name: str, options: Options | None = None) -> Store:
    store = Store(spark, f"{shared_folder(spark)}/store_{uuid.uuid4().hex}", options)
    store.open(name)
    return store


def _loaded(spark: SparkSession, sf_dir: str) -> Store:
    """A store that took the order log in `LOADS` loads one after another, was closed, and is open again."""
    store = _new_store(spark, "orders")
    log = _orders(spark, sf_dir)
    end = (log.agg(F.max("seq")).first()[0] or 0) + 1
    for k in range(LOADS):
        store.load(log.where((F.col("seq") * LOADS >= k * end) & (F.col("seq") * LOADS < (k + 1) * end)))
    store.close()
    store.open("orders")
    return store


def store_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store reads after loads, compactions, close and open."""
    return _loaded(spark, sf_dir).state().select("key", "value")


def store_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that compaction leaves of those loads."""
    runs = [(r.level, r.min_key, r.max_key, r.num_pairs) for level in _loaded(spark, sf_dir).levels() for r in level]
    return spark.createDataFrame(runs, "level int, min_key int, max_key int, num_pairs long")


def store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).multi_get(_keys(spark, sf_dir, 2, 1))


def _written(spark: SparkSession, sf_dir: str) -> Store:
    """A store of 8 keys in memory that took a write for every nation, one by one, was closed, and is open again.

    The key is n_nationkey mod 20, so that some are written twice; region 0 deletes.
    """
    store = _new_store(spark, "nations", Options(capacity=8))
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").toLocalIterator():
        if r.n_regionkey == 0:
            store.delete(r.n_nationkey % 20)
        else:
            store.insert(r.n_nationkey % 20, 100 * r.n_regionkey + r.n_nationkey)
    store.close()
    store.open("nations")
    return store


def store_point_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).state().select("key", "value")


def store_live_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).scan(2, 17, live_only=True)


def store_point_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that point writes leave; level -1 is what is in memory again after close and open."""
    store = _written(spark, sf_dir)
    runs = [(r.level, r.min_key, r.max_key, r.num_pairs) for level in store.levels() for r in level]
    if store.memory:
        runs.append((-1, min(store.memory), max(store.memory), len(store.memory)))
    return spark.createDataFrame(runs, "level int, min_key int, max_key int, num_pairs long")


def store_added_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the event log, written as runs beside a store and then added to it, which merges them."""
    store, log = _new_store(spark, "events"), _events(spark, sf_dir)
    for name, low, high in (("older", 0.0, 0.5), ("newer", 0.5, 1.0)):
        half = merge.latest(_fraction(log, low, high))
        write_run(half, f"{store.path}/{name}", store.options, half.count())
        store.add_run(name)
    return store.state().select("key", "value")


def seq_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark, "steps")
    store.sequence(10, 1000, 3)
    return store.state()


def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after as many sequential pairs as there are orders."""
    store = _new_store(spark, "bulk")
    store.sequence(1, spark.read.parquet(f"{sf_dir}/orders.parquet").count())
    return store.state().agg(F.count("*").alias("num_pairs"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum(F.col("value").cast("long")).alias("total"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses of the runs that flushes of the order log leave: 8 pages of 4096 bytes each."""
    runs = _runs(spark, sf_dir).select(F.concat(F.lit("sst_"), F.col("run").cast("string"), F.lit(".txt")).alias("file_name")).distinct()
    pages = runs.select("file_name", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("page"))
    return pages.select("file_name", (F.col("page") * 4096).alias("offset"))


def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.bucket_stats(_pages(spark, sf_dir), 3328)


def clock_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a trace of their own: each touches the page of its event number."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    trace = t.select(F.col("user_id").cast("int").alias("trace_id"), F.col("event_id").cast("int").alias("step"), F.concat(F.lit("p"), (F.floor(F.col("value")) % 12).cast("int").cast("string")).alias("page"))
    return cache.clock_trace(trace, 4)


def clock_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hit_rate(clock_trace(spark, sf_dir))


def tombstone_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_state(spark, sf_dir).agg(F.count("*").alias("num_keys"), F.count(F.when(F.col("value") == TOMBSTONE, 1)).alias("num_deleted"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        state_latest,
        state_with_tombstones,
        point_get,
        range_scan,
        range_inverted,
        sorted_scan,
        live_scan,
        scan_counts,
        multi_get_classify,
        inorder_values,
        pair_order,
        merge_two_runs,
        merge_last_level,
        level_priority_read,
        priority_union,
        run_manifest,
        zone_contains,
        zone_overlap,
        manifest_lines,
        manifest_parse,
        manifest_round_trip,
        flush_epochs,
        flush_epochs_by_store,
        level_shape,
        memtable_status,
        bloom_positions,
        bloom_size,
        bloom_probe,
        bloom_quality,
        leaf_pages,
        internal_levels,
        internal_separators,
        route_key,
        leaf_search,
        run_read_path,
        run_file_headers,
        run_file_pairs,
        page_locality,
        store_reopened,
        store_levels,
        store_multi_get,
        store_point_writes,
        store_live_scan,
        store_point_levels,
        store_added_runs,
        seq_load,
        bulk_load,
        bucket_stats,
        clock_trace,
        clock_hits,
        tombstone_share,
    )
}
