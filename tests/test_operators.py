import random

import pytest

from pyspark.sql import functions as F
from tidekeep.functions.murmur import murmur3_32
from tidekeep.operators import btree, cache, epochs, merge, pruning, reads
from tidekeep.operators.ranks import with_rank
from tidekeep.schema import PAIRS


def frame(spark, pairs):
    return spark.createDataFrame(sorted(dict(pairs).items()), PAIRS)


def as_dict(df):
    return {r.key: r.value for r in df.collect()}


SCANS = [
    ([(k, 10 * k) for k in (10, 20, 30, 40, 50)], [((10, 50), 5), ((20, 40), 3), ((30, 30), 1), ((35, 38), 0), ((100, 200), 0)]),
    ([(10 * i, 100 * i) for i in range(1, 21)], [((10, 200), 20), ((50, 150), 11), ((10, 80), 8), ((140, 200), 7)]),
    ([(2 * i, 20 * i) for i in range(1, 101)], [((2, 200), 100), ((50, 70), 11), ((100, 120), 11)]),
    ([(10, 1), (20, 2), (30, 3)], [((30, 10), 0), ((5, 35), 3), ((15, 100), 2)]),
    ([(42, 420)], [((42, 42), 1), ((1, 100), 1), ((1, 40), 0)]),
    ([(-1000, -5000), (-1, -1), (0, 0), (1, 1), (1000, 5000)], [((-2000, -1), 2), ((-(2**31), 2**31 - 1), 5)]),
]


@pytest.mark.parametrize("pairs,expected", SCANS)
def test_range_scans_are_inclusive_and_sorted(spark, pairs, expected):
    state = frame(spark, pairs)
    for (low, high), n in expected:
        found = [(r.key, r.value) for r in reads.sorted_scan(state, low, high).collect()]
        assert found == sorted((k, v) for k, v in pairs if low <= k <= high) and len(found) == n


def test_large_run_scans(spark):
    state = spark.range(1, 256001).selectExpr("cast(id as int) key", "cast(id * 10 as int) value")
    for (low, high), n in [((1, 256000), 256000), ((100000, 150000), 50001), ((128000, 128100), 101), ((255000, 256000), 1001), ((0, 0), 0)]:
        assert reads.range_scan(state, low, high).count() == n
    assert reads.point_get(state, 77777).first().value == 777770


def test_point_multi_and_live_reads(spark):
    state = frame(spark, [(1, 10), (2, -1), (3, 30)])
    probes = spark.createDataFrame([(1,), (2,), (9,)], "key int")
    assert {(r.key, r.status, r.value) for r in reads.multi_get(state, probes).collect()} == {(1, "found", 10), (2, "deleted", -1), (9, "not_found", None)}
    assert as_dict(reads.live(state)) == {1: 10, 3: 30}
    assert tuple(reads.scan_counts(state, 1, 3).first()) == (3, 2, 1)
    assert [r.value for r in reads.in_order(state).orderBy("pos").collect()] == [10, -1, 30]


def test_latest_matches_a_dict(spark):
    rng = random.Random(3)
    log = [(i, rng.randint(-50, 50), rng.choice([-1, rng.randint(0, 99)])) for i in range(2000)]
    assert as_dict(merge.latest(spark.createDataFrame(log, "seq long, key int, value int"))) == {k: v for _, k, v in log}


def test_merges(spark):
    ten = lambda a, b, f=10: [(k, f * k) for k in range(a, b + 1)]
    run = lambda a, b: merge.merge_runs(frame(spark, a), frame(spark, b))
    assert len(as_dict(run(ten(1, 20), ten(21, 40)))) == 40
    assert len(as_dict(run(ten(1, 30), ten(20, 50)))) == 50
    assert as_dict(run([(k, 100 * k) for k in range(1, 21)], [(k, 999 * k) for k in range(1, 21)])) == {k: 100 * k for k in range(1, 21)}
    assert len(as_dict(run([(k, k) for k in range(1, 40, 2)], [(k, k) for k in range(2, 41, 2)]))) == 40
    assert as_dict(merge.merge_runs(frame(spark, [(1, -1)]), frame(spark, [(1, 5), (2, 6)]), drop_tombstones=True)) == {2: 6}


def test_level_priority(spark):
    upper, lower = [(k, 999 * k) for k in range(5, 16)], [(k, 100 * k) for k in range(1, 21)]
    found = {r.key: (r.value, r.source) for r in merge.priority_union([frame(spark, upper), frame(spark, lower)]).collect()}
    assert found[10] == (9990, 0) and found[20] == (2000, 1) and found[5] == (4995, 0) and 99 not in found


def test_ranks_with_gaps_and_negative_keys(spark):
    keys = random.Random(1).sample(range(-(2**31), 2**31), 3000) + [-(2**31), 2**31 - 1]
    keys = sorted(set(keys))
    got = {r.key: r.rank for r in with_rank(spark.createDataFrame([(k, 0) for k in keys], PAIRS)).collect()}
    assert got == {k: i for i, k in enumerate(keys)}
    assert with_rank(spark.createDataFrame([], PAIRS)).count() == 0


def test_bloom_positions_and_probe(spark):
    one = spark.createDataFrame([(0, 42, 1000), (1, 43, 1000), (2, -100, 50)], "run int, key int, bits int")
    from pyspark.sql import functions as F

    from tidekeep.functions.bloom import positions

    got = {r.key: list(r.p) for r in one.select("key", positions(F.col("key"), 3, F.col("bits")).alias("p")).collect()}
    assert got == {42: [42, 773, 504], 43: [43, 773, 503], -100: [46, 39, 32]}
    runs = spark.range(1, 101).selectExpr("0 run", "cast(id as int) key")
    found = pruning.manifest_of(runs)
    assert pruning.bloom_positions(runs, found).count() == 208
    assert tuple(pruning.bloom_size(found).first()) == (0, 1000, 125)
    even = spark.range(1, 1001).selectExpr("0 run", "cast(id * 2 as int) key")
    stats = pruning.manifest_of(even)
    assert pruning.bloom_positions(even, stats).count() == 1777
    odd = spark.range(3, 2002, 2).selectExpr("cast(id as int) key", "0 run")
    assert pruning.bloom_probe(odd, even, stats).count() == 0
    assert pruning.bloom_probe(even.select("key", "run"), even, stats).count() == 1000


def test_zones(spark):
    found = spark.createDataFrame([(1, 10, 100, 45), (2, 90, 300, 9)], "run int, min_key int, max_key int, num_pairs long")
    probes = spark.createDataFrame([(k,) for k in (5, 9, 10, 50, 95, 100, 101, 200, 301)], "key int")
    expected = {(k, 1) for k in (10, 50, 95, 100)} | {(k, 2) for k in (95, 100, 101, 200)}
    for width in (1, 7, 1000):
        assert {(r.key, r.run) for r in pruning.zone_contains(probes, found, width).collect()} == expected
    assert [r.run for r in pruning.zone_overlap(found, 101, 400).collect()] == [2]


def test_page_directory(spark):
    state = spark.range(1, 61).selectExpr("cast(id as int) key", "cast(id as int) value")
    got = {(r.level, r.node): list(r.keys_) for r in btree.separators(state, 3, 4).withColumnRenamed("keys", "keys_").collect()}
    assert got == {
        **{(1, k): [12 * k + 3, 12 * k + 6, 12 * k + 9] for k in range(5)},
        (2, 0): [12, 24, 36],
        (2, 1): [],
        (3, 0): [48],
    }
    routed = {r.key: r.page for r in btree.route(state, spark.createDataFrame([(k,) for k in (-5, 1, 3, 4, 60, 61)], "key int"), 3).collect()}
    assert routed == {-5: 0, 1: 0, 3: 0, 4: 1, 60: 19, 61: None}
    assert {(r.page, r.keys_hit) for r in btree.page_locality(state, spark.createDataFrame([(1,), (2,), (60,), (99,)], "key int"), 3).collect()} == {(0, 2), (19, 1)}


def test_epochs_against_a_simulation(spark):
    rng = random.Random(5)
    for capacity in (1, 3, 10):
        keys = [rng.randint(0, 25) for _ in range(400)]
        held, flushed = set(), 0
        for k in keys:
            if len(held) >= capacity:
                held, flushed = set(), flushed + 1
            held.add(k)
        log = spark.createDataFrame([(0, i, k) for i, k in enumerate(keys)], "store int, seq long, key int")
        rows = epochs.flush_epochs(log, capacity).orderBy("epoch").collect()
        assert len(rows) == flushed + 1 and rows[-1].num_keys == len(held) and not rows[-1].flushed and all(r.flushed and r.num_keys == capacity for r in rows[:-1])
        assert sum(r.num_writes for r in rows) == 400


def test_level_shape(spark):
    one = spark.createDataFrame([(9,)], "flushes long")
    assert {(r.level, r.num_pairs) for r in epochs.level_shape(one, 1000).collect()} == {(0, 1000), (3, 8000)}


@pytest.mark.parametrize(
    "capacity,trace,expected",
    [(3, "ABCDABE", "M M M M-A M-B M-C M-D"), (3, "ABCADEAB", "M M M H M-A M-B M-C M-D"), (1, "AABA", "M H M-A M-B"), (2, "ABACBAC", "M M H M-A H M-B H")],
)
def test_clock(spark, capacity, trace, expected):
    rows = spark.createDataFrame([(0, i, p) for i, p in enumerate(trace)], "trace_id int, step int, page string")
    got = cache.clock_trace(rows, capacity).orderBy("step").collect()
    assert " ".join("H" if r.hit else "M" + (f"-{r.evicted}" if r.evicted else "") for r in got) == expected


def test_clock_removal_reuses_the_slot():
    c = cache.Clock(2)
    c.access("a"), c.access("b")
    assert c.remove("a") and not c.remove("a") and len(c) == 1
    assert c.access("c") == (False, None) and len(c) == 2
    with pytest.raises(ValueError):
        cache.Clock(0)
    with pytest.raises(ValueError):
        cache.Clock(1).evict()


def test_murmur_and_buckets(spark):
    known = {"hello": 0x248BFA47, "": 0, "test": 0xBA6BD213, "Hello, world!": 0xC0363E43, None: None}
    texts = spark.createDataFrame([(t,) for t in known], "t string")
    assert {r.t: r.h for r in texts.select("t", murmur3_32(F.col("t")).alias("h")).collect()} == known
    names = ["file1.db:0", "file1.db:4096", "file2.db:0", "sst_1.txt:0"]
    hashed = {r.t: r.h for r in spark.createDataFrame([(n,) for n in names], "t string").select("t", murmur3_32(F.col("t")).alias("h")).collect()}
    assert [hashed[n] for n in names] == [3387226876, 3174138570, 2266902405, 3193323800]
    assert [cache.bucket_count(n) for n in (1, 11, 16, 3328)] == [1, 16, 16, 4096]
    pages = spark.createDataFrame([("file1.db", 0), ("file1.db", 4096), ("file2.db", 0), ("sst_1.txt", 0)], "file_name string, offset long")
    assert {r.bucket for r in cache.with_bucket(pages, 3328).collect()} == {2812, 714, 3973, 280}
    assert tuple(cache.bucket_stats(pages, 3328).first()) == (4, 4096, 4 / 4096, 1, 1.0, 4092)
