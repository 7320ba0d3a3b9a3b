import random

import numpy as np
import pytest

from tidekeep.schema import Options
from tidekeep.shell import Shell
from tidekeep.sources import manifest, sst
from tidekeep.sources.files import Files
from tidekeep.sources.manifest import Manifest, RunMeta
from tidekeep.store import Store
from tidekeep.streaming.ingest import ingest


def shape(store):
    return {k: [(r.min_key, r.max_key, r.num_pairs) for r in runs] for k, runs in enumerate(store.levels()) if runs}


def pairs(df):
    return [(r.key, r.value) for r in df.collect()]


def test_flush_persist_and_reopen(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(capacity=3))
    assert not s.insert(1, 1) and s.get(1) is None and s.close()
    assert s.open("db")
    for i in range(1, 8):
        assert s.insert(i, 10 * i)
    assert shape(s) == {1: [(1, 6, 6)]} and s.memory == {7: 70}
    assert pairs(s.scan(2, 5)) == [(k, 10 * k) for k in range(2, 6)] and pairs(s.scan(5, 2)) == []
    assert s.close()
    assert s.open("db") and s.memory == {7: 70} and shape(s) == {1: [(1, 6, 6)]}
    assert len(pairs(s.scan(1, 7))) == 7 and s.get(4) == 40 and s.get(99) is None
    s.close()


def test_full_memory_becomes_a_run_on_close(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(capacity=2))
    s.open("db")
    for i in range(1, 7):
        s.insert(i, 10 * i)
    assert shape(s) == {1: [(1, 4, 4)]} and len(s.memory) == 2
    s.close()
    s.open("db")
    assert shape(s) == {0: [(5, 6, 2)], 1: [(1, 4, 4)]} and not s.memory
    s.close()


def test_updates_and_deletes(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(capacity=3))
    s.open("db")
    for k, v in [(1, 1), (2, 2), (3, 3), (1, 9), (2, 8), (4, 4), (1, -1)]:
        s.insert(k, v)
    assert shape(s) == {1: [(1, 4, 4)]} and s.memory == {1: -1}
    assert pairs(s.scan(1, 9)) == [(1, -1), (2, 8), (3, 3), (4, 4)] and pairs(s.scan(1, 9, live_only=True)) == [(2, 8), (3, 3), (4, 4)]
    s.close()


def test_random_writes_match_a_dict(spark, tmp_path):
    rng, model = random.Random(11), {}
    s = Store(spark, str(tmp_path), Options(capacity=8))
    s.open("db")
    for step in range(60):
        k, v = rng.randint(-20, 20), rng.randint(-1, 5)
        s.insert(k, v)
        model[k] = v
        if step == 30:
            s.close()
            s.open("db")
    assert pairs(s.scan(-(2**31), 2**31 - 1)) == sorted(model.items())
    assert all(len(runs) <= 1 for runs in s.levels())
    probes = spark.createDataFrame([(k,) for k in range(-25, 26)], "key int")
    assert {r.key: r.value for r in s.multi_get(probes).collect()} == {k: model.get(k) for k in range(-25, 26)}
    s.close()


def test_bulk_load_and_registered_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.open("db")
    s.sequence(1, 5000)
    s.sequence(10, 1000, 3)
    assert s.get(1000) == 1000 and s.state().count() == 5000
    assert not s.add_run("nowhere") and s.compact_level(7)
    with pytest.raises(ValueError):
        s.insert(2**31, 0)
    with pytest.raises(ValueError):
        s.sequence(1, 2, 0)
    s.close()
    for bad in ("", "a/b", "a:b", "x?", "..", 'q"'):
        assert not s.open(bad)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(0, 1, 10, False), (1, 2, 20, False), (2, 1, 11, False)], "seq long, key int, value int, is_deleted boolean").coalesce(1).write.parquet(str(source / "a"))
    s = Store(spark, str(tmp_path))
    s.open("db")
    log = lambda: spark.readStream.schema("seq long, key int, value int, is_deleted boolean").parquet(str(source / "*"))
    ingest(log(), s, str(tmp_path / "cp")).awaitTermination()
    assert pairs(s.scan(0, 9)) == [(1, 11), (2, 20)]
    spark.createDataFrame([(3, 2, 0, True)], "seq long, key int, value int, is_deleted boolean").coalesce(1).write.parquet(str(source / "b"))
    ingest(log(), s, str(tmp_path / "cp")).awaitTermination()
    assert pairs(s.scan(0, 9)) == [(1, 11), (2, -1)]
    s.close()


SAMPLE = """# runs of a small store

next_sst_number=9
#
0,8,sst_8.txt,3,77,61

1,6,sst_6.txt,-4,70,118
1,6,short.txt
1,6,long.txt,1,2,3,4
zero,6,word.txt,1,2,3
0,7,wide.txt,99999999999,1,1
-1,7,below.txt,1,2,2
  2,9,edges.txt,1,2,2\t
2, 9,inner.txt,1,2,2
"""


def test_manifest(spark, tmp_path):
    m = Manifest.from_text(SAMPLE)
    assert m.next_number == 9 and [r.sst_number for r in m.runs] == [8, 6, 9] and m.take_number() == 9 and m.next_number == 10
    one = RunMeta(2, 42, "sst_42.txt", -100, 500, 1234)
    assert RunMeta.from_line(one.to_line()) == one and one.to_line() == "2,42,sst_42.txt,-100,500,1234"
    assert Manifest.from_text(m.to_text()) == m and Manifest.from_text("next_sst_number=x").next_number == 1
    zone = RunMeta(0, 1, "f", 10, 100, 1)
    assert all(zone.may_contain(k) for k in (10, 50, 100)) and not any(zone.may_contain(k) for k in (5, 9, 101, 200))
    assert zone.overlaps(100, 200) and not zone.overlaps(101, 200) and not zone.overlaps(50, 20)
    with pytest.raises(ValueError):
        RunMeta(0, 1, "a,b", 1, 2, 3)
    parsed = manifest.parse_lines(spark.createDataFrame([(x,) for x in SAMPLE.split("\n")], "line string"))
    assert {RunMeta(**r.asDict()) for r in parsed.collect()} == set(m.runs)


class Stop(Exception):
    pass


@pytest.mark.parametrize("steps", range(7))
def test_a_crash_after_any_step_loses_no_published_write(spark, tmp_path, steps, monkeypatch):
    s = Store(spark, str(tmp_path), Options(capacity=2))
    s.open("db")
    s.insert(1, 10)
    s.close()
    s.open("db")
    s.insert(1, 20)
    s.insert(2, 5)
    left = [steps]

    def counted(name):
        inner = getattr(s.files, name)

        def call(*args):
            if not left[0]:
                raise Stop
            left[0] -= 1
            return inner(*args)

        monkeypatch.setattr(s.files, name, call)

    for name in ("write_text", "remove"):
        counted(name)
    ended = False
    try:
        s.insert(3, 7)  # the full memory table becomes a run
        s.close()
        ended = True
    except Stop:
        pass
    t = Store(spark, str(tmp_path), Options(capacity=2))
    t.open("db")
    got = dict(pairs(t.scan(0, 9)))
    assert got in ([{1: 20, 2: 5, 3: 7}] if ended else [{1: 10}, {1: 20, 2: 5}, {1: 20, 2: 5, 3: 7}])
    assert got != {1: 10} or steps == 0
    for k in range(4, 9):  # and it takes writes again
        t.insert(k, k)
    t.close()
    t.open("db")
    assert dict(pairs(t.scan(0, 9))) == got | {k: k for k in range(4, 9)}
    t.close()


def test_late_rows_of_a_stream_change_nothing(spark, tmp_path):
    source = tmp_path / "in"
    s = Store(spark, str(tmp_path))
    s.open("db")
    for k, rows in enumerate([[(5, 1, 50), (6, 2, 60)], [(3, 1, 30), (7, 2, 70), (2, 3, 20)], [(4, 1, 40), (1, 3, 10), (9, 3, 90)]]):
        spark.createDataFrame(rows, "seq long, key int, value int").coalesce(1).write.parquet(str(source / f"part{k}"))
        ingest(spark.readStream.schema("seq long, key int, value int").parquet(str(source / "*")), s, str(tmp_path / "cp")).awaitTermination()
    assert pairs(s.scan(0, 9)) == [(1, 50), (2, 70), (3, 90)]
    s.close()


def test_files(spark, tmp_path):
    f = Files(spark)
    for name in ("1.txt", "2.txt", "3.txt", "incomplete.txt", "data.sst", "notanumber.txt"):
        f.write_text(f"{tmp_path}/{name}", "x")
    assert f.count_numbered(str(tmp_path)) == 3
    assert f.make_directory(f"{tmp_path}/d") and f.make_directory(f"{tmp_path}/d") and not f.make_directory(f"{tmp_path}/1.txt")
    f.write_text(f"{tmp_path}/1.txt", "new")
    assert f.read_text(f"{tmp_path}/1.txt") == "new" and f.read_text(f"{tmp_path}/none") is None
    assert f.remove(f"{tmp_path}/1.txt") and not f.remove(f"{tmp_path}/1.txt")


@pytest.mark.parametrize("n", [0, 1, 512, 513, 3000])
def test_run_files_round_trip(spark, tmp_path, n):
    made = np.stack([np.arange(n) * 2 - n, np.arange(n) * 7], 1).astype(np.int32).reshape(-1, 2)
    data = sst.encode(made)
    assert (sst.decode(data) == made).all()
    if n:
        assert len(data) == (1 + (1 if n > 512 else 0)) * 4096 + 8 * n + -(-n * 10 // 8)
        (tmp_path / "sst_1.txt").write_bytes(data)
        assert [(r.key, r.value) for r in sst.read(spark, f"{tmp_path}/sst_1.txt").orderBy("key").collect()] == [tuple(x) for x in made.tolist()]


def test_run_file_images(spark):
    runs = spark.createDataFrame([(0, 2, 20), (0, 1, 10), (1, 5, 50)], "run int, key int, value int")
    got = {r.run: sst.decode(bytes(r.content)).tolist() for r in sst.images(runs).collect()}
    assert got == {0: [[1, 10], [2, 20]], 1: [[5, 50]]}


def test_shell(spark, tmp_path):
    sh = Shell(Store(spark, str(tmp_path), Options(capacity=50)))
    assert sh.execute("   ") == "" and "open NAME" in sh.execute("search 1") and sh.execute("nope").startswith("Unknown command")
    assert sh.execute("open db") == "" and sh.execute("insert 5 500") == "" and sh.execute("i 6") == "" and sh.execute("i x y") == ""
    assert sh.execute("s 5") == "Found: 5 -> 500" and sh.execute("s 6") == "Key 6 not found"
    assert sh.execute("delete 6") == "Key 6 not found for deletion\nDeleted key 6" and sh.execute("s 6") == "Key 6 is marked as deleted"
    assert sh.execute("scan 1 10") == "Found 2 entries\n5\t500" and sh.execute("scan 6 6").endswith("marked as deleted") and sh.execute("scan 8 9") == "No entries found"
    sh.execute("seq 10 19 3")
    assert sh.execute("size") == "Memory: 6 / 50" and "Fill level: 12.0%" in sh.execute("status")
    assert sh.execute("compact 0") == "Level 0 compacted" and sh.execute("searchmode binary") == "Search mode: binary" and "Invalid" in sh.execute("searchmode x")
    assert "Next run: 1" in sh.execute("lsm") and "Inserted keys 1 to 20" in sh.execute("test 20") and sh.execute("s 5") == "Found: 5 -> 500"
    assert sh.execute("quit") == "Goodbye" and sh.done
