"""A database directory: a memory table, runs in levels, and the manifest that names them.

Single writes gather in a dict of at most `capacity` keys and become a run when it is full;
`load` takes a DataFrame of any size and writes it as one run without passing the driver.
Level L is compacted into L + 1 as soon as it holds two runs.  A compaction writes the new
run, publishes the manifest, and only then removes the old runs, so that a reader or a
crash never sees a manifest whose runs are gone.

The manifest also names the tail, what was in memory at the last close.  A flush publishes
its run and the end of that tail at once; runs and tails get names that aren't there yet.
So a crash between any two steps leaves a database that opens with every published write,
and at most directories that no manifest names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.merge import by_priority, latest, merge_runs
from .operators.reads import live, multi_get
from .schema import INT_MAX, INT_MIN, PAIRS, TOMBSTONE, Options
from .sources.files import Files
from .sources.manifest import Manifest, RunMeta
from .sources.runs import describe, read_runs, write_run

_BAD_NAME = re.compile(r'[/\\:*?"<>|]')


def _int32(x: int) -> int:
    if not INT_MIN <= x <= INT_MAX:
        raise ValueError(f"{x} is not a 32-bit integer")
    return int(x)


class Store:
    def __init__(self, spark: SparkSession, root: str, options: Options | None = None) -> None:
        self.spark, self.root, self.options = spark, root.rstrip("/"), options or Options()
        self.files = Files(spark)
        self.name: str | None = None
        self.memory: dict[int, int] = {}
        self.manifest = Manifest()

    # opening and closing

    @property
    def is_open(self) -> bool:
        return self.name is not None

    @property
    def path(self) -> str:
        return f"{self.root}/{self.name}"

    def open(self, name: str) -> bool:
        """Open or create a database; False for a name that can't be a directory.  One that is open is closed first."""
        if not name or _BAD_NAME.search(name) or name in (".", ".."):
            return False
        if self.is_open:
            self.close()
        if not self.files.make_directory(f"{self.root}/{name}"):
            return False
        self.name, self.memory = name, {}
        self.manifest = Manifest.from_text(self.files.read_text(f"{self.path}/manifest.txt") or "")
        if self.manifest.tail:
            self.memory = {r.key: r.value for r in read_runs(self.spark, [f"{self.path}/{self.manifest.tail}"]).collect()}  # at most one memory table
        return True

    def close(self) -> bool:
        """A full memory table becomes a run, a partial one the tail; True also if nothing is open."""
        if not self.is_open:
            return True
        if len(self.memory) == self.options.capacity:
            self.flush()
        old = self.manifest.tail
        self.manifest.tail = None
        if self.memory:
            self.manifest.tail = f"tail_{uuid.uuid4().hex}"
            self._memory_frame().coalesce(1).write.parquet(f"{self.path}/{self.manifest.tail}")
        self._save_manifest()
        self._forget(old)
        self.name, self.memory, self.manifest = None, {}, Manifest()
        return True

    def drop(self, name: str) -> bool:
        if name == self.name:
            self.name, self.memory, self.manifest = None, {}, Manifest()
        return bool(name) and not _BAD_NAME.search(name) and self.files.remove(f"{self.root}/{name}")

    def _save_manifest(self) -> None:
        self.files.write_text(f"{self.path}/manifest.txt", self.manifest.to_text())

    def _forget(self, tail: str | None) -> None:
        if tail:
            self.files.remove(f"{self.path}/{tail}")

    def _memory_frame(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.memory.items()), PAIRS)

    # writing

    def insert(self, key: int, value: int) -> bool:
        """Upsert; False if no database is open.  A full memory table is flushed before the write, even if that updates one of its keys."""
        if not self.is_open:
            return False
        key, value = _int32(key), _int32(value)
        if len(self.memory) >= self.options.capacity:
            self.flush()
        self.memory[key] = value
        return True

    def delete(self, key: int) -> bool:
        """Write a tombstone, whether or not the key is there."""
        return self.insert(key, TOMBSTONE)

    def load(self, log: DataFrame) -> bool:
        """Bulk write of a log (seq, key, value), newer than all before; the last version of each key becomes one run."""
        if not self.is_open:
            return False
        self.flush()
        return self._add_frame(latest(log).select("key", "value"), log.count())

    def sequence(self, start: int, end: int, step: int = 1) -> bool:
        """Pairs k -> k for k = start, start + step, ... up to end."""
        if not self.is_open or start > end:
            return False
        if step < 1:
            raise ValueError("step must be positive")
        _int32(start), _int32(end)
        if (end - start) // step + 1 <= self.options.capacity:
            return all(self.insert(k, k) for k in range(start, end + 1, step))
        keys = self.spark.range(start, end + 1, step)
        return self.load(keys.select(F.col("id").alias("seq"), F.col("id").cast("int").alias("key"), F.col("id").cast("int").alias("value")))

    def flush(self) -> bool:
        """The memory table becomes a run of level 0."""
        if not self.is_open:
            return False
        if self.memory:
            old, self.manifest.tail = self.manifest.tail, None  # in the manifest that names the run
            self._add_frame(self._memory_frame(), len(self.memory), old)
            self.memory = {}
        return True

    def _write(self, pairs: DataFrame, level: int, most: int) -> RunMeta | None:
        number = self.manifest.take_number()
        while self.files.exists(f"{self.path}/sst_{number}"):  # of a write that was never published
            number = self.manifest.take_number()
        name = f"sst_{number}"
        write_run(pairs, f"{self.path}/{name}", self.options, most)
        found = describe(read_runs(self.spark, [f"{self.path}/{name}"]), unique=True)
        if found is None:
            self.files.remove(f"{self.path}/{name}")
            return None
        return RunMeta(level, number, name, *found)

    def _add_frame(self, pairs: DataFrame, most: int, tail: str | None = None) -> bool:
        """Add a run of level 0; `tail` is the directory that it makes needless."""
        run = self._write(pairs, 0, most)
        if run is not None:
            self.manifest.runs.append(run)
            self._save_manifest()
            self._forget(tail)
            self.compact_level(0)
        return True

    def add_run(self, file_name: str, level: int = 0) -> bool:
        """Register a run directory that is already in the database; False if it isn't there."""
        path = f"{self.path}/{file_name}"
        if not self.is_open or not self.files.exists(path):
            return False
        found = describe(read_runs(self.spark, [path]))
        if found is None:
            return False
        self.manifest.runs.append(RunMeta(level, self.manifest.take_number(), file_name, *found))
        self._save_manifest()
        return self.compact_level(level)

    # compaction

    def needs_compaction(self, level: int) -> bool:
        return len(self.manifest.level(level)) >= 2

    def compact_level(self, level: int, drop_tombstones: bool = False) -> bool:
        """Merge the two oldest runs of a level into the next, and go on there; nothing to do is success.

        Tombstones may be dropped only in the last level.
        """
        if not self.is_open:
            return False
        while self.needs_compaction(level):
            older, newer = self.manifest.level(level)[:2]
            last = drop_tombstones and self.manifest.depth() <= level + 1
            new, old = (read_runs(self.spark, [f"{self.path}/{r.file_name}"]) for r in (newer, older))
            run = self._write(merge_runs(new, old, last), level + 1, older.num_pairs + newer.num_pairs)
            self.manifest.runs = [r for r in self.manifest.runs if r not in (older, newer)] + ([run] if run else [])
            self._save_manifest()
            for r in (older, newer):
                self.files.remove(f"{self.path}/{r.file_name}")
            level += 1
        return True

    # reading

    def state(self, low: int = INT_MIN, high: int = INT_MAX) -> DataFrame:
        """All pairs with low <= key <= high, tombstones included; only runs whose range meets it are opened."""
        kept = [r for r in self.manifest.runs if r.overlaps(low, high)] if self.is_open else []
        # newest first: memory, then levels upwards, in a level the later run
        kept = sorted(kept, key=lambda r: (r.level, -r.sst_number))
        parts = [self._memory_frame().withColumn("level", F.lit(-1))] if self.memory else []
        parts += [read_runs(self.spark, [f"{self.path}/{r.file_name}"]).withColumn("level", F.lit(k)) for k, r in enumerate(kept)]
        parts = [p.where(F.col("key").between(low, high)) for p in parts]
        if not parts:
            return self.spark.createDataFrame([], PAIRS)
        if len(parts) == 1:
            return parts[0].select("key", "value")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return by_priority(every).select("key", "value")

    def get(self, key: int) -> int | None:
        """The value of a key, TOMBSTONE if deleted, None if never written.  For many keys use multi_get."""
        if not self.is_open:
            return None
        if key in self.memory:
            return self.memory[key]
        row = self.state(key, key).first()
        return None if row is None else row.value

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return multi_get(self.state(), probes)

    def scan(self, low: int, high: int, live_only: bool = False) -> DataFrame:
        """Pairs of a range in key order."""
        found = self.state(low, high) if low <= high else self.spark.createDataFrame([], PAIRS)
        return (live(found) if live_only else found).orderBy("key")

    def levels(self) -> list[list[RunMeta]]:
        return [self.manifest.level(k) for k in range(self.manifest.depth())]
