"""The engine of one store: a buffer and a log in front of runs.

Threads may share an engine.  ``_guard`` is held for moments, around the buffer, the log and the manifest in memory; ``_section`` is held by the one
thread that makes runs.  A buffer that is being sealed stays readable until its run is committed, and writes go to the next one meanwhile.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import StoreConfig
from tidelog.errors import InvalidKeyError, KeyNotFoundError, MalformedOperationError
from tidelog.operators.lookup import get_many, get_many_or_fail, has_many
from tidelog.operators.merge import latest_wins, merge_runs, newest
from tidelog.operators.replay import asof_reads, mutations, reads_map, sequenced, summary
from tidelog.plans.compaction import CompactionPlan
from tidelog.schema import ENTRY, STATISTICS
from tidelog.trace import Listener, TraceEvent, TraceType, silent

Entry = tuple[str, str | None, int]


class MemoryBuffer:
    """The newest entry of each key; full when it has as many keys as its capacity."""

    def __init__(self, capacity: int):
        self.capacity, self._held = capacity, {}

    def put(self, entry: Entry) -> None:
        self._held[entry[0]] = entry

    def get(self, key: str) -> Entry | None:
        return self._held.get(key)

    def is_full(self) -> bool:
        return len(self._held) >= self.capacity

    def entries(self) -> list[Entry]:
        """In the order of the keys' bytes."""
        return [self._held[k] for k in sorted(self._held, key=str.encode)]

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)


class Counter:
    """Sequence numbers: the next is one more than the highest known."""

    def __init__(self, start: int = 0):
        self._at = start

    def next(self) -> int:
        self._at += 1
        return self._at

    def current(self) -> int:
        return self._at

    def advance_to(self, sequence: int) -> None:
        self._at = max(self._at, sequence)


@dataclass(frozen=True)
class Statistics:
    """From metadata alone."""

    sequence: int
    buffered: int
    buffer_capacity: int
    runs: int
    runs_per_level: dict[int, int]
    wal_entries: int

    @property
    def levels(self) -> int:
        return len(self.runs_per_level)

    @property
    def read_amplification(self) -> int:
        """Runs that a read of an absent key looks at, at worst."""
        return self.runs

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.sequence, self.buffered, self.buffer_capacity, self.runs, self.runs_per_level, self.wal_entries, self.levels, self.read_amplification)], STATISTICS)


@dataclass(frozen=True)
class RunSummary:
    """What a workload did; reads: the last value read of each key."""

    puts: int
    deletes: int
    gets: int
    reads: DataFrame

    @property
    def total(self) -> int:
        return self.puts + self.deletes + self.gets


class Engine:
    """Reads resolve by sequence, so the order of runs never decides what a key's value is."""

    def __init__(self, spark: SparkSession, config: StoreConfig, runs: Any, wal: Any, policy: Any, lock: Any, listener: Listener = silent, buffer: Callable[[int], Any] | None = None, sequence: Any = None):
        self.spark, self.config, self.runs, self.wal, self.policy, self.lock, self.listener = spark, config, runs, wal, policy, lock, listener
        self._new_buffer = buffer or MemoryBuffer
        self.buffer = self._new_buffer(config.buffer_capacity)
        self._sealing: Any = None
        self.sequence = sequence if sequence is not None else Counter(runs.highest_sequence())
        self._guard, self._section, self._depth = threading.RLock(), threading.RLock(), 0
        if config.recover_on_boot:
            self.recover()

    # -- single keys

    def put(self, key: str, value: str) -> None:
        if value is None:
            raise MalformedOperationError("a put needs a value")
        self._write(key, value)

    def delete(self, key: str) -> None:
        """A tombstone, also for a key that isn't known."""
        self._write(key, None)

    def _write(self, key: str, value: str | None) -> None:
        if key == "":
            raise InvalidKeyError("the key is empty")
        with self._guard:
            entry = (key, value, self.sequence.next())
            self.wal.append(entry)
            self.buffer.put(entry)
            full = self.buffer.is_full()
        self.listener(TraceEvent.write(key, entry[2], value is None))
        if full:
            self.flush()

    def get(self, key: str) -> str | None:
        """Null if the key is absent or deleted."""
        found = self.lookup(key)
        return found[1] if found else None

    def get_or_fail(self, key: str) -> str:
        value = self.get(key)
        if value is None:
            raise KeyNotFoundError(f"key not found: {key}")
        return value

    def has(self, key: str) -> bool:
        return self.get(key) is not None

    def lookup(self, key: str) -> Entry | None:
        """The newest entry, tombstones included.  The manifest leaves out runs by range, then by filter; one job reads the rest."""
        if key == "":
            raise InvalidKeyError("the key is empty")
        with self._guard:
            held = self.buffer.get(key) or (self._sealing.get(key) if self._sealing is not None else None)
            runs = self._runs()
        if held is not None:
            self.listener(TraceEvent.read(TraceType.READ_HIT, key, "buffer"))
            return held
        maybe = []
        for run in runs:
            if run.in_range(key) and self.runs.filter_of(run).might_contain(key):
                maybe.append(run)
            else:
                self.listener(TraceEvent.read(TraceType.READ_FILTER_SKIP, key, run.run_id))
        rows = {r["run_id"]: r for r in self.runs.read(maybe).where(F.col("key") == key).collect()} if maybe else {}  # one row for each run at most
        for run in maybe:
            if run.run_id not in rows:
                self.listener(TraceEvent.read(TraceType.READ_FALSE_POSITIVE, key, run.run_id))
        if not rows:
            self.listener(TraceEvent.read(TraceType.READ_MISS, key))
            return None
        best = max(rows.values(), key=lambda r: r["sequence"])
        self.listener(TraceEvent.read(TraceType.READ_HIT, key, best["run_id"]))
        return best["key"], best["value"], best["sequence"]

    # -- many keys

    def _runs(self) -> list[Any]:
        """In the order of reading."""
        return [r for level in self.runs.levels().values() for r in level]

    def _versions(self, wanted: Callable[[Any], bool] = lambda run: True) -> DataFrame:
        """Every version in the runs that are wanted and in the buffers, as they are together at one moment."""
        with self._guard:
            held = (self._sealing.entries() if self._sealing is not None else []) + self.buffer.entries()
            runs = [r for r in self._runs() if wanted(r)]
        return self.runs.read(runs).drop("run_id").unionByName(self.spark.createDataFrame(held, ENTRY))

    def _asked(self, keys: DataFrame) -> DataFrame:
        """The newest entry of each asked key that there is one of; only asked keys leave the scan to be resolved."""
        return latest_wins(self._versions().join(keys.select("key").distinct(), "key", "left_semi"))

    def entries(self, drop_tombstones: bool = False) -> DataFrame:
        """The newest entry of every key, buffer included."""
        return latest_wins(self._versions(), drop_tombstones)

    def view(self) -> DataFrame:
        """(key, value) of every live key."""
        return self.entries(True).select("key", "value")

    def get_many(self, keys: DataFrame) -> DataFrame:
        """(key, value)."""
        return get_many(self._asked(keys), keys)

    def get_many_or_fail(self, keys: DataFrame) -> DataFrame:
        return get_many_or_fail(self._asked(keys), keys)

    def has_many(self, keys: DataFrame) -> DataFrame:
        return has_many(self._asked(keys), keys)

    def scan(self, start: str, end: str) -> DataFrame:
        """(key, value) of live keys from start up to, not including, end, in order.  An extension: runs out of range are not read."""
        a, b = start.encode(), end.encode()
        some = self._versions(lambda r: r.max_key.encode() >= a and r.min_key.encode() < b)
        return latest_wins(some.where((F.col("key") >= start) & (F.col("key") < end)), True).select("key", "value").sort("key")

    # -- bulk writes

    def ingest(self, changes: DataFrame, once: str | None = None) -> str | None:
        """Mutations (pos, key, value) as one run; returns its id.

        ``once`` names the batch, ``<name>-<number>``: one that was taken in does nothing when it comes again, nor does an earlier one of its name, whatever
        has been merged since.  A name without a number is a batch by itself and stays in the manifest.  The buffer is sealed first, so that what it holds stays older.
        """
        with self._exclusive():
            if once and self.runs.has_applied(once):
                return once
            swapped: list[Any] = []

            def reserve(n: int) -> int:
                """The batch's numbers are taken at the moment at which the buffer is swapped: writes that come later get higher ones."""
                with self._guard:
                    swapped.append(self._swap())
                    base = self.sequence.current()
                    self.sequence.advance_to(base + n)
                    return base

            numbered = sequenced(changes.select("pos", "key", "value"), "pos", reserve).persist()
            if swapped[0]:
                self._seal(swapped[0])
            try:
                found = numbered.agg(F.count("*").alias("n"), F.max("sequence").alias("top"), F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))).alias("size"), F.count_if(F.coalesce(F.col("key") == "", F.lit(True))).alias("bad")).first()
                if not found["n"]:
                    return None
                if found["bad"]:
                    raise InvalidKeyError("a key is empty")
                if once:
                    self.runs.files.delete(self.runs.path(once))  # what an attempt before this one may have left
                run = self.runs.write_some(newest(numbered).select("key", "value", "sequence"), 0, found["n"], found["size"], once)
            finally:
                numbered.unpersist()
            with self._guard:
                self.runs.commit([run], sequence=found["top"], once=once)
            self.listener(TraceEvent.flush(run.run_id, run.count))
            self._compact()
            return run.run_id

    def replay(self, ops: DataFrame, progress: Callable[[int, int], None] | None = None, batches: int = 1) -> RunSummary:
        """Apply operations (pos, op, key, value) in their order; gets see exactly what came before them.

        In several batches, each a range of positions, ``progress`` hears (operations done, all) after each.
        """
        bounds = [None, *(ops.agg(F.percentile_approx("pos", [i / batches for i in range(1, batches)], 10_000).alias("q")).first()["q"] or [] if batches > 1 else []), None]
        done, reads, total = [0, 0, 0], [], ops.count() if progress else 0
        for low, high in zip(bounds, bounds[1:]):
            some = ops if low is None else ops.where(F.col("pos") > low)
            some = some if high is None else some.where(F.col("pos") <= high)
            n = summary(some).first()
            if n["gets"]:
                found = asof_reads(some, self.view())
                reads.append(self._kept(found, len(reads)))
            self.ingest(mutations(some))
            done = [a + b for a, b in zip(done, (n["puts"], n["deletes"], n["gets"]))]
            if progress:
                progress(sum(done), total)
        every = reduce(DataFrame.unionByName, reads) if reads else self.spark.createDataFrame([], "pos long, key string, value string")
        return RunSummary(*done, reads_map(every))

    def _kept(self, reads: DataFrame, n: int) -> DataFrame:
        """Written before the store changes under it, to a folder of its own that ``prune`` removes after the grace period."""
        path = f"{self.runs.folder}/reads/{uuid.uuid4().hex}-{n}"
        reads.write.parquet(path)
        return self.spark.read.schema(reads.schema).parquet(path)

    # -- maintenance

    @contextmanager
    def _exclusive(self) -> Iterator[None]:
        """One thread of one process at a time; whoever is inside may enter again."""
        with self._section:
            if self._depth:
                yield
                return
            with self.lock.hold():
                self._depth += 1
                try:
                    yield
                finally:
                    self._depth -= 1

    def _swap(self) -> tuple[Any, int] | None:
        """An empty buffer in place of a filled one, which stays readable; what the log had up to now, and the highest number."""
        with self._guard:
            if not len(self.buffer):
                return None
            self._sealing, self.buffer = self.buffer, self._new_buffer(self.config.buffer_capacity)
            return self.wal.rotate(), self.sequence.current()

    def _seal(self, swapped: tuple[Any, int] | None = None) -> str | None:
        """The buffer as a run.  Only the entries that the run has leave the log; a crash at any point leaves them in one of the two or in both."""
        if (swapped := swapped or self._swap()) is None:
            return None
        sealed, sequence = swapped
        held = self._sealing.entries()
        try:
            run = self.runs.write_some(self.spark.createDataFrame(held, ENTRY), 0, len(held), sum(len(k) + len(v or "") for k, v, _ in held))
            with self._guard:
                self.runs.commit([run], sequence=sequence)
                self._sealing = None
        except BaseException:
            with self._guard:  # back in front of what came meanwhile; the log still has all
                if self._sealing is not None:
                    came, self.buffer, self._sealing = self.buffer.entries(), self._sealing, None
                    for entry in came:
                        self.buffer.put(entry)
            raise
        with self._guard:
            self.wal.drop(sealed)
        self.listener(TraceEvent.flush(run.run_id, run.count))
        return run.run_id

    def flush(self) -> str | None:
        """Seal the buffer as a run, then compact.  Nothing happens to an empty buffer."""
        if not len(self.buffer):
            return None
        with self._exclusive():
            if (run_id := self._seal()) is not None:
                self._compact()
            return run_id

    def compact(self) -> int:
        """Merge until the policy has no plan; returns the number of merges."""
        with self._exclusive():
            return self._compact()

    def _compact(self) -> int:
        merges = 0
        while (plan := self.policy(self.runs.levels())) is not None:
            before = self.runs.count()
            self._merge(plan)
            merges += 1
            if self.runs.count() >= before:
                raise AssertionError("a merge must leave fewer runs")
        return merges

    def _merge(self, plan: CompactionPlan) -> None:
        merged = merge_runs([self.runs.read([r]).drop("run_id") for r in plan.inputs], plan.drop_tombstones)
        run = self.runs.write(merged, plan.target_level, plan.entry_count, sum(r.size for r in plan.inputs))
        with self._guard:
            self.runs.commit([run] if run else [], plan.input_ids, self.sequence.current())
        self.listener(TraceEvent.compaction(plan.input_ids, run.run_id if run else None, plan.target_level, plan.drop_tombstones))

    def recover(self) -> int:
        """Entries of the log back into the buffer; returns how many.  A buffer that fills is sealed once all are in."""
        n = 0
        with self._guard:
            for entry in self.wal.replay():
                held = self.buffer.get(entry[0])
                if held is None or held[2] <= entry[2]:
                    self.buffer.put(entry)
                self.sequence.advance_to(entry[2])
                n += 1
        if n and self.buffer.is_full():
            self.flush()
        return n

    def statistics(self) -> Statistics:
        with self._guard:
            per_level = {level: len(runs) for level, runs in self.runs.levels().items()}
            buffered = len({k for b in (self.buffer, self._sealing) if b is not None for k, _, _ in b.entries()})
        return Statistics(self.sequence.current(), buffered, self.config.buffer_capacity, sum(per_level.values()), per_level, self.wal.count())

    def levels(self) -> DataFrame:
        """A row for each run, in the order of reading."""
        return self.runs.table()

    def prune(self) -> int:
        """Remove runs that no manifest names, and kept reads, after the grace period; returns how many runs."""
        with self._exclusive():
            folder = f"{self.runs.folder}/reads"
            for name in self.runs.files.names(folder):
                if self.runs.files.age(f"{folder}/{name}") >= self.config.prune_grace:
                    self.runs.files.delete(f"{folder}/{name}")
            with self._guard:
                return self.runs.prune()

    def refresh(self) -> None:
        """Look for what other processes have committed."""
        with self._guard:
            self.runs.refresh()
            self.sequence.advance_to(self.runs.highest_sequence())

    def close(self) -> None:
        if hasattr(self.wal, "close"):
            self.wal.close()
