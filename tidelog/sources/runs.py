"""Runs: immutable sorted Parquet folders under a versioned manifest.

A manifest is one JSON file, ``manifest/<version>.json``, published only if no file has that name yet.  A commit reads
the newest, adds and removes runs, and publishes the next: readers see the runs before it or after it and nothing
between, and of two writers that start from one version the second is refused.  Run folders are written before the
commit that names them; a folder that no manifest names is an orphan, invisible.

A commit never deletes: whoever has planned a read of a run that was merged meanwhile can still finish it.  Retired runs and orphans
are removed by ``prune`` once they have been so for the grace period, which has to be longer than any read or write takes.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import ConflictError, CorruptManifestError, EmptyRunError, RunNotFoundError
from tidelog.functions.bloom import BLOCK_BYTES, BloomFilter, NullFilter, filter_blocks, filter_size, writer_options
from tidelog.operators.merge import run_metadata
from tidelog.schema import ENTRY, RUN
from tidelog.sources.files import Files

#: Bytes of keys and values in a file of a run, and what an entry has beside its text.
FILE_BYTES, ENTRY_BYTES = 256 << 20, 16
#: Blocks of filters kept in memory, 4 kB each.
KEPT_BLOCKS = 4096


def sequential_ids(start: int = 0) -> Callable[[], str]:
    """R1, R2, ..."""
    n = start

    def make() -> str:
        nonlocal n
        n += 1
        return f"R{n}"

    return make


def unique_ids() -> str:
    """Ids that sort by time and don't meet."""
    return f"{int(time.time() * 1000):012x}-{os.urandom(5).hex()}"


@dataclass(frozen=True)
class Run:
    """What the manifest knows of a run."""

    run_id: str
    level: int
    run_no: int
    count: int
    min_key: str
    max_key: str
    max_sequence: int
    size: int = 0  # bytes of keys and values
    filter_bits: int = 0
    filter_hashes: int = 0

    def in_range(self, key: str) -> bool:
        """By bytes, as all keys are ordered."""
        return self.min_key.encode() <= key.encode() <= self.max_key.encode()


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    sequence: int = 0  # the highest ever given out; it outlives the runs that held it
    run_no: int = 0
    runs: tuple[Run, ...] = ()
    #: The highest number of each named row of batches; a batch is known for ever, whatever became of its run.
    applied: dict[str, int] = field(default_factory=dict)
    #: Merged runs whose folders are still there, and when they were retired.
    retired: dict[str, float] = field(default_factory=dict)


def batch_of(once: str) -> tuple[str, int]:
    """``events-000012`` is batch 12 of events; a name without a number is a batch by itself."""
    name, _, number = once.rpartition("-")
    return (name, int(number)) if name and number.isdigit() else (once, 0)


class FileRunStore:
    """Runs of one store under a folder."""

    def __init__(self, spark: SparkSession, folder: str, bits_per_key: int = 10, hashes: int = 7, filters: bool = True, ids: Callable[[], str] = unique_ids, grace: float = 0.0):
        self.spark, self.folder, self.ids, self.grace = spark, folder.rstrip("/"), ids, grace
        self.bits_per_key, self.hashes, self.filters = bits_per_key, hashes, filters
        self.files = Files(spark)
        for part in ("manifest", "runs", "filters"):
            self.files.make(f"{self.folder}/{part}")
        self._manifest: Manifest | None = None
        self._block = lru_cache(KEPT_BLOCKS)(self._read_block)

    def manifest(self) -> Manifest:
        """The newest; kept until the next commit or refresh."""
        if self._manifest is None:
            names = [n for n in self.files.names(f"{self.folder}/manifest") if n.endswith(".json") and not n.startswith(".")]
            if not names:
                self._manifest = Manifest()
            else:
                try:
                    raw = json.loads(self.files.read(f"{self.folder}/manifest/{names[-1]}"))
                    self._manifest = Manifest(raw["version"], raw["sequence"], raw["run_no"], tuple(Run(**r) for r in raw["runs"]), raw["applied"], raw["retired"])
                except (ValueError, KeyError, TypeError) as e:
                    raise CorruptManifestError(f"{names[-1]}: {e}") from e
        return self._manifest

    def refresh(self) -> None:
        self._manifest = None

    def path(self, run_id: str) -> str:
        return f"{self.folder}/runs/{run_id}"

    # -- where entries are kept; another store may keep them elsewhere

    def _save(self, ordered: DataFrame, run_id: str, options: dict[str, str]) -> None:
        ordered.write.mode("errorifexists").options(**options).parquet(self.path(run_id))

    def _load(self, run_id: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self.path(run_id))

    def _forget(self, run_id: str) -> None:
        self.files.delete(self.path(run_id))

    def _there(self) -> list[tuple[str, float]]:
        """All runs that are kept, with their ages in seconds."""
        return [(n, self.files.age(self.path(n))) for n in self.files.names(f"{self.folder}/runs")]

    # -- writing

    def write(self, entries: DataFrame, level: int, expected: int, size: int = 0, run_id: str | None = None) -> Run | None:
        """A run of entries, one for each key; null if there are none.  It is seen once a commit adds it.

        ``expected``, ``size``: at most so many entries and bytes.  The entries are dealt out by ranges of keys, as many as files are needed, after whatever
        made them has run in as many tasks as it likes.  Sorted ranges let row groups be told apart by their smallest and largest keys; filters tell the rest.
        """
        run_id = run_id or self.ids()
        parts = max(1, math.ceil((size + expected * ENTRY_BYTES) / FILE_BYTES))
        ordered = entries.select("key", "value", "sequence").repartitionByRange(parts, "key").sortWithinPartitions("key")
        self._save(ordered, run_id, writer_options(expected) if self.filters else {})
        written = self._load(run_id)
        found = run_metadata(written).first()
        if not found["count"]:
            self._forget(run_id)
            return None
        run = Run(run_id, level, 0, found["count"], found["min_key"], found["max_key"], found["max_sequence"], size)
        if self.filters:
            run = Run(**(asdict(run) | {"filter_bits": filter_size(run.count, self.bits_per_key), "filter_hashes": self.hashes}))
            self._write_filter(written, run)
        return run

    def _write_filter(self, entries: DataFrame, run: Run) -> None:
        """Blocks one after the other in a file, so that a read fetches the one it needs; the driver holds a partition of them at a time."""
        out, at = self.files.stream(self._filter_path(run.run_id)), 0
        try:
            for r in filter_blocks(entries, run.filter_bits, run.filter_hashes).sort("block").toLocalIterator():
                out.write(bytearray((r["block"] - at) * BLOCK_BYTES) + bytearray(r["bits"]))
                at = r["block"] + 1
            out.write(bytearray((-(-run.filter_bits // (8 * BLOCK_BYTES)) - at) * BLOCK_BYTES))
            out.hflush()
        finally:
            out.close()

    def _filter_path(self, run_id: str) -> str:
        return f"{self.folder}/filters/{run_id}.bits"

    def write_some(self, entries: DataFrame, level: int, expected: int, size: int = 0, run_id: str | None = None) -> Run:
        run = self.write(entries, level, expected, size, run_id)
        if run is None:
            raise EmptyRunError("a run needs an entry")
        return run

    def has_applied(self, once: str) -> bool:
        """Whether a batch, or a later one of its name, was committed."""
        name, number = batch_of(once)
        return self.manifest().applied.get(name, -1) >= number

    def commit(self, add: Iterable[Run] = (), remove: Iterable[str] = (), sequence: int = 0, once: str | None = None) -> None:
        """One step from the manifest known here to the next.  A run added later is newer; removed ones are retired.

        ``once``: a batch that must not have been committed yet; if it has, nothing happens.
        """
        old, gone = self.manifest(), set(remove)
        if once and self.has_applied(once):
            return
        if missing := gone - {r.run_id for r in old.runs}:
            raise RunNotFoundError(f"not in the manifest: {', '.join(sorted(missing))}")
        no, runs = old.run_no, [r for r in old.runs if r.run_id not in gone]
        for r in add:
            no += 1
            runs.append(Run(**(asdict(r) | {"run_no": no})))
        applied = old.applied | dict([batch_of(once)] if once else [])
        self._publish(Manifest(old.version + 1, max([old.sequence, sequence, *(r.max_sequence for r in runs)]), no, tuple(runs), applied, old.retired | dict.fromkeys(gone, time.time())))

    def _publish(self, new: Manifest) -> None:
        if not self.files.publish(f"{self.folder}/manifest/{new.version:012d}.json", json.dumps(asdict(new)).encode()):
            self.refresh()
            raise ConflictError(f"version {new.version} was published by another writer")
        self._manifest = new

    def levels(self) -> dict[int, list[Run]]:
        """Shallowest level first, newest run first in each."""
        out: dict[int, list[Run]] = {}
        for r in sorted(self.manifest().runs, key=lambda r: (r.level, -r.run_no)):
            out.setdefault(r.level, []).append(r)
        return out

    def level(self, level: int) -> list[Run]:
        return self.levels().get(level, [])

    def count(self) -> int:
        return len(self.manifest().runs)

    def highest_sequence(self) -> int:
        return self.manifest().sequence

    def table(self) -> DataFrame:
        """The manifest as a DataFrame, in the order of reading."""
        rows = [(r.run_id, r.level, r.run_no, r.count, r.min_key, r.max_key, r.max_sequence) for runs in self.levels().values() for r in runs]
        return self.spark.createDataFrame(rows, RUN)

    def _read_block(self, run_id: str, block: int) -> bytes:
        """A block of a run's filter; one that isn't there denies nothing."""
        found = self.files.read_at(self._filter_path(run_id), block * BLOCK_BYTES, BLOCK_BYTES)
        return b"\xff" * BLOCK_BYTES if found is None else found

    def filter_of(self, run: Run) -> BloomFilter | NullFilter:
        """Reads a block when it is first asked for."""
        return BloomFilter(lambda block: self._block(run.run_id, block), run.filter_bits, run.filter_hashes) if run.filter_bits else NullFilter()

    def read(self, runs: Iterable[Run]) -> DataFrame:
        """All entries of the runs with run_id; filters on key reach the row groups of each."""
        parts = [self._load(r.run_id).withColumn("run_id", F.lit(r.run_id)) for r in runs]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ENTRY).withColumn("run_id", F.lit(""))

    # -- removing

    def orphans(self) -> list[str]:
        """Runs that no manifest names, for the grace period at least: since they were retired, or since they were written."""
        m, now = self.manifest(), time.time()
        known = {r.run_id for r in m.runs}
        return [n for n, age in self._there() if n not in known and (now - m.retired[n] if n in m.retired else age) >= self.grace]

    def prune(self) -> int:
        """Remove orphans, and the manifests before this one that are as old; returns how many runs went.  Only below ``runs`` and ``manifest``."""
        self.refresh()
        gone = self.orphans()
        for run_id in gone:
            self._forget(run_id)
            self.files.delete(self._filter_path(run_id))
        m = self.manifest()
        if left := {n for n in gone if n in m.retired}:
            self._publish(Manifest(m.version + 1, m.sequence, m.run_no, m.runs, m.applied, {n: t for n, t in m.retired.items() if n not in left}))
        folder = f"{self.folder}/manifest"
        for name in self.files.names(folder)[:-1]:
            if self.files.age(f"{folder}/{name}") >= max(self.grace, 60.0):
                self.files.delete(f"{folder}/{name}")
        return len(gone)


class CatalogRunStore(FileRunStore):
    """Runs as tables of the session's catalog, in whatever warehouse or metastore that is; manifest and filters stay under the folder."""

    def __init__(self, spark: SparkSession, folder: str, name: str, database: str | None = None, **options):
        super().__init__(spark, folder, **options)
        self.prefix = (f"{database}." if database else "") + f"tidelog_{name}_"

    def _table(self, run_id: str) -> str:
        return self.prefix + run_id.replace("-", "_").lower()

    def _save(self, ordered: DataFrame, run_id: str, options: dict[str, str]) -> None:
        self.files.make(self.path(run_id))  # a folder that says that the table is there, and since when
        ordered.write.mode("errorifexists").options(**options).format("parquet").saveAsTable(self._table(run_id))

    def _load(self, run_id: str) -> DataFrame:
        return self.spark.table(self._table(run_id)).select("key", "value", "sequence")

    def _forget(self, run_id: str) -> None:
        self.spark.sql(f"drop table if exists {self._table(run_id)}")
        super()._forget(run_id)


def memory_runs(spark: SparkSession, **options) -> FileRunStore:
    """A run store that lasts as long as this process, in the folder that the cluster shares, or a local one where there is none."""
    import atexit
    import tempfile

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}"
    store = FileRunStore(spark, f"{shared.rstrip('/')}/tidelog-memory-{uuid.uuid4().hex}", **options)

    def remove() -> None:
        try:
            store.files.delete(store.folder)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    atexit.register(remove)
    return store
