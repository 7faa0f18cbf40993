"""Named stores and the drivers that they are made of."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession

from tidelog.config import DEFAULT_STORES, StoreConfig
from tidelog.engine import Engine
from tidelog.errors import StoreNotConfiguredError, UnsupportedDriverError
from tidelog.locks import FileLock, NullLock
from tidelog.plans.compaction import SizeTieredPolicy, never
from tidelog.sources.files import Files
from tidelog.sources.runs import CatalogRunStore, FileRunStore, memory_runs
from tidelog.sources.wal import FileWal, MemoryWal, NullWal
from tidelog.trace import Listener, silent

Factory = Callable[[SparkSession, StoreConfig], Any]


def _run_options(c: StoreConfig) -> dict[str, Any]:
    return {"bits_per_key": c.bits_per_key, "hashes": c.hashes, "filters": c.filter != "null", "grace": c.prune_grace}


def _folder(c: StoreConfig) -> str:
    """Runs, log and lock of a store lie below its root, so another host finds them and no two roots share any."""
    return f"{c.root}/{c.name}"


class StoreRegistry:
    """Stores by name, made when first asked for."""

    def __init__(self, spark: SparkSession, root: str, stores: Mapping[str, Mapping[str, Any]] | None = None, default: str = "primary", listener: Callable[[str], Listener] | None = None):
        self.spark, self.root, self._default, self._listener = spark, root.rstrip("/"), default, listener
        self.settings: dict[str, dict[str, Any]] = {k: dict(v) for k, v in (DEFAULT_STORES if stores is None else stores).items()}
        self._open: dict[str, Engine] = {}
        self._logs: dict[str, MemoryWal] = {}
        self.run_drivers: dict[str, Factory] = {"file": lambda s, c: FileRunStore(s, _folder(c), **_run_options(c)), "catalog": lambda s, c: CatalogRunStore(s, _folder(c), c.name, c.options.get("database"), **_run_options(c)), "memory": lambda s, c: memory_runs(s, **_run_options(c))}
        self.wal_drivers: dict[str, Factory] = {"file": lambda s, c: FileWal(Files(s), f"{_folder(c)}/wal", c.sync_wal), "memory": lambda s, c: self._logs.setdefault(c.name, MemoryWal()), "null": lambda s, c: NullWal()}
        self.policies: dict[str, Factory] = {"size_tiered": lambda s, c: SizeTieredPolicy(c.max_runs_per_level, c.bottom_level), "null": lambda s, c: never}
        self.locks: dict[str, Factory] = {"file": lambda s, c: FileLock(Files(s), f"{_folder(c)}/lock/maintenance", c.lock_wait), "null": lambda s, c: NullLock()}

    def extend_runs(self, name: str, factory: Factory) -> None:
        """A driver of runs; one of a known name takes its place."""
        self.run_drivers[name] = factory

    def extend_wal(self, name: str, factory: Factory) -> None:
        self.wal_drivers[name] = factory

    def default_store(self) -> str:
        return self._default

    def set_default_store(self, name: str) -> None:
        self._default = name

    def stores(self) -> list[str]:
        return list(self.settings)

    def resolved_stores(self) -> list[str]:
        return list(self._open)

    def configure(self, name: str, settings: Mapping[str, Any]) -> None:
        self.settings[name] = dict(settings)
        self.purge(name)

    def config(self, name: str) -> StoreConfig:
        if name not in self.settings:
            raise StoreNotConfiguredError(f"no store is named {name}; there are {', '.join(self.settings) or 'none'}")
        return StoreConfig.of(name, {"root": self.root, **self.settings[name]})

    def store(self, name: str | None = None) -> Engine:
        """The engine of a store, the same one each time."""
        name = name or self._default
        if name not in self._open:
            c = self.config(name)

            def made(drivers: dict[str, Factory], wanted: str, what: str) -> Any:
                if wanted not in drivers:
                    raise UnsupportedDriverError(f"no {what} driver is named {wanted}")
                return drivers[wanted](self.spark, c)

            if c.filter not in ("bloom", "null"):
                raise UnsupportedDriverError(f"no filter is named {c.filter}")
            parts = [made(self.run_drivers, c.runs, "run"), made(self.wal_drivers, c.wal, "log"), made(self.policies, c.policy, "policy"), made(self.locks, c.lock, "lock")]
            self._open[name] = Engine(self.spark, c, *parts, listener=self._listener(name) if self._listener else silent)
        return self._open[name]

    def purge(self, name: str | None = None) -> None:
        """Forget open engines; the next use makes them anew."""
        for n in [name] if name else list(self._open):
            if n in self._open:
                self._open.pop(n).close()

    def __getattr__(self, attribute: str) -> Any:
        """Everything else is the default store's."""
        if attribute.startswith("_") or attribute in ("settings", "run_drivers"):
            raise AttributeError(attribute)
        return getattr(self.store(), attribute)
