"""Background maintenance: one at a time for each store."""

from __future__ import annotations

import threading
from concurrent.futures import Future, ThreadPoolExecutor

from tidelog.registry import StoreRegistry


class CompactionJobs:
    """Flush and compact in the background; while a store's job waits or runs, another for it is the same job."""

    def __init__(self, registry: StoreRegistry, workers: int = 2):
        self.registry, self.pool = registry, ThreadPoolExecutor(workers)
        self._pending: dict[str, Future] = {}
        self._guard = threading.Lock()

    def submit(self, store: str | None = None) -> Future:
        name = store or self.registry.default_store()
        with self._guard:
            if name not in self._pending or self._pending[name].done():
                self._pending[name] = self.pool.submit(self._run, name)
            return self._pending[name]

    def _run(self, name: str) -> int:
        engine = self.registry.store(name)
        engine.flush()
        return engine.compact()
