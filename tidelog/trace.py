"""What the engine tells those who listen."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class TraceType(str, Enum):
    """The kinds of events."""

    WRITE = "write"
    FLUSH = "flush"
    COMPACTION = "compaction"
    READ_HIT = "read.hit"
    READ_MISS = "read.miss"
    READ_FILTER_SKIP = "read.filter-skip"
    READ_FALSE_POSITIVE = "read.false-positive"


@dataclass(frozen=True)
class TraceEvent:
    type: TraceType
    message: str
    context: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def write(cls, key: str, sequence: int, tombstone: bool) -> TraceEvent:
        return cls(TraceType.WRITE, f"{'deleted' if tombstone else 'wrote'} {key} as {sequence}", {"key": key, "sequence": sequence, "tombstone": tombstone})

    @classmethod
    def flush(cls, run_id: str, entries: int) -> TraceEvent:
        return cls(TraceType.FLUSH, f"sealed {entries} entries as run {run_id}", {"run_id": run_id, "entries": entries})

    @classmethod
    def compaction(cls, inputs: list[str], output: str | None, level: int, dropped: bool) -> TraceEvent:
        return cls(TraceType.COMPACTION, f"merged {len(inputs)} runs into {output or 'nothing'} at level {level}", {"inputs": inputs, "output": output, "level": level, "tombstones_dropped": dropped})

    @classmethod
    def read(cls, kind: TraceType, key: str, run_id: str | None = None) -> TraceEvent:
        return cls(kind, f"{kind.value} {key}" + (f" in {run_id}" if run_id else ""), {"key": key, "run_id": run_id})


Listener = Callable[[TraceEvent], None]


def silent(event: TraceEvent) -> None:
    """Hears nothing."""


class Collecting:
    """Keeps events, of the given types only."""

    def __init__(self, *types: TraceType):
        self.types, self.events = set(types), []

    def __call__(self, event: TraceEvent) -> None:
        if not self.types or event.type in self.types:
            self.events.append(event)

    def count_of(self, kind: TraceType) -> int:
        return sum(e.type == kind for e in self.events)


def composite(*listeners: Listener) -> Listener:
    """Tells all of them, in order."""

    def tell(event: TraceEvent) -> None:
        for listener in listeners:
            listener(event)

    return tell


class Logging:
    """Writes events to a logger.  No types means all of them; names that are no type's are ignored."""

    def __init__(self, store: str, types: Iterable[str] = (), logger: logging.Logger | None = None, level: int = logging.INFO):
        wanted, known = list(types), {t.value: t for t in TraceType}
        self.all, self.types = not wanted, {known[t] for t in wanted if t in known}
        self.store, self.logger, self.level = store, logger or logging.getLogger("tidelog"), level

    def __call__(self, event: TraceEvent) -> None:
        if self.all or event.type in self.types:
            self.logger.log(self.level, "tidelog[%s] %s", self.store, event.message)


@dataclass(frozen=True)
class BufferSealed:
    """A buffer became a run."""

    store: str
    run_id: str
    entries: int


@dataclass(frozen=True)
class RunsMerged:
    """Runs became one; output is None if nothing was left."""

    store: str
    inputs: list[str]
    output: str | None
    level: int


def structural(store: str, publish: Callable[[BufferSealed | RunsMerged], None]) -> Listener:
    """Publishes flushes and compactions, and nothing else."""

    def tell(event: TraceEvent) -> None:
        if event.type == TraceType.FLUSH:
            publish(BufferSealed(store, event.context["run_id"], event.context["entries"]))
        elif event.type == TraceType.COMPACTION:
            publish(RunsMerged(store, event.context["inputs"], event.context["output"], event.context["level"]))

    return tell
