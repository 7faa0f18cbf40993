"""The seams of the engine: whatever has these methods can take a part's place."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import AbstractContextManager
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame

Entry = tuple[str, str | None, int]


class KeyValueStore(Protocol):
    """What applications use."""

    def put(self, key: str, value: str) -> None: ...
    def delete(self, key: str) -> None: ...
    def get(self, key: str) -> str | None: ...
    def get_or_fail(self, key: str) -> str: ...
    def has(self, key: str) -> bool: ...


class Maintenance(Protocol):
    """What operators use."""

    def flush(self) -> Any: ...
    def compact(self) -> int: ...
    def recover(self) -> int: ...
    def statistics(self) -> Any: ...


class RunStore(Protocol):
    """Immutable runs under a manifest; a commit adds and removes at once."""

    def write(self, entries: DataFrame, level: int, expected: int, size: int = 0, run_id: str | None = None) -> Any: ...
    def has_applied(self, once: str) -> bool: ...
    def commit(self, add: Iterable[Any], remove: Iterable[str], sequence: int, once: str | None) -> None: ...
    def levels(self) -> dict[int, list[Any]]: ...
    def level(self, level: int) -> list[Any]: ...
    def count(self) -> int: ...
    def read(self, runs: Iterable[Any]) -> DataFrame: ...
    def highest_sequence(self) -> int: ...
    def prune(self) -> int: ...
    def refresh(self) -> None: ...


class Buffer(Protocol):
    """Newest entries, one for each key."""

    def put(self, entry: Entry) -> None: ...
    def get(self, key: str) -> Entry | None: ...
    def is_full(self) -> bool: ...
    def entries(self) -> list[Entry]: ...
    def clear(self) -> None: ...
    def __len__(self) -> int: ...


class Wal(Protocol):
    """A log of entries in the order of their arrival; ``drop`` forgets what was there when ``rotate`` was called."""

    def append(self, entry: Entry) -> None: ...
    def replay(self) -> Iterable[Entry]: ...
    def rotate(self) -> Any: ...
    def drop(self, sealed: Any) -> None: ...
    def truncate(self) -> None: ...
    def count(self) -> int: ...


class KeyFilter(Protocol):
    """Never denies a key that was added."""

    def might_contain(self, key: str) -> bool: ...


class SequenceGenerator(Protocol):
    def next(self) -> int: ...
    def current(self) -> int: ...
    def advance_to(self, sequence: int) -> None: ...


class Lock(Protocol):
    def hold(self) -> AbstractContextManager[None]: ...


class OperationSource(Protocol):
    """Operations as a table (pos, op, key, value)."""

    def operations(self) -> DataFrame: ...
    def describe(self) -> str: ...


CompactionPolicy = Callable[[dict[int, list[Any]]], Any]
OperationParser = Callable[[Column], Column]
RunIdGenerator = Callable[[], str]
