"""Settings of a store."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from tidelog.errors import InvalidConfigurationError


@dataclass(frozen=True)
class StoreConfig:
    """What a store is made of.  Names of drivers are looked up in the registry."""

    name: str = "primary"
    root: str | None = None
    runs: str = "file"
    wal: str = "file"
    filter: str = "bloom"
    policy: str = "size_tiered"
    lock: str = "file"
    buffer_capacity: int = 1000
    max_runs_per_level: int = 4
    bottom_level: int = 2
    bits_per_key: int = 10
    hash_count: int | None = None
    recover_on_boot: bool = True
    sync_wal: bool = True
    lock_wait: float = 10.0
    #: Seconds that a run stays after it was merged, or was written without a commit: longer than any read or write takes.
    prune_grace: float = 6 * 3600.0
    options: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, least in (("buffer_capacity", 1), ("max_runs_per_level", 2), ("bottom_level", 1), ("bits_per_key", 1)):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < least:
                raise InvalidConfigurationError(f"{name} must be an integer of at least {least}")
        if self.hash_count is not None and not 1 <= self.hash_count <= 16:
            raise InvalidConfigurationError("hash_count must be from 1 to 16")
        if not self.name or "/" in self.name:
            raise InvalidConfigurationError("a store's name must not be empty or hold a slash")

    @property
    def hashes(self) -> int:
        """Given, or the best for the bits: bits times ln 2, from 1 to 16."""
        return self.hash_count or min(16, max(1, round(self.bits_per_key * math.log(2))))

    @classmethod
    def of(cls, name: str, settings: Mapping[str, Any]) -> StoreConfig:
        """From a mapping; unknown settings are an error."""
        known = {f.name for f in fields(cls)}
        if unknown := set(settings) - known:
            raise InvalidConfigurationError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{"name": name, **settings})


#: The stores that are there without any settings.
DEFAULT_STORES: dict[str, dict[str, Any]] = {
    "primary": {"buffer_capacity": 2000, "max_runs_per_level": 4, "bottom_level": 2, "bits_per_key": 10},
    "archive": {"buffer_capacity": 10000, "max_runs_per_level": 6, "bottom_level": 3, "bits_per_key": 12},
}
