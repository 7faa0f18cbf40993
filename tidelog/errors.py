"""Everything that the engine raises is a StoreError."""

from __future__ import annotations


class StoreError(Exception):
    """The root of the engine's errors."""


class InvalidKeyError(StoreError, ValueError):
    """A key is empty."""


class KeyNotFoundError(StoreError, KeyError):
    """A key that must be there isn't."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class MalformedOperationError(StoreError, ValueError):
    """A line or an operation can't be understood."""

    @classmethod
    def at_line(cls, label: str, line: int, reason: str) -> MalformedOperationError:
        return cls(f"{label} line {line}: {reason}")


class EmptyRunError(StoreError, ValueError):
    """A run would have no entries."""


class InvalidConfigurationError(StoreError, ValueError):
    """A setting is out of its range."""


class RunNotFoundError(StoreError, LookupError):
    """A run to be replaced isn't in the manifest."""


class LockTimeoutError(StoreError, TimeoutError):
    """Another maintenance held the lock for too long."""


class ConflictError(StoreError):
    """Another writer published a manifest first."""


class CorruptManifestError(StoreError):
    """A published manifest can't be read; it is not taken for an empty store."""


class CorruptLogError(StoreError):
    """A line inside a log can't be read; it is not taken for the torn end that a crash leaves."""


class UnreadableSourceError(StoreError, OSError):
    """A source of operations is missing or can't be read."""


class StoreNotConfiguredError(StoreError, LookupError):
    """No store has that name."""


class UnsupportedDriverError(StoreError, LookupError):
    """No driver has that name."""
