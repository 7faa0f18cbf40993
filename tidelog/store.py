"""Module-level functions over one registry, for scripts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from tidelog.engine import Engine
from tidelog.registry import StoreRegistry

_registry: StoreRegistry | None = None


def use(spark: SparkSession, root: str, **options: Any) -> StoreRegistry:
    """Set the registry that the functions here use."""
    global _registry
    _registry = StoreRegistry(spark, root, **options)
    return _registry


def registry() -> StoreRegistry:
    if _registry is None:
        raise RuntimeError("call use() first")
    return _registry


def store(name: str | None = None) -> Engine:
    return registry().store(name)


def put(key: str, value: str) -> None:
    store().put(key, value)


def delete(key: str) -> None:
    store().delete(key)


def get(key: str) -> str | None:
    return store().get(key)


def get_or_fail(key: str) -> str:
    return store().get_or_fail(key)


def has(key: str) -> bool:
    return store().has(key)
