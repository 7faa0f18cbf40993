"""Memory of executors: their Python workers and their JVMs, which outlive tasks, stages and operators.

An operator's caches serve its next tasks in the same worker; they go when a task of another operator begins.  What a task has freed is given back
to the system at its end, or one stage's peak would stand below the next one's.  A JVM keeps the heap that its peak took until it collects all of it,
which may never come; so the pipeline has that done before each stage, and its longest stage before each of its rounds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_HELD: dict[str, Callable[[], None]] = {}
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except AttributeError:  # another C library than GNU's
    _TRIM = None


def hold(owner: str, forget: Callable[[], None]) -> None:
    """This process has a cache of ``owner``; ``forget`` empties it."""
    _HELD[owner] = forget


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def collect_heaps(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their heaps, which then shrink: a task for each executor, which Spark deals out in turn where all are free.

    Nothing depends on it but memory: an executor that gets no task keeps its heap as it was.
    """
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is one of them
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def _claim(owner: str) -> None:
    if others := [n for n in _HELD if n != owner]:
        for n in others:
            _HELD.pop(n)()
        give_back()


def tidy(each: Callable, owner: str = "") -> Callable:
    """A task's function from batches to batches, which leaves no memory behind but its owner's caches."""

    @wraps(each)
    def run(batches: Iterator) -> Iterator:
        _claim(owner)
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


def tidy_group(each: Callable, owner: str = "") -> Callable:
    """The same for a function of one group or of two groups together."""

    def run(*groups):
        _claim(owner)
        try:
            return each(*groups)
        finally:
            give_back()

    if each.__code__.co_argcount == 2:
        return lambda left, right: run(left, right)
    return lambda group: run(group)
