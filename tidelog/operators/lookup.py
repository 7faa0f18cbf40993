"""Reads of many keys at once, and what a read of them touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ranges import place


def get_many(view: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) of each distinct asked key; null where it is absent or deleted."""
    return keys.select("key").distinct().join(view.select("key", "value"), "key", "left")


def get_many_or_fail(view: DataFrame, keys: DataFrame) -> DataFrame:
    """As get_many; the job fails at the first key that isn't there.  An empty value is there."""
    found = get_many(view, keys)
    missing = F.raise_error(F.concat(F.lit("key not found: "), F.col("key")))
    return found.select("key", F.when(F.col("value").isNull(), missing).otherwise(F.col("value")).alias("value"))


def has_many(view: DataFrame, keys: DataFrame) -> DataFrame:
    """The asked keys that are live."""
    return keys.select("key").distinct().join(view.where("value is not null"), "key", "left_semi")


def consulted(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, runs): how many runs' key ranges hold each key: those that begin at or before it, less those that end before it.

    The runs' metadata, a row for each run as in the manifest, comes to the driver and goes out as two sorted lists of bounds: no join at all.
    """
    bounds = runs.select("min_key", "max_key").collect()
    first, last = (sorted((r[i] for r in bounds), key=str.encode) for i in (0, 1))
    return keys.select("key").distinct().select("key", (place(F.col("key"), first, inclusive=True) - place(F.col("key"), last)).cast("long").alias("runs"))
