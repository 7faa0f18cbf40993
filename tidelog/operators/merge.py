"""Latest-wins merges of versioned entries."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked_union(runs: Iterable[DataFrame]) -> DataFrame:
    """All entries of runs given newest first, with the run's place as run_rank."""
    parts = [r.select("key", "value", "sequence").withColumn("run_rank", F.lit(i)) for i, r in enumerate(runs)]
    if not parts:
        raise ValueError("nothing to merge")
    return reduce(DataFrame.unionByName, parts)


def latest_wins(entries: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """One entry for each key: the highest sequence; of equal ones the smallest run_rank, where there is that column.

    A partial aggregation reduces before the one shuffle, so a key with very many versions is no hot spot.  Tombstones
    are dropped after the winner is known, or older versions would come back.
    """
    order = [F.col("sequence")] + ([-F.col("run_rank")] if "run_rank" in entries.columns else [])
    winner = entries.groupBy("key").agg(F.max_by(F.struct("value", "sequence"), F.struct(*order)).alias("w")).select("key", "w.value", "w.sequence")
    return winner.where("value is not null") if drop_tombstones else winner


def merge_runs(runs: Iterable[DataFrame], drop_tombstones: bool = False) -> DataFrame:
    """The k-way merge of runs given newest first.  Lazy, as all DataFrames."""
    return latest_wins(ranked_union(runs), drop_tombstones)


def newest(mutations: DataFrame) -> DataFrame:
    """The last to arrive for each key, of mutations (pos, key, value, ...).  Of two with one position the larger value counts, so a rerun decides alike."""
    rest = [c for c in mutations.columns if c != "key"]
    order = F.struct("pos", *[c for c in rest if c not in ("pos", "value")], F.col("value").isNotNull(), "value")
    return mutations.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("w")).select("key", *[f"w.{c}" for c in rest])


def buffered(mutations: DataFrame) -> DataFrame:
    """What a buffer holds after mutations: the newest of each key, in key order."""
    return newest(mutations).sort("key")


def run_metadata(entries: DataFrame, *by: str) -> DataFrame:
    """count, min_key, max_key and max_sequence of entries, for each value of ``by``."""
    return entries.groupBy(*by).agg(F.count("*").alias("count"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("sequence").alias("max_sequence"))
