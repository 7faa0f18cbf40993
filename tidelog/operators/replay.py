"""Workloads of puts, deletes and gets in one order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.ranges import place
from tidelog.schema import DELETE, GET, PUT


def mutations(ops: DataFrame) -> DataFrame:
    """The puts and deletes; a delete's value is null.  Gets take no sequence number."""
    return ops.where(F.col("op") != GET).withColumn("value", F.when(F.col("op") == PUT, F.col("value")))


def ranges_of(rows: DataFrame, by: str) -> list:
    """Quantiles of a number that cut rows into as many ranges as there are shuffle partitions."""
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sorted(set(rows.agg(F.percentile_approx(by, [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] or []))


def sequenced(rows: DataFrame, by: str, base: int | Callable[[int], int] = 0) -> DataFrame:
    """With ``sequence`` counting from base + 1 without gaps in the order of ``by``; ``base`` may be worked out from the number of rows.

    A row_number over everything would put all rows in one task.  Here ranges between quantiles of ``by`` are numbered apart, and each begins
    where those before it end; only the ranges' sizes come together.  Both passes place a row by its values alone, and ties are
    ordered by the other columns, so whatever is run again after a loss gets the same number.
    """
    spark, bounds = rows.sparkSession, ranges_of(rows, by)
    dealt = rows.withColumn("_range", place(F.col(by), bounds))
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())  # a row for each range
    starts, at = [], base(sum(n for _, n in sizes)) if callable(base) else base
    for value, size in sizes:
        starts.append((value, at))
        at += size
    table = spark.createDataFrame(starts, "_range int, _start long")
    ties = [c for c in rows.columns if c != by]
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by, *ties))
    numbered = dealt.withColumn("_at", inside).join(F.broadcast(table), "_range")
    return numbered.withColumn("sequence", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def asof_reads(ops: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(pos, key, value) of every get: the value that the mutations before it leave, else that of ``base`` (key, value).

    A tombstone is an answer.  What a get looks for is the position of the last mutation before it; values are joined afterwards, to the gets
    that found one.  Positions are cut into ranges, and the window runs inside a key's range only: the last mutation of each range, one row for each key and range, is
    carried forward to the next ones.  So a key with very many operations is spread over as many tasks as there are ranges.
    """
    mutation = F.when(F.col("op") != GET, F.col("pos"))
    cut = ops.select("pos", "op", "key").withColumn("_range", place(F.col("pos"), ranges_of(ops, "pos")))
    here = F.max(mutation).over(Window.partitionBy("key", "_range").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.max("_last").over(Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = cut.groupBy("key", "_range").agg(F.max(mutation).alias("_last")).select("key", "_range", earlier.alias("_before"))
    gets = cut.withColumn("_here", here).where(F.col("op") == GET).join(carried, ["key", "_range"]).select("pos", "key", F.coalesce("_here", "_before").alias("last"))
    done = mutations(ops).select(F.col("pos").alias("last"), F.col("value"))
    answered = gets.where("last is not null").join(done, "last", "left").select("pos", "key", "value")
    unanswered = gets.where("last is null").select("pos", "key")
    if base is None:
        return answered.unionByName(unanswered.withColumn("value", F.lit(None).cast("string")))
    return answered.unionByName(unanswered.join(base.select("key", "value"), "key", "left"))


def reads_map(reads: DataFrame) -> DataFrame:
    """(key, value): the last read of each key."""
    return reads.groupBy("key").agg(F.max_by("value", "pos").alias("value"))


def summary(ops: DataFrame) -> DataFrame:
    """One row: puts, deletes, gets, total."""
    count = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"{op}s")
    return ops.agg(count(PUT), count(DELETE), count(GET), F.count("*").alias("total"))
