"""Connected components of a table of links: by alternating large and small stars, or in one task where the links are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.memory import tidy
from tidelog.llm.shared import materialize, work_dir

#: Distinct links that one task joins up; more go through rounds of stars, each of which writes four tables.
FEW = 1 << 20


def join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Links between places of ``label``, which has each place's smallest so far, are put into it."""
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(label, b, a)
        while (label[label] != label).any():
            label[:] = label[label]


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links in one task to (a, b): a node that isn't the smallest of its component, and the smallest."""
    held = list(batches)
    if not held:
        return
    links = pa.Table.from_batches(held).combine_chunks()
    nodes = pc.unique(pa.chunked_array([*links["a"].chunks, *links["b"].chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))  # by value, as Spark orders numbers and bytes
    label = np.arange(len(nodes))
    join_up(label, pc.index_in(links["a"], nodes).to_numpy(), pc.index_in(links["b"], nodes).to_numpy())
    far = np.flatnonzero(label != np.arange(len(label)))
    yield from pa.table([nodes.take(pa.array(far)), nodes.take(pa.array(label[far]))], links.schema).to_batches(1 << 16)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(a, b) as decimal(20, 0))), 0)")).first())


def components(spark: SparkSession, edges: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b) links to (node, root): every linked node that isn't the smallest of its component, with the smallest it reaches.

    Up to ``few`` distinct links are joined up in one task.
    A node's smallest neighbour comes from an aggregation with partial sums and is joined back.  Both sides of that join are plain
    exchanges, as both are written first, so Spark splits the partition of a node with very many links.  Each round is a written table; the rounds needed grow with the logarithm of the longest path.
    """
    folder, n = work_dir(spark, "components"), 0
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialize(now, f"{folder}/0")
    state = _state(now)
    if state[0] <= few:
        now = materialize(now.coalesce(1).mapInArrow(tidy(_rooted), now.schema), f"{folder}/rooted")
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{folder}/least-{n}")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, f"{folder}/large-{n}")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{folder}/least-of-large-{n}")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", "m")).distinct()
        n += 1
        now = materialize(small, f"{folder}/{n}")
        was, state = state, _state(now)
        if was == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
