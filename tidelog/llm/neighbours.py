"""Approximate nearest neighbours by a forest of random-projection trees.

The largest inner product becomes the nearest point on a sphere by one more coordinate, which gives all rows the same
norm.  The trees are fitted on a bounded sample of distinct vectors: a node projects on the difference of two of its
vectors drawn at random and splits at the median.  Every row of the table is put into its leaf of every tree.  A query
goes down all trees through one priority queue, ordered by how far inside its half a node lies at worst, until it has
its number of leaves; the rows of those leaves are its candidates, scored exactly.

Rows with equal vectors are one point with its smallest ids: a result needs at most ``k`` of them and the query's own.
Neighbouring leaves share a bucket of bounded size, to which a query goes once with all its leaves there; a leaf with more
points than that is dealt into parts, and its queries visit every part.  Leaves get finer as the table grows, until the sample has two vectors in each.

Corner cases: vectors that are null, zero, of another length than most, or have null or non-finite components take
no part, nor do rows with a null id; of an id with several vectors as a query the smallest vector counts, as a candidate
the nearest; repeated rows are one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.memory import tidy, tidy_group
from tidelog.llm.shared import materialize, work_dir

#: Vectors that the forest is fitted on, at most: those with the smallest hashes.
SAMPLE = 16_384
#: Points of leaves that a task looks at together.
PART = 32_768
#: Places beside those wanted in a list of nearest points, for ties at its end.
SLACK = 8


@dataclass
class Forest:
    """Arrays over all nodes of all trees; a leaf's children are -1."""

    normals: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: list[int]
    norm: float

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """With the coordinate that makes all norms equal; queries lie in the plane where it is zero."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        lifted = self.lift(x)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while len(rows := np.flatnonzero(self.left[at] >= 0)):
                n = at[rows]
                side = np.einsum("ij,ij->i", lifted[rows], self.normals[n]) > self.offsets[n]
                at[rows] = np.where(side, self.right[n], self.left[n])
            out[:, t] = at
        return out

    def probe(self, x: np.ndarray, n: int, sizes: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """The n leaves that the shared queue reaches first, for each query; more if no tree's leaves among them have ``least`` points."""
        lifted, out = self.lift(x, query=True), []
        norms = np.linalg.norm(lifted, axis=1, keepdims=True)
        lifted = lifted / np.where(norms, norms, 1) * self.norm  # a query's own length doesn't change its order
        for margins in lifted @ self.normals.T - self.offsets:
            queue, found, points = [(-np.inf, r) for r in self.roots], [], [0] * len(self.roots)
            heapq.heapify(queue)
            while queue and (len(found) < n or max(points) < least):
                worst, node = heapq.heappop(queue)
                if self.left[node] < 0:
                    found.append(int(node))
                    if sizes is not None:
                        points[bisect(self.roots, node) - 1] += int(sizes[node])
                    continue
                m = float(margins[node])
                heapq.heappush(queue, (max(worst, -m), int(self.right[node])))
                heapq.heappush(queue, (max(worst, m), int(self.left[node])))
            out.append(found)
        return out


def grow(sample: np.ndarray, norm: float, trees: int, leaf: int, seed: int = 7) -> Forest:
    """A forest on the sample; ``leaf``: the most of its vectors that a leaf keeps."""
    rng = np.random.default_rng(seed)
    forest = Forest(np.zeros((0, 0)), np.zeros(0), np.zeros(0), np.zeros(0), [], norm)
    x = forest.lift(sample)
    normals, offsets, left, right = [], [], [], []

    def node(rows: np.ndarray) -> int:
        me = len(offsets)
        normals.append(np.zeros(x.shape[1]))
        offsets.append(0.0)
        left.append(-1)
        right.append(-1)
        if len(rows) > leaf:
            a, b = rng.choice(rows, 2, replace=False)
            direction = x[a] - x[b]
            if (length := np.linalg.norm(direction)) > 0:
                normals[me] = direction / length
                along = x[rows] @ normals[me]
                offsets[me] = float(np.median(along))
                high = along > offsets[me]
                if high.any() and not high.all():
                    left[me], right[me] = node(rows[~high]), node(rows[high])
        return me

    forest.roots = [node(np.arange(len(x))) for _ in range(trees)]
    forest.normals, forest.offsets = np.array(normals).reshape(len(offsets), x.shape[1]), np.array(offsets)
    forest.left, forest.right = np.array(left, np.int64), np.array(right, np.int64)
    return forest


def enough_probes(forest: Forest, sample: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """The fewest leaves per query with which queries from the sample find ``recall`` of their k nearest in it.

    The table's rows lie closer to a query than the sample's, so that many leaves find no smaller a share of them.
    """
    asked = np.random.default_rng(11).choice(len(sample), min(queries, len(sample)), replace=False)
    leaves, total = forest.leaves(sample), int((forest.left < 0).sum())
    needed = []
    for at in range(0, len(asked), 50):
        some = asked[at : at + 50]
        near = sample[some] @ sample.T
        near[np.arange(len(some)), some] = -np.inf
        order = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        for best, visited in zip(order, forest.probe(sample[some], total)):
            turn = np.full(len(forest.left), total)
            turn[visited] = np.arange(len(visited))
            needed.append(turn[leaves[best]].min(axis=1))
    found = np.sort(np.concatenate(needed)) if needed else np.zeros(0, int)
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1 if len(found) else 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v has doubles."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v is not null")
    limit = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _packed(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(float)


def dealt(counts: dict[int, int], n: int, roots: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """The first bucket of each leaf and the number of its buckets: neighbouring leaves of a tree share one up to PART points, a leaf with more has several to itself."""
    first, parts, bucket, held = np.zeros(n, np.int64), np.ones(n, np.int64), 0, 0
    for leaf in range(n):
        size = counts.get(leaf, 0)
        if leaf in roots:
            bucket, held = bucket + (held > 0), 0
        if size > PART:
            bucket += held > 0
            first[leaf], parts[leaf], held = bucket, -(-size // PART), 0
            bucket += int(parts[leaf])
            continue
        if held + size > PART:
            bucket, held = bucket + 1, 0
        first[leaf], held = bucket, held + size
    return first, parts


def points(rows: DataFrame, k: int, kind: str) -> DataFrame:
    """(rep, ids, v) of distinct vectors: v packed as numbers of this kind, ids the k + 1 smallest, rep the smallest of all."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))  # limited in each task before the shuffle
    few = rows.distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    grouped = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([np.asarray(x, kind).tobytes() for x in b.column(2).to_pylist()], pa.binary())], names=["rep", "ids", "v"])

    return grouped.mapInArrow(tidy(pack), "rep long, ids array<long>, v binary")


def nearest(spark: SparkSession, vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 8, leaf: int = 128, recall: float = 0.94, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id is divisible by ``every``, the k nearest other rows found."""
    folder = work_dir(spark, "neighbours")
    rows = usable(vectors)
    kind = "<f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "<f8"  # what the vectors have, without loss
    found = materialize(points(rows, k, kind), f"{folder}/points")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    fitted = found.orderBy(F.xxhash64("v"), "rep").limit(sample).select("v").collect()  # no more than the sample
    out = "query_id long, rank int, vec_id long, score double"
    if not fitted:
        return spark.createDataFrame([], out)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.record_batch([pa.array([float(np.sqrt((_packed(b.column(0), kind) ** 2).sum(1)).max())]), pa.array([len(b)])], names=["n", "rows"])

    size = found.select("v").mapInArrow(tidy(norms), "n double, rows long").agg(F.max("n").alias("n"), F.sum("rows").alias("rows")).first()
    drawn = np.frombuffer(b"".join(r["v"] for r in fitted), kind).reshape(len(fitted), -1).astype(float)
    # leaves are as fine in the sample as it takes for a leaf's share of the table to be ``leaf``: they grow in number with the table, as far as the sample goes
    grown = grow(drawn, size["n"], trees, max(2, -(-leaf * len(drawn) // size["rows"])))
    probes = enough_probes(grown, drawn, k, recall)
    forest = spark.sparkContext.broadcast(grown)  # as large as the sample and the number of trees make it

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                b = batch.slice(at, 2048)
                if len(b):
                    leaves = forest.value.leaves(_packed(b.column(1), kind))
                    take = np.repeat(np.arange(len(b)), leaves.shape[1])
                    yield pa.record_batch([pa.array(leaves.ravel()), *(c.take(pa.array(take)) for c in b.columns)], names=["leaf", "rep", "v"])

    indexed = found.select("rep", "v").mapInArrow(tidy(index), "leaf int, rep long, v binary")
    counts = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a row for each leaf, of which the sample allows so many
    first, parts = dealt(counts, len(grown.left), set(grown.roots))
    places = spark.sparkContext.broadcast((first, parts, np.array([counts.get(i, 0) for i in range(len(grown.left))])))
    several = [(leaf, int(first[leaf]), int(parts[leaf])) for leaf in sorted(counts)]
    members = indexed.join(F.broadcast(spark.createDataFrame(several, "leaf int, first int, parts int")), "leaf")
    members = members.select((F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int").alias("bucket"), "leaf", "rep", "v")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, sizes = places.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                b, rows = batch.slice(at, 512), []
                if not len(b):
                    continue
                x = np.array(b.column(1).to_pylist(), float)
                for query_id, q, probed in zip(b.column(0).to_pylist(), x.astype(kind), forest.value.probe(x, probes, sizes, k + 1)):
                    leaves = np.repeat(np.array(probed), parts[probed])
                    step = np.arange(len(leaves)) - np.repeat(np.cumsum(parts[probed]) - parts[probed], parts[probed])
                    bucket = first[leaves] + step
                    order = np.argsort(bucket, kind="stable")
                    for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                        rows.append((int(bucket[some[0]]), query_id, q.tobytes(), leaves[some].astype("<i4").tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "query_id", "q", "leaves"])

    asked = asked.repartition(spark.sparkContext.defaultParallelism)  # few rows, each of which takes long
    queries = asked.mapInArrow(tidy(ask), "bucket int, query_id long, q binary, leaves binary")

    def score(group: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(points):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "rep": pd.Series([], dtype="int64"), "score": pd.Series([], dtype=float)})
        points = points.sort_values(["leaf", "rep"])
        leaves, at = np.unique(points["leaf"].to_numpy(), return_index=True)
        at = np.append(at, len(points))
        v, rep = np.frombuffer(b"".join(points["v"]), kind).reshape(len(points), -1).astype(float), points["rep"].to_numpy()
        q = np.frombuffer(b"".join(group["q"]), kind).reshape(len(group), -1).astype(float)
        asked_for = [np.frombuffer(x, "<i4") for x in group["leaves"]]
        who, what = np.repeat(np.arange(len(group)), [len(x) for x in asked_for]), np.concatenate(asked_for)
        order = np.argsort(what, kind="stable")
        who, bounds = who[order], np.searchsorted(what[order], np.append(leaves, leaves[-1] + 1))
        # each query's best so far, a few more than wanted: no point is here twice, as a bucket's leaves are of one tree
        room = k + 1 + SLACK
        best, mine = np.full((len(q), room), -np.inf), np.zeros((len(q), room), np.int64)
        for i in range(len(leaves)):
            some, leaf = who[bounds[i] : bounds[i + 1]], slice(at[i], at[i + 1])
            for part in np.array_split(some, -(-len(some) // 512)) if len(some) else []:
                near = np.concatenate([best[part], q[part] @ v[leaf].T], axis=1)
                place = np.concatenate([mine[part], np.broadcast_to(np.arange(leaf.start, leaf.stop), (len(part), leaf.stop - leaf.start))], axis=1)
                top = np.argpartition(near, near.shape[1] - room, axis=1)[:, -room:]
                best[part], mine[part] = np.take_along_axis(near, top, 1), np.take_along_axis(place, top, 1)
        order = np.argsort(-best, axis=1)
        best, mine = np.take_along_axis(best, order, 1), np.take_along_axis(mine, order, 1)
        # more points tie for the last place, as far as rounding can tell, than there was room for: these queries look at all of theirs again
        tied = np.flatnonzero(np.isfinite(best[:, -1]) & (best[:, -1] >= best[:, k] - 1e-9 * (1 + np.abs(best[:, k]))))
        rows, places = np.nonzero(np.isfinite(best))
        fine = ~np.isin(rows, tied)
        rows, found = rows[fine], mine[rows[fine], places[fine]]
        for i in tied:
            every = np.concatenate([np.arange(at[j], at[j + 1]) for j in np.searchsorted(leaves, np.intersect1d(leaves, asked_for[i]))])
            close = every[v[every] @ q[i] >= best[i, k] - 1e-9 * (1 + abs(best[i, k]))]
            rows, found = np.append(rows, np.full(len(close), i)), np.append(found, close)
        exact = np.concatenate([(v[found[n : n + 65_536]] * q[rows[n : n + 65_536]]).sum(1) for n in range(0, len(found), 65_536)] or [np.zeros(0)])
        return pd.DataFrame({"query_id": group["query_id"].to_numpy()[rows], "rep": rep[found], "score": exact})

    scored = queries.groupBy("bucket").cogroup(members.groupBy("bucket")).applyInPandas(tidy_group(score), "query_id long, rep long, score double")
    one = scored.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    top = one.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1)
    top = top.join(found.select("rep", "ids"), "rep")
    each = top.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
