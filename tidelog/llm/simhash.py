"""Near-duplicates by SimHash, found through an embedding of segment popcounts.

A fingerprint's 64 bits are 32 segments of two.  The numbers of set bits of the segments, each 0, 1 or 2, place the
fingerprint on a grid of 32 dimensions.  The Manhattan distance between two places is never more than the number of
differing bits, so a range join on the grid loses no link.  With radius r the dimensions are dealt into r + 3 blocks:
two places within r agree exactly on at least three of them, so a cell is three blocks' coordinates, and whoever is
in range shares a cell.  In a cell the Manhattan distance is tested first, then the bits.

With each count written in unary (0, 1, 2 as 00, 01, 11) a place is one 64-bit number, a cell a masked one, and the
Manhattan distance the popcount of an exclusive or.

Corner cases: null and empty texts have fingerprint zero and are linked like any other; equal texts and repeated ids
share a fingerprint; a null id is not a candidate for the smallest id; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.components import components, join_up
from tidelog.llm.memory import tidy
from tidelog.llm.shared import materialize, texts, work_dir

#: Distinct fingerprints of a cell that are compared in one go; a fuller cell is cut into blocks, compared two by two.
CELL = 2048
LOW = 0x5555555555555555


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, space-joined, repeats included; the whole sequence if it is shorter."""
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fingerprint(parts: list[bytes]) -> int:
    """A bit is set if it is set in over half the hashes; none: zero."""
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int, *more: str) -> DataFrame:
    """(doc_id, fp) of every whole text; fp is the 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingles(t.encode().lower().split(), size)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(tidy(each), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """Segment popcounts in unary."""
    low, up = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    return (fp.bitwiseOR(up)).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))


def cell_masks(radius: int) -> list[int]:
    """The masks of all choices of three out of radius + 3 blocks of segments."""
    blocks = [sum(3 << (2 * int(s)) for s in part) for part in np.array_split(np.arange(32), radius + 3)]
    return [_signed(sum(c)) for c in combinations(blocks, 3)]


def _joined_up(fp: np.ndarray, place: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of a group that keep what is in range connected; rows of a group are adjacent."""
    label = np.arange(len(fp))
    left = np.arange(len(fp))
    step = 0
    while True:
        step += 1
        left = left[left + step < len(fp)]
        left = left[group[left] == group[left + step]]
        if not len(left):
            break
        near = left[np.bitwise_count(place[left] ^ place[left + step]) <= radius]  # the lower bound
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= radius]
        join_up(label, near, near + step)
    far = np.flatnonzero(label != np.arange(len(label)))
    return far, label[far]


def cell_links(cells: DataFrame, radius: int) -> DataFrame:
    """(a, b) links from rows (cell, part, fp, place), all rows of a (cell, part) in one task and adjacent."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            mask, cell, part, fp, place = columns
            new = (np.diff(mask) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0)
            i, j = _joined_up(fp.view(np.uint64), place.view(np.uint64), np.concatenate([[0], np.cumsum(new)]), radius)
            return pa.record_batch([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]):
                continue
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            last = int(np.argmax(same))  # the last group may go on in the next batch
            if last:
                yield links([x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield links(held)

    return cells.mapInArrow(tidy(each), "a long, b long")


def near_links(spark: SparkSession, distinct: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """Links between distinct fingerprints (column fp) that keep all pairs within the radius connected.

    Cells with one fingerprint go; a cell with more than ``cell`` is cut into blocks by hash, and each pair of blocks is a
    part of its own, so a part's rows are bounded while every pair in the cell still meets.
    """
    masks = F.array(*[F.lit(m) for m in cell_masks(radius)])
    rows = distinct.select("fp", embedding(F.col("fp")).alias("place")).select("fp", "place", F.posexplode(masks).alias("mask", "m"))
    rows = rows.select("mask", F.col("place").bitwiseAND(F.col("m")).alias("cell"), "fp", "place")
    # written, so that both sides of the join are plain exchanges, of which Spark can split the skewed partitions
    size = materialize(rows.groupBy("mask", "cell").count().where("count > 1"), f"{work_dir(spark, 'cells')}/size")
    rows = rows.join(size, ["mask", "cell"]).withColumn("blocks", F.ceil(F.col("count") / cell).cast("int"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(block, j) * F.col("blocks") + F.greatest(block, j)))
    parts = rows.select("mask", "cell", other.alias("part"), "fp", "place")
    parts = parts.repartition("mask", "cell", "part").sortWithinPartitions("mask", "cell", "part")
    return cell_links(parts, radius)


def near_components(spark: SparkSession, fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of written rows (doc_id, fp): the smallest fingerprint and the smallest doc_id reachable over links within the radius."""
    folder = work_dir(spark, "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/classes")
    roots = components(spark, near_links(spark, classes.select("fp"), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(rooted.join(smallest, "root").select("fp", "root", "component_id"), f"{folder}/named")


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document; the smallest id reachable over links within the radius.

    Documents with one fingerprint are one node, so a group of copies of any size costs one row after a partial count.
    """
    fps = materialize(fingerprints(docs, size), f"{work_dir(spark, 'simhash')}/fps")
    named = near_components(spark, fps, radius)
    return fps.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


