"""Best-two-fit packing of documents into sequences of a fixed size.

A bin is filled greedily with the largest documents that still fit; then its smallest document gives way to two
unpacked ones that fill the gap which that leaves more tightly, if there are such.  What a bin gets depends on how many
documents of each length are left and on nothing else, and lengths are at most the bin's size.  So the plan is made
from the histogram of lengths, a pattern of lengths and the number of bins with it at a time, which gives the very
bins of the one-by-one algorithm at a cost that doesn't grow with the number of documents.  Then the n-th document of
a length gets the n-th place for that length.

Corner cases: a null or empty text is the end id alone, one piece of length 1; repeated ids and rows are packed one by
one; null ids stay null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.memory import tidy
from tidelog.llm.shared import materialize, texts, work_dir
from tidelog.llm.tokens import encoder

PIECES = "part long, rank long, doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """The plan for ``counts`` documents of each length: (number of bins, lengths in each), in the order of filling."""
    if any(not 0 < n <= size for n, c in counts.items() if c):
        raise ValueError(f"lengths must be from 1 to {size}")
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    plan = []
    while len(there := np.flatnonzero(left)):
        used: Counter[int] = Counter()
        held, gap, at = [], size, len(there) - 1
        while at >= 0 and gap >= there[0]:  # the largest that fits, as often as it does
            n = int(there[at])
            if k := min(gap // n, int(left[n])):
                held += [n] * k
                used[n] += k
                gap -= n * k
            at -= 1
        if gap and len(held) > 1:
            smallest, room = held[-1], gap + held[-1]
            free = there[left[there] > [used[int(n)] for n in there]]
            if len(free):
                mate = np.searchsorted(free, room - free, "right") - 1  # the largest that fits beside each
                fits = mate >= 0
                alone = fits & (free[mate] == free) & (left[free] - [used[int(n)] for n in free] < 2)
                mate = np.where(alone, mate - 1, mate)
                sums = np.where(mate >= 0, free + free[mate], 0)
                sums[~fits] = 0
                best = int(np.argmax(sums))
                if sums[best] > smallest:
                    pair = [int(free[best]), int(free[mate[best]])]
                    held = sorted(held[:-1] + pair, reverse=True)
                    used = Counter(held)
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
        plan.append((times, held))
    return plan


class Places:
    """Where the n-th document of each length goes."""

    def __init__(self, plan: list[tuple[int, list[int]]], size: int):
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        runs: dict[int, list[tuple[int, int, int]]] = {}
        offsets: dict[int, list[list[int]]] = {}
        first, ranks = 0, Counter()
        for times, held in plan:
            where: dict[int, list[int]] = {}
            at = 0
            for n in held:
                where.setdefault(n, []).append(at)
                at += n
            for n, places in where.items():
                runs.setdefault(n, []).append((ranks[n], first, len(places)))
                offsets.setdefault(n, []).append(places)
                ranks[n] += times * len(places)
            first += times
        for n, r in runs.items():
            widths = [len(x) for x in offsets[n]]
            self.by_length[n] = (*np.array(r, np.int64).T, np.cumsum([0, *widths[:-1]]), np.array([y for x in offsets[n] for y in x], np.int64))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            ranks, firsts, each, at, places = self.by_length[int(length[rows[0]])]
            run = np.searchsorted(ranks, rank[rows], "right") - 1
            j = rank[rows] - ranks[run]
            sequence[rows] = firsts[run] + j // each[run]
            offset[rows] = places[at[run] + j % each[run]]
        return sequence, offset


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, size: int) -> DataFrame:
    """Encode whole texts with the end id after each and cut longer ones; ``rank`` counts a part's pieces of a length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, end = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            enc, rows = encoder(tokenizer_path), []
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    ids = ids + end
                    total, start, piece = len(ids) // 4, 0, 0
                    n = total % size or size
                    while start < total:
                        rows.append((part, int(seen[n]), doc_id, piece, start, n, zlib.crc32(ids if n == total else ids[4 * start : 4 * (start + n)])))
                        seen[n] += 1
                        start, piece, n = start + n, piece + 1, size
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=[c.split()[0] for c in PIECES.split(", ")])

    return texts(docs).mapInArrow(tidy(cut, "tokens"), PIECES)


def pack(spark: SparkSession, pieces: DataFrame, size: int) -> DataFrame:
    """Give each piece a sequence and an offset.  ``pieces`` needs (part, rank, length), rank counting from 0 within both.

    Ranks within a part become ranks over all by adding what the parts before it hold of that length: sums over a
    table with a row for each part and length, so no task ever holds all documents of a length.
    """
    counts = pieces.groupBy("part", "length").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # one row for each length up to the size
    places = Places(best_two_fit(histogram, size), size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch["length"].to_numpy(), batch["rank"].to_numpy())
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("part", "rank")]
            yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("before")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name not in ("part", "rank"))
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    pieces = materialize(pieces_of(docs, tokenizer_path, end_id, size), f"{work_dir(spark, 'pieces')}/pieces")
    return pack(spark, pieces, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
