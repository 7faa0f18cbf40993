"""Removal of repeated passages: bytes covered by a string of LENGTH bytes that also starts in an earlier document.

Suffixes are sorted by a difference cover modulo 3: the suffixes at positions 1 and 2 modulo 3 are ranked by their triples, by
recursion on the names of the triples where those repeat; the rest follow from a character and a rank and are merged
in; then neighbours in the order whose prefixes agree on LENGTH bytes are one run, whose smallest document keeps it.

Sorting all suffixes of a corpus at once would move each many times.  Instead the suffixes are first dealt out so that
equal ones meet, and most never need sorting:

1.  In each window of LENGTH bytes the GRAM with the smallest hash is its anchor.  Equal windows have equal anchors in
    the same place, so they are found among the windows around one gram.  An anchor's surroundings are all bytes of
    windows that contain it.  Only digests of gram and surroundings are sent out (the surroundings' has 96 bits beside the 48 of the gram), with the smallest
    document of the block that has them.
    Beside them go short marks of the 13 bytes on either side of the gram: surroundings that share a window share one of them.
2.  Where a smaller document has the same surroundings, all of them are covered: copies end here, whatever their number.
    Of each different surroundings of a gram one owner is left, the document with the smallest id.
3.  Owners of different surroundings of one gram that have a mark in common may still share windows.  Only their bytes are sent, dealt out by gram,
    and their suffixes sorted as above, a few megabytes at a time.
4.  A gram with very many different surroundings is dealt out over several sorts.  Each finds its own runs; the smallest
    documents of equal runs of different sorts are then compared by digest, a row for each run.

No step looks at a bounded number of anything: what a step leaves out cannot hold a string that counts.

Corner cases: a null or empty text has no bytes; a null id counts as larger than any other, and rows with equal ids
never cover each other; a text shorter than LENGTH keeps everything; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.blocks import read_block, spread, write_blocks
from tidelog.llm.memory import tidy, tidy_group
from tidelog.llm.shared import materialize, work_dir

LENGTH, GRAM, HALF = 50, 24, 13
#: Surroundings of one gram in a sort, and bytes of surroundings in a sort of many grams.
OWNERS, SORT_BYTES = 8_192, 3 << 18
NO_ID = (1 << 63) - 1
KEPT, COVERED, OWNER = 0, 1, 2

_RNG = np.random.default_rng(50)
BYTE_HASH = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
ODD = _RNG.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of s in their order; a shorter one comes first.  Values of s are positive."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.uint64), np.zeros(3, np.uint64)])
    one, two, none = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])  # with a last empty triple where the first kind would run into the second
    if int(t.max()) < 1 << 21:
        triple = t[sample] << np.uint64(42) | t[sample + 1] << np.uint64(21) | t[sample + 2]
    else:
        _, pair = np.unique(t[sample] << np.uint64(32) | t[sample + 1], return_inverse=True)
        triple = pair.astype(np.uint64) << np.uint64(32) | t[sample + 2]
    distinct, names = np.unique(triple, return_inverse=True)
    order = np.argsort(names) if len(distinct) == len(sample) else suffix_array(names + 1)
    rank = np.zeros(n + 4, np.uint64)
    rank[sample[order]] = np.arange(1, len(order) + 1, dtype=np.uint64)
    wide = np.uint64(32)
    rest = none[np.argsort(t[none] << wide | rank[none + 1], kind="stable")]
    sampled = sample[order]
    sampled = sampled[sampled < n]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[ones] << wide | rank[ones + 1], t[rest] << wide | rank[rest + 1])
    if len(twos):
        both = np.concatenate([twos, rest])
        _, pair = np.unique(t[both] << wide | t[both + 1], return_inverse=True)
        key = pair.astype(np.uint64) << wide | rank[both + 2]
        before = before + np.searchsorted(key[: len(twos)], key[len(twos) :])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    free = np.ones(n, bool)
    out[at], free[at] = rest, False
    out[free] = sampled
    return out


def equal_runs(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their suffixes, and whether each agrees with the one before it on LENGTH bytes."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text.astype(np.int64) + 1)
    order = order[wanted[order]]
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(text), np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | padded[i : i + len(text)]
    same = np.arange(1, len(order))
    for at in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        same = same[words[order[same] + at] == words[order[same - 1] + at]]
    agrees = np.zeros(len(order), bool)
    agrees[same] = True
    return order, agrees


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    h = BYTE_HASH[data]
    size, eight = 1, None
    for i in range(4):
        h = h[:-size] * ODD[i] + h[size:]
        size *= 2
        if size == 8:
            eight = h
    h = h[: len(h) - 8] * ODD[4] + eight[16:]
    h ^= h >> np.uint64(32)
    h *= ODD[5]
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all windows within documents; starts has the end as its last."""
    places, hashes = [], []
    step, span = 1 << 18, LENGTH - GRAM + 1
    end_of = starts[1:]
    for at in range(0, max(len(data) - LENGTH + 1, 0), step):
        part = data[at : at + step + LENGTH - 1]
        h = gram_hashes(part)
        low = h & np.uint64(~((1 << 23) - 1) & (1 << 64) - 1) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :]) if span > size else low
        window = np.arange(at, at + len(low))
        ends = end_of[np.searchsorted(end_of, window, "right")]
        best = (low[window + LENGTH <= ends] & np.uint64((1 << 23) - 1)).astype(np.int64)
        if len(best):
            best = best[np.concatenate([[True], best[1:] != best[:-1]])]
            places.append(best + at)
            hashes.append(h[best])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, gram = np.concatenate(places), np.concatenate(hashes)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    return place[new], gram[new]


def between(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` bytes are in any of the spans; a megabyte of sums at a time."""
    left, right = np.sort(left), np.sort(right)
    out, open_spans = np.zeros(size, bool), 0
    for at in range(0, size, 1 << 18):
        end = min(at + (1 << 18), size)
        starts, ends = left[slice(*np.searchsorted(left, (at, end)))] - at, right[slice(*np.searchsorted(right, (at, end)))] - at
        change = np.bincount(starts, minlength=end - at).astype(np.int32) - np.bincount(ends, minlength=end - at).astype(np.int32)
        change[0] += open_spans
        level = np.cumsum(change, dtype=np.int32)
        out[at:end] = level > 0
        open_spans = int(level[-1])
    return out


class BlockText:
    """A block's bytes, document by document, and its anchors with their surroundings."""

    def __init__(self, path: str, n_buckets: int = 0):
        self.table = read_block(path)
        parts = [(t or "").encode() for t in self.table["text"].to_pylist()]
        self.starts = np.cumsum([0, *map(len, parts)])
        self.data = b"".join(parts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.ids = np.array([NO_ID if i is None else i for i in self.table["doc_id"].to_pylist()], np.int64)
        if n_buckets:
            self.place, self.gram = anchors(self.bytes, self.starts)
            self.doc = np.searchsorted(self.starts, self.place, "right") - 1
            self.left = np.maximum(self.place - (LENGTH - GRAM), self.starts[self.doc])
            self.right = np.minimum(self.place + LENGTH, self.starts[self.doc + 1])
            self.n_buckets = n_buckets

    def marks(self) -> np.ndarray:
        """For each anchor hashes of the HALF bytes after and before its gram, zero where the document has fewer.

        A window has LENGTH - GRAM bytes beside its anchor, and so HALF of them at least on one side: surroundings of a gram that share a window share a mark.
        """
        padded = np.frombuffer(self.data + bytes(16), np.uint8)
        words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        out = np.zeros((len(self.place), 2), "<u2")
        for side, at in enumerate((self.place + GRAM, self.place - HALF)):
            there = np.flatnonzero((at >= self.starts[self.doc]) & (at + HALF <= self.starts[self.doc + 1]))
            mixed = words[at[there]] * ODD[7] + words[at[there] + HALF - 8] * ODD[6]
            out[there, side] = np.maximum((mixed ^ mixed >> np.uint64(29)) * ODD[5] >> np.uint64(48), np.uint64(1))
        return out

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The digests of all anchors' surroundings, 128 bits as two columns; the anchors that speak for those of the block with the same surroundings,
        in the order of buckets; and for each anchor which of them speaks for it: the one in the document with the smallest id."""
        digest, view = xxhash.xxh3_128_digest, memoryview(self.data)
        raw = b"".join([digest(view[a:b]) for a, b in zip(self.left.tolist(), self.right.tolist())])
        unit = np.frombuffer(raw, "<u8").reshape(-1, 2) + ((self.place - self.left).astype(np.uint64) * ODD[6])[:, None]
        bucket = ((self.gram >> np.uint64(24)) % np.uint64(self.n_buckets)).astype(np.int64)
        found = pa.array(unit[:, 0]).dictionary_encode()
        speaks, n, whose = found.indices.to_numpy(), len(found.dictionary), self.ids[self.doc]
        first = self._smallest(speaks, whose, n)
        if (unit[:, 1] != unit[first[speaks], 1]).any():  # half of a digest is the same by chance: tell them apart by all of it
            _, speaks = np.unique(unit, axis=0, return_inverse=True)
            speaks = speaks.ravel()
            n = int(speaks.max()) + 1
            first = self._smallest(speaks, whose, n)
        order = np.argsort(bucket[first].astype(np.uint16) if self.n_buckets < 1 << 16 else bucket[first], kind="stable")
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        first = first[order]
        self.at = np.searchsorted(bucket[first], np.arange(self.n_buckets + 1))
        return unit, first, back[speaks]

    @staticmethod
    def _smallest(group: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """A row of each group with the group's smallest id."""
        least, out = np.full(n, NO_ID), np.zeros(n, np.int64)
        np.minimum.at(least, group, ids)
        rows = np.flatnonzero(ids == least[group])
        out[group[rows]] = rows
        return out


def _send(manifest: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, block, data): gram, surroundings and document, packed by column, of each anchor that speaks for its like in the block.

    So surroundings that are in every document cost a row for each block.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, path in zip(batch.column("block").to_pylist(), batch.column("path").to_pylist()):
                b, rows = BlockText(path, n_buckets), []
                (unit, first, _), marks = b.units(), b.marks()
                for i in np.flatnonzero(np.diff(b.at)):
                    some = first[b.at[i] : b.at[i + 1]]
                    gram = np.ascontiguousarray(b.gram[some].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                    rows.append((int(i), block, gram.tobytes() + unit[some, 0].tobytes() + unit[some, 1].astype("<u4").tobytes() + marks[some].T.tobytes() + b.ids[b.doc[some]].astype("<i8").tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "block", "data"])

    return manifest.mapInArrow(tidy(each), "bucket int, block long, data binary")


def _judge(sent: DataFrame, owners_of_a_sort: int) -> DataFrame:
    """(block, bucket, data): a byte for each anchor that was sent: KEPT, COVERED, or OWNER plus the logarithm of the sorts to deal to."""

    def each(group: pd.DataFrame) -> pd.DataFrame:
        grams, high, low, after, before, ids, sizes = [], [], [], [], [], [], []
        for data in group["data"]:
            n = len(data) // 30
            full = np.zeros((n, 8), np.uint8)
            full[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(n, 6)
            grams.append(full.view("<u8").ravel())
            high.append(np.frombuffer(data, "<u8", n, 6 * n))
            low.append(np.frombuffer(data, "<u4", n, 14 * n))
            after.append(np.frombuffer(data, "<u2", n, 18 * n))
            before.append(np.frombuffer(data, "<u2", n, 20 * n))
            ids.append(np.frombuffer(data, "<i8", n, 22 * n))
            sizes.append(n)
        gram, unit, other, doc = np.concatenate(grams), np.concatenate(high), np.concatenate(low), np.concatenate(ids)
        order = np.lexsort((doc, other, unit, gram))
        gram, unit, other, doc = gram[order], unit[order], other[order], doc[order]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_unit = new_gram | np.concatenate([[True], (unit[1:] != unit[:-1]) | (other[1:] != other[:-1])])
        of_unit, of_gram = np.cumsum(new_unit) - 1, np.cumsum(new_gram) - 1
        owner = doc[new_unit]  # the smallest document with these surroundings
        # of a gram's surroundings only those can share a window that have a mark in common
        related, gram_of = np.zeros(len(owner), bool), of_gram[new_unit]
        for side in (after, before):
            mark = np.concatenate(side)[order][new_unit].astype(np.int64)
            marked = np.flatnonzero(mark)
            found = pa.array(gram_of[marked] << 16 | mark[marked]).dictionary_encode().indices.to_numpy()
            related[marked] |= np.bincount(found)[found] > 1 if len(found) else False
        first_unit = of_unit[new_gram]
        low, high = np.minimum.reduceat(owner, first_unit), np.maximum.reduceat(owner, first_unit)
        units = np.add.reduceat(related.astype(np.int64), first_unit)
        verdict = np.where(doc > owner[of_unit], COVERED, KEPT)
        several = (verdict == KEPT) & (low < high)[of_gram] & related[of_unit]
        # the smallest document of a gram only lends its bytes: once for each surroundings
        several &= (doc > low[of_gram]) | new_unit
        sorts = np.ceil(np.log2(np.maximum(1, units / owners_of_a_sort))).astype(int)
        verdict[several] = (OWNER + sorts[of_gram])[several]
        back = np.empty(len(order), np.uint8)
        back[order] = verdict
        return pd.DataFrame({"block": group["block"].to_numpy(), "bucket": group["bucket"].to_numpy(), "data": [x.tobytes() for x in np.split(back, np.cumsum(sizes)[:-1])]})

    return sent.groupBy("bucket").applyInPandas(tidy_group(each), "block long, bucket int, data binary")


def _apply(manifest: DataFrame, verdicts: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of two kinds: a block's covered bytes as bits (gram null), and an owner's surroundings (their bytes as data)."""

    def each(listed: pd.DataFrame, judged: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = dict(zip(judged["bucket"], judged["data"]))
        for block, path in zip(listed["block"], listed["path"]):
            b = BlockText(path, n_buckets)
            _, first, speaks = b.units()
            told = np.concatenate([np.frombuffer(known[int(i)], np.uint8) for i in np.flatnonzero(np.diff(b.at))] or [np.zeros(0, np.uint8)])
            whose = b.ids[b.doc]
            # a larger document than the one that speaks for an anchor has the same surroundings as a smaller one
            verdict = np.where(whose > whose[first][speaks], COVERED, told[speaks]) if len(first) else told
            gone = verdict == COVERED
            covered = between(b.left[gone], b.right[gone], len(b.data))
            out.append(pd.DataFrame({"block": [block], "gram": pd.array([None], "Int64"), "sorts": [0], "doc": [0], "start": [0], "data": [np.packbits(covered).tobytes()]}))
            own = np.flatnonzero(verdict >= OWNER)
            if len(own):
                out.append(pd.DataFrame({"block": block, "gram": pd.array(b.gram[own].view(np.int64), "Int64"), "sorts": verdict[own].astype(int) - OWNER, "doc": b.ids[b.doc[own]], "start": b.left[own], "data": [b.data[x:y] for x, y in zip(b.left[own].tolist(), b.right[own].tolist())]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["block", "gram", "sorts", "doc", "start", "data"])

    return manifest.select("block", "path").groupBy("block").cogroup(verdicts.groupBy("block")).applyInPandas(tidy_group(each), "block long, gram long, sorts int, doc long, start long, data binary")


def _sort(owners: DataFrame) -> DataFrame:
    """(block, data, digest, doc): window starts that are covered (digest null), and the runs of a sort that shares its gram."""

    def each(group: pd.DataFrame) -> pd.DataFrame:
        parts, doc, block, start = group["data"].tolist(), group["doc"].to_numpy(), group["block"].to_numpy(), group["start"].to_numpy()
        sizes = np.array([len(p) for p in parts])
        text = np.frombuffer(b"".join(parts), np.uint8)
        first = np.cumsum(sizes) - sizes
        unit = np.repeat(np.arange(len(parts)), sizes)
        inside = np.arange(len(text)) - first[unit]
        order, agrees = equal_runs(text, np.flatnonzero(inside + LENGTH <= sizes[unit]))
        if not len(order):
            return pd.DataFrame({"block": pd.Series([], dtype="int64"), "data": pd.Series([], dtype=object), "digest": pd.Series([], dtype=object), "doc": pd.Series([], dtype="int64")})
        run, whose = np.cumsum(~agrees) - 1, doc[unit[order]]
        least = np.minimum.reduceat(whose, np.flatnonzero(~agrees))
        found = np.flatnonzero(whose > least[run])
        blocks, places = block[unit[order[found]]], (start[unit] + inside)[order[found]]
        out = []
        for b in np.unique(blocks):
            out.append(pd.DataFrame({"block": [b], "data": [np.unique(places[blocks == b]).astype("<i8").tobytes()], "digest": [None], "doc": [0]}))
        if group["sorts"].max() > 0:
            mine, view = np.flatnonzero(whose == least[run]), memoryview(text.tobytes())
            at = order[mine]
            digests = [xxhash.xxh3_128_digest(view[i : i + LENGTH]) for i in at.tolist()]
            out.append(pd.DataFrame({"block": block[unit[at]], "data": [x.tobytes() for x in (start[unit] + inside)[at].astype("<i8")], "digest": digests, "doc": whose[mine]}))
        return pd.concat(out) if out else pd.DataFrame({"block": pd.Series([], dtype="int64"), "data": pd.Series([], dtype=object), "digest": pd.Series([], dtype=object), "doc": pd.Series([], dtype="int64")})

    return owners.groupBy("task", "part").applyInPandas(tidy_group(each), "block long, data binary, digest binary, doc long")


def covered_bytes(spark: SparkSession, manifest: DataFrame, folder: str, owners_of_a_sort: int = OWNERS) -> DataFrame:
    """(block, data): bits of a block's covered bytes, or window starts (kind 1), any number of rows for each block."""
    spaced, n_blocks = spread(manifest)
    n_buckets = max(8, n_blocks // 2)  # a bucket has what two blocks send, whatever the number of blocks
    verdicts = materialize(_judge(_send(spaced, n_buckets), owners_of_a_sort), f"{folder}/verdicts")
    applied = materialize(_apply(manifest, verdicts, n_buckets), f"{folder}/applied")
    owners = applied.where("gram is not null")
    size = owners.agg(F.sum(F.length("data"))).first()[0] or 0
    tasks = int(size // SORT_BYTES) + 1
    # grams with few owners share a sort; a gram with many has sorts to itself, its owners dealt by document
    owners = owners.withColumn("task", F.when(F.col("sorts") == 0, F.pmod(F.xxhash64("gram"), F.lit(tasks))).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("gram"), 2)))
    owners = owners.withColumn("part", F.when(F.col("sorts") == 0, 0).otherwise(F.pmod(F.xxhash64("doc", "start", "block"), F.expr("shiftleft(1L, sorts)"))))
    runs = materialize(_sort(owners), f"{folder}/runs")
    shared = runs.where("digest is not null")
    least = shared.groupBy("digest").agg(F.min("doc").alias("least"))
    late = shared.join(least, "digest").where("doc > least").select("block", "data")
    bits = applied.where("gram is null").select("block", "data", F.lit(0).alias("kind"))
    return bits.union(runs.where("digest is null").select("block", "data", F.lit(1).alias("kind"))).union(late.withColumn("kind", F.lit(1)))


def finish(manifest: DataFrame, covered: DataFrame, result: Callable[[BlockText, np.ndarray], pa.Table], schema) -> DataFrame:
    """``result`` of each block and its covered bytes."""

    def each(listed: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for path in listed["path"].to_pylist():
            b = BlockText(path)
            gone, starts = np.zeros(len(b.data), bool), []
            for kind, data in zip(found["kind"], found["data"]):
                if kind.as_py():
                    starts.append(np.frombuffer(data.as_buffer(), "<i8"))
                else:
                    gone |= np.unpackbits(np.frombuffer(data.as_buffer(), np.uint8), count=len(gone)).view(bool)
            if starts:
                every = np.concatenate(starts)
                gone |= between(every, every + LENGTH, len(gone))
            out.append(result(b, gone))
        return pa.concat_tables(out)

    return manifest.select("block", "path").groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(tidy_group(each), schema)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest_rows(b: BlockText, gone: np.ndarray) -> pa.Table:
    rows = []
    for i, doc_id in enumerate(b.table["doc_id"].to_pylist()):
        a, e = int(b.starts[i]), int(b.starts[i + 1])
        g = gone[a:e]
        spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
        kept = b.data[a:e] if not spans else b.bytes[a:e][~g].tobytes()
        rows.append((doc_id, e - a, int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    types = [pa.int64()] * 4 + [pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=[c.split()[0] for c in DIGEST.split(", ")])


def removal_digest(spark: SparkSession, docs: DataFrame, block_bytes: int | None = None, owners_of_a_sort: int = OWNERS) -> DataFrame:
    """DIGEST of every document."""
    folder = work_dir(spark, "suffix-array")
    manifest = write_blocks(docs.select("doc_id", "text"), f"{folder}/blocks", **({"block_bytes": block_bytes} if block_bytes else {}))
    return finish(manifest, covered_bytes(spark, manifest, folder, owners_of_a_sort), digest_rows, DIGEST)


def without_repeats(spark: SparkSession, docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """The rows of docs with what is covered taken out of their texts; a character that is covered in part stays.

    n_chars, where there is such a column, follows the text.
    """
    folder, schema = work_dir(spark, "suffix-array"), docs.schema
    manifest = write_blocks(docs, f"{folder}/blocks", **({"block_bytes": block_bytes} if block_bytes else {}))
    covered = covered_bytes(spark, manifest, folder)

    def kept(b: BlockText, gone: np.ndarray) -> pa.Table:
        """Each run of covered bytes shrinks to whole characters."""
        old, texts = b.table["text"].to_pylist(), []
        for i, text in enumerate(old):
            a, e = int(b.starts[i]), int(b.starts[i + 1])
            stays = ~gone[a:e]
            if not stays.all():
                at = np.flatnonzero((b.bytes[a:e] & 0xC0) != 0x80)  # a character stays if any of its bytes does
                stays = np.repeat(np.logical_or.reduceat(stays, at), np.diff(np.append(at, e - a)))
                text = b.bytes[a:e][stays].tobytes().decode()
            texts.append(text)
        out = b.table.set_column(b.table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in out.column_names:
            field = out.schema.field("n_chars")
            sizes = [n if t == o else len(t) for n, t, o in zip(out["n_chars"].to_pylist(), texts, old)]
            out = out.set_column(out.schema.get_field_index("n_chars"), field, pa.array(sizes, field.type))
        return out

    return finish(manifest, covered, kept, schema)
