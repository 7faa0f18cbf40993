"""Near copies by similarity: SimHash views for candidates, a distance bound, then exact Jaccard.

One 64-bit fingerprint tells copies with a similarity of 0.8 from others only at a radius that no grid can search.  So a
text gets VIEWS fingerprints, each the SimHash of the TAKEN shingles that come first in an order of that view's own.
Two texts of similarity s agree in a view with a chance of about s ** TAKEN, and at 0.8 miss all views once in some
1.7 million pairs; unrelated texts practically never agree in any.  A view's equal fingerprints are a cell.

In a cell, an embedding bounds the distance as popcounts do for fingerprints: each shingle flips one of a sketch's bits, so the
differing bits of two sketches are never more than the shingles that differ, and pairs beyond what the similarity allows
are out.  A sketch has half as many bits as there are shingles at least, and is folded to compare it with a shorter one.
Of the rest a cell sends what its members need to hang together, the closest-looking links for each join, and those are
verified on the whole shingle sets.  Then only links that held join groups, and cells that kept pairs back send more of
those between groups that are still apart, four times as many for a join in each round, until no cell keeps any back.
So of the pairs that share a cell no link is lost.  Pairs that share none are lost, with the chance above.

With a ``radius`` the groups begin as operator 6's components, found by its segment popcounts, grid and Manhattan bound, which loses
no pair of fingerprints in range.  The views then look only for links between texts that are still apart.

Copies of one text are one node, named by the text's md5.  A cell with many members is cut into blocks that meet two by two.

Corner cases: texts without words are one group; a text shorter than a shingle is one shingle; equal ids and rows
follow their texts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.memory import collect_heaps, tidy
from tidelog.llm.shared import free, materialize, work_dir
from tidelog.llm.simhash import fingerprint, near_components, shingles

VIEWS, TAKEN, SKETCH = 20, 3, 512
CELL = 1024
#: Links that are verified for each join of two groups of a cell in the first round, and how many times more in each next.
LINKS, MORE = 2, 4
#: Words in a shingle of the fingerprints, as operator 6 has them.
FP_SIZE = 3
#: Size of the bitmap of texts with links.
BITS = 1 << 23
_ODD = np.random.default_rng(6).integers(0, 1 << 62, VIEWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in shingles((text or "").encode().lower().split(), size)], np.uint64))


def views_of(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of each view: bits set in over half of the hashes that come first in it."""
    if len(hashes) < TAKEN:
        few = hashes[0] if len(hashes) else np.uint64(0)
        return np.full(VIEWS, few if len(hashes) < 2 else hashes[0] & hashes[1], np.uint64)
    order = hashes[None, :] * _ODD[:, None]
    order ^= order >> np.uint64(31)
    first = np.argpartition(order, TAKEN - 1, axis=1)[:, :TAKEN]
    a, b, c = hashes[first].T
    return (a & b) | (a & c) | (b & c)


def sketch_of(hashes: np.ndarray) -> bytes:
    width = SKETCH
    while width * 2 < len(hashes):
        width *= 2
    bits = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


class _Bounds:
    """The bound of the distance between a cell's members, in the finest sketch that two of them have."""

    def __init__(self, sketches: list[bytes], size: np.ndarray, similarity: float):
        self.size, self.similarity, words = size, similarity, SKETCH // 64
        self.level = np.array([(len(x) * 8 // SKETCH).bit_length() - 1 for x in sketches])
        self.at, self.folded = [], []
        for k in range(self.level.max() + 1):
            mine = self.level >= k
            self.at.append(np.cumsum(mine) - 1)
            self.folded.append(np.array([np.bitwise_xor.reduce(np.frombuffer(sketches[i], "<u8").reshape(-1, words << k), axis=0) for i in np.flatnonzero(mine)]))

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Members before this one that may be similar to it, and the bounds as shares of all shingles of the two."""
        both = self.size[:i] + self.size[i]
        d = np.bitwise_count(self.folded[0][:i] ^ self.folded[0][i]).sum(axis=1, dtype=np.int64)
        d = np.maximum(d, np.abs(self.size[:i] - self.size[i]))
        within = lambda x: x[d[x] * (1 + self.similarity) <= both[x] * (1 - self.similarity) + 1e-9]
        near = within(np.arange(i))
        common = np.minimum(self.level[near], self.level[i])
        for k in np.unique(common[common > 0]):
            some, at, folded = near[common == k], self.at[k], self.folded[k]
            d[some] = np.maximum(d[some], np.bitwise_count(folded[at[some]] ^ folded[at[i]]).sum(axis=1, dtype=np.int64))
        near = within(near)
        return near, d[near] / both[near].clip(1)


def _forest(sketches: list[bytes], size: np.ndarray, similarity: float, root: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Links that join whoever may be similar, and whether pairs between different roots were kept back.

    Members enter one by one; each is linked to every group that holds someone of another root it may be similar to, by the ``links``
    members of the group with the smallest bound, and the groups become one.
    """
    n, out, kept = len(size), [], False
    if (root == root[0]).all():
        return np.zeros(0, int), np.zeros(0, int), False
    label, bounds = np.arange(n), _Bounds(sketches, size, similarity)
    for i in range(1, n):
        near, bound = bounds.near(i)
        apart = root[near] != root[i]
        order = near[apart][np.argsort(bound[apart], kind="stable")]
        groups = label[order]
        for g in np.unique(groups):
            some = order[groups == g]
            out += [(int(j), i) for j in some[:links]]
            kept |= len(some) > links
        joined = np.unique(np.concatenate([groups, label[:i][root[:i] == root[i]]]))
        if len(joined):
            label[i] = joined[0]
            if len(joined) > 1:
                label[:i][np.isin(label[:i], joined)] = joined[0]
    a, b = zip(*out) if out else ((), ())
    return np.array(a, int), np.array(b, int), kept


def _cell_links(cells: DataFrame, similarity: float, links: int) -> DataFrame:
    """(a, b) links, and (view, fp, part) of the cells that kept pairs back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def found() -> pa.RecordBatch:
            numbers: dict[bytes, int] = {}
            ids, roots = [r[0] for r in held], np.array([numbers.setdefault(r[3], len(numbers)) for r in held])
            a, b, kept = _forest([r[1] for r in held], np.array([r[2] for r in held], np.int64), similarity, roots, links)
            none = [None] * len(a)
            columns = [[*(ids[i] for i in x), *[None] * kept] for x in (a, b)] + [none + [k] * kept for k in key]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32()))], names=["a", "b", "view", "fp", "part"])

        for batch in batches:
            for *now, node, sketch, size, root in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if len(held) > 1:
                        yield found()
                    held, key = [], now
                held.append((node, sketch, size, root))
        if len(held) > 1:
            yield found()

    return cells.mapInArrow(tidy(each), "a binary, b binary, view int, fp long, part int")


def _place() -> Column:
    """Where a node's bit is in a bitmap of BITS."""
    return F.pmod(F.xxhash64("node"), F.lit(BITS)).cast("int")


def _bitmap(nodes: DataFrame) -> bytes:
    """Which of BITS hash values occur: a row for each used word of the bitmap comes to the driver, and no more."""
    places = nodes.select(_place().alias("p"))
    words = places.select(F.shiftright("p", 5).alias("w"), F.expr("shiftleft(1L, p & 31)").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(BITS // 32, "<u4")
    for r in words.collect():
        out[r["w"]] = r["b"]
    return out.tobytes()


def similar_classes(spark: SparkSession, docs: DataFrame, size: int = 5, similarity: float = 0.8, cell: int = CELL, radius: int | None = None) -> DataFrame:
    """(node, doc_id, rows, root): the distinct texts' md5 (16 bytes), the smallest id with that text, how many rows have both, and the group that the text is in.

    Links are texts of the similarity and, with a radius, texts whose fingerprints differ in no more bits.
    Shingle sets are made for the texts with links only: a bitmap of a fixed size lets few others through.
    """
    folder = work_dir(spark, "similar")
    text = F.coalesce(F.col("text"), F.lit(""))

    def once(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[tuple[list[bytes], list[np.ndarray], list[str]]]:
        """Nodes, shingle sets and texts of a batch's different texts."""
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            seen = {n: t for n, p, t in rows if wanted is None or wanted[p >> 5] >> (p & 31) & 1}
            yield list(seen), [shingle_set(t, size) for t in seen.values()], list(seen.values())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets, said in once(batches):
            fps = np.array([0 if radius is None else fingerprint(shingles(t.encode().lower().split(), FP_SIZE)) for t in said], np.uint64)
            views = np.array([views_of(s) for s in sets], np.uint64).reshape(len(sets), VIEWS)
            yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(views.view(np.int64).tolist(), pa.list_(pa.int64())), pa.array([sketch_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps.view(np.int64))], names=["node", "views", "sketch", "size", "fp"])

    named = docs.select(node_of(text).alias("node"), F.col("doc_id").cast("long").alias("doc_id")).groupBy("node", "doc_id").agg(F.count("*").alias("rows"))
    owner = named.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows")).alias("o")).select("node", "o.doc_id", "o.rows")
    classes = materialize(owner, f"{folder}/classes")
    whole = docs.select(node_of(text).alias("node"), text.alias("text")).select("node", _place().alias("place"), "text")
    seen = whole.mapInArrow(tidy(look), "node binary, views array<long>, sketch binary, size long, fp long").dropDuplicates(["node"])
    seen = materialize(seen, f"{folder}/seen")
    collect_heaps(spark)

    rows = seen.select("node", F.posexplode("views").alias("view", "fp"))
    # written, so that both sides of the join are plain exchanges, of which Spark can split the skewed partitions
    count = materialize(rows.groupBy("view", "fp").count().where("count > 1"), f"{folder}/count")
    rows = rows.join(count, ["view", "fp"]).withColumn("blocks", F.ceil(F.col("count") / cell).cast("int")).select("view", "fp", "node", "blocks")
    rows = materialize(rows, f"{folder}/rows")

    def apart(of: DataFrame, roots: DataFrame) -> DataFrame:
        """Cells whose members are in several groups."""
        rooted = of.select("view", "fp", "node").join(roots, "node", "left")
        ends = rooted.groupBy("view", "fp").agg(F.min(F.coalesce("root", "node")).alias("lo"), F.max(F.coalesce("root", "node")).alias("hi"))
        return ends.where("lo <> hi").select("view", "fp")

    tried = held = None
    if radius is not None:
        groups = near_components(spark, seen.select(F.col("node").alias("doc_id"), "fp"), radius)
        near = seen.select("node", "fp").join(groups.select("fp", "component_id"), "fp").where("node <> component_id")
        near = materialize(near.select("node", F.col("component_id").alias("root")), f"{folder}/near")
        held = near.select(F.col("root").alias("a"), F.col("node").alias("b"))
        rows = materialize(rows.join(apart(rows, near), ["view", "fp"], "left_semi"), f"{folder}/rows-apart")
    rows = rows.join(seen.select("node", "sketch", "size"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    part = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(block, j) * F.col("blocks") + F.greatest(block, j)))
    def gather(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
        for nodes, sets, _ in once(batches, np.frombuffer(bits.value, "<u4").tolist()):
            yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        bits = spark.sparkContext.broadcast(_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
        sets = materialize(whole.mapInArrow(tidy(lambda batches: gather(batches, bits)), "node binary, hashes binary").dropDuplicates(["node"]), f"{folder}/sets-{name}")
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return materialize(both.mapInArrow(tidy(verify), "a binary, b binary"), f"{folder}/verified-{name}")

    spread = rows.select("view", "fp", part.alias("part"), "node", "sketch", "size")
    start = spread.withColumn("root", F.lit(None).cast("binary")) if held is None else spread.join(near, "node", "left")
    members, links, number = start.withColumn("root", F.coalesce("root", "node")), LINKS, 0
    while True:
        collect_heaps(spark)
        cells = members.select("view", "fp", "part", "node", "sketch", "size", "root").repartition("view", "fp", "part").sortWithinPartitions("view", "fp", "part")
        found = materialize(_cell_links(cells, similarity, links), f"{folder}/found-{number}")
        pairs = found.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"{folder}/pairs-{number}")
        good = verified(pairs, str(number))
        tried, held = pairs if tried is None else tried.union(pairs), good if held is None else held.union(good)
        roots = components(spark, held)
        kept = found.where("a is null").select("view", "fp", "part")
        # the cells that kept pairs back and whose members are still apart
        still = apart(rows.join(kept.select("view", "fp").distinct(), ["view", "fp"], "left_semi"), roots)
        again = materialize(kept.join(still, ["view", "fp"], "left_semi"), f"{folder}/again-{number}")
        if not again.limit(1).count():
            break
        members = spread.join(again, ["view", "fp", "part"], "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        links, number = links * MORE, number + 1
    return classes.join(roots, "node", "left").select("node", "doc_id", "rows", F.coalesce("root", "node").alias("root"))


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def keep_one(spark: SparkSession, docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """The rows of docs without near copies: of each group the smallest id stays, once; null ids are larger than any other."""
    classes = similar_classes(spark, docs, size, similarity, radius=radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "rows")).alias("o")
    node, key, same = free(docs, "node"), free(docs, "key"), free(docs, "same")
    stay = classes.groupBy("root").agg(first).select(F.col("o.node").alias(key), F.col("o.doc_id").alias(same), F.col("o.rows").alias("rows"))
    stay = materialize(stay, f"{work_dir(spark, 'stay')}/stay")
    keyed = docs.withColumn(node, node_of(F.coalesce(F.col("text"), F.lit(""))))
    kept = keyed.join(stay.select(key, same), (F.col(node) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(same)), "left_semi")
    twice = stay.where("rows > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", node]) if twice else kept).drop(node)
