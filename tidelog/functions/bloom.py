"""Membership filters: one-sided, so a key that was added is never denied.

A filter is a row of blocks of BLOCK bits.  One 64-bit hash of a key gives its block, a first bit in it and an odd step to the others, so a
test looks at one block, and a filter of any size is built, kept and read a block at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block: what Spark's bitmap functions hold in a value.
BLOCK = 32_768
BLOCK_BYTES = BLOCK // 8


def filter_size(keys: int, bits_per_key: int) -> int:
    """Bits of a filter for so many keys: 64 at least, and whole blocks if there are several."""
    size = max(64, keys * bits_per_key)
    return size if size <= BLOCK else -(-size // BLOCK) * BLOCK


def block_of(key: Column, size: int) -> Column:
    """The block that a key's bits are in, from the upper half of its hash."""
    return F.shiftright(F.shiftrightunsigned(F.xxhash64(key), 32) * F.lit(-(-size // BLOCK)).cast("long"), 32)


def bits_of(key: Column, size: int, hashes: int) -> Column:
    """A key's bits inside its block, from the lower half."""
    h, mask = F.xxhash64(key), F.lit(BLOCK - 1).cast("long")
    first, step = h.bitwiseAND(mask), F.shiftrightunsigned(h, 15).bitwiseAND(mask).bitwiseOR(F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), lambda i: (first + i * step) % F.lit(min(size, BLOCK)).cast("long"))


def positions(key: Column, size: int, hashes: int) -> Column:
    """The places of a key's bits in the whole filter."""
    block = block_of(key, size)
    return F.transform(bits_of(key, size, hashes), lambda b: block * F.lit(BLOCK).cast("long") + b)


def might_contain(set_bits: Column, key: Column, size: int, hashes: int) -> Column:
    """Whether all bits of a key are in an array of set places."""
    return F.forall(positions(key, size, hashes), lambda p: F.array_contains(set_bits, p))


def _places(key: str, size: int, hashes: int) -> tuple[int, list[int]]:
    """Block and bits of a key, as the expressions give them."""
    h = xxhash.xxh64_intdigest(key.encode(), 42)
    step = h >> 15 & (BLOCK - 1) | 1
    return (h >> 32) * -(-size // BLOCK) >> 32, [((h & (BLOCK - 1)) + i * step) % min(size, BLOCK) for i in range(hashes)]


@dataclass(frozen=True)
class BloomFilter:
    """A filter whose blocks are fetched when they are asked for; a block that is short or missing reads as zeros."""

    fetch: Callable[[int], bytes]
    size: int
    hashes: int

    def might_contain(self, key: str) -> bool:
        block, bits = _places(key, self.size, self.hashes)
        data = self.fetch(block)
        return all(b >> 3 < len(data) and data[b >> 3] >> (b & 7) & 1 for b in bits)


class NullFilter:
    """Knows nothing, denies nothing."""

    def might_contain(self, key: str) -> bool:
        return True


def filter_blocks(entries: DataFrame, size: int, hashes: int) -> DataFrame:
    """(block, bits): the blocks with any bit set, BLOCK_BYTES each.  Keys are dealt out by block, so each block is made in one place."""
    dealt = entries.select(block_of(F.col("key"), size).alias("block"), bits_of(F.col("key"), size, hashes).alias("b")).repartition("block")
    return dealt.select("block", F.explode("b").alias("b")).groupBy("block").agg(F.bitmap_construct_agg("b").alias("bits"))


def build_filter(entries: DataFrame, keys: int, bits_per_key: int, hashes: int) -> BloomFilter:
    """A filter held in memory: a row for each block comes to the driver."""
    size = filter_size(keys, bits_per_key)
    held = {r["block"]: bytes(r["bits"]) for r in filter_blocks(entries, size, hashes).collect()}
    return BloomFilter(lambda block: held.get(block, b""), size, hashes)


def might_contain_many(blocks: DataFrame, keys: DataFrame, size: int, hashes: int) -> DataFrame:
    """``keys`` with ``maybe``: the test of each key against the block that it is joined to; neither side is gathered."""
    found = keys.withColumn("_block", block_of(F.col("key"), size)).join(blocks.toDF("_block", "_bits"), "_block", "left")
    byte = lambda b: F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(b, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.forall(bits_of(F.col("key"), size, hashes), lambda b: byte(b).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (b.bitwiseAND(F.lit(7).cast("long")) + 1).cast("int"))) != 0)
    return found.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("_block", "_bits")


def writer_options(keys: int) -> dict[str, str]:
    """Options that make the Parquet writer add a filter on the key to each row group."""
    return {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(max(1, keys))}
