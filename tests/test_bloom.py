import xxhash
from pyspark.sql import functions as F

from tidelog.functions.bloom import BLOCK, BloomFilter, NullFilter, build_filter, filter_blocks, filter_size, might_contain, might_contain_many, positions


def keys(spark, prefix, n):
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("key"))


def by_hand(key, size, hashes):
    """Places of a key's bits, from the hash alone."""
    h = xxhash.xxh64_intdigest(key.encode(), 42)
    block, start, step = (h // 2**32) * -(-size // BLOCK) // 2**32, h % 2**15, h // 2**15 % 2**15 // 2 * 2 + 1
    return [block * BLOCK + (start + i * step) % min(size, BLOCK) for i in range(hashes)]


def test_positions_by_hand(spark):
    for size in (64, 250, 10_000, 5 * BLOCK):
        rows = keys(spark, "né", 60).select("key", positions(F.col("key"), size, 6).alias("p")).collect()
        assert [r["p"] for r in rows] == [by_hand(r["key"], size, 6) for r in rows]
        assert all(0 <= p < size for r in rows for p in r["p"])


def test_no_key_is_denied_and_few_others_are_let_through(spark):
    for n in (300, 20_000):  # one block, several blocks
        f = build_filter(keys(spark, "in/", n), n, 10, 7)
        assert all(f.might_contain(f"in/{i}") for i in range(n))
        assert sum(f.might_contain(f"out/{i}") for i in range(n)) < 0.03 * n


def test_a_joined_test_agrees_with_one_in_memory(spark):
    n, size = 9_000, filter_size(9_000, 10)
    f, blocks = build_filter(keys(spark, "q", n), n, 10, 7), filter_blocks(keys(spark, "q", n), size, 7)
    rows = might_contain_many(blocks, keys(spark, "q", n).union(keys(spark, "z", 2_000)), size, 7).collect()
    assert len(rows) == 11_000 and all(r["maybe"] == f.might_contain(r["key"]) for r in rows)


def test_an_array_of_places_agrees_too(spark):
    f = build_filter(keys(spark, "k", 50), 50, 10, 7)
    bits = F.array(*[F.lit(i).cast("long") for i in range(f.size) if f.fetch(0)[i >> 3] >> (i & 7) & 1])
    rows = keys(spark, "k", 200).select("key", might_contain(bits, F.col("key"), f.size, 7).alias("maybe")).collect()
    assert all(r["maybe"] == f.might_contain(r["key"]) for r in rows)


def test_sizes_and_edges():
    assert filter_size(1, 10) == 64 and filter_size(1000, 10) == 10_000 and filter_size(10_000, 10) == 4 * BLOCK
    assert not BloomFilter(lambda block: b"", 64, 3).might_contain("a") and NullFilter().might_contain("a")
