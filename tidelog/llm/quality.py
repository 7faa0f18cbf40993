"""Quality rules for documents and, through them, for whole hosts.

Each document fails or passes a base rule (too few words, or too many in repeated windows).  Failures are added up by
host; a beta prior fitted to all hosts' rates by moments shrinks each host's rate, and a host is rejected if even a
low posterior bound of its rate passes a limit.  The verdict is joined back to the host's documents.

Limit and deviations are chosen so that a verdict costs few clean documents: a host goes when more than half of what it has fails, which
the posterior has to say with three deviations to spare, so that a host of few documents is spared however bad they are.

Corner cases: a null text has no words and so fails; a null host is a host like any other; repeated ids and rows are
judged one by one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.memory import tidy
from tidelog.llm.shared import SPACE, free, materialize, work_dir

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Odd multipliers for windows of word numbers; two windows of one text share a hash by chance once in about 2**64 pairs.
MIX = np.random.default_rng(8).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes], window: int) -> int:
    """Words in windows found twice or more, the first included."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)
    if len(numbers) == len(words):
        return 0
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    n = len(ids) - window + 1
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h += ids[i : i + n] * MIX[i]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += found
    cover[window : window + n] -= found
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts_of(text: str | None, window: int = 8) -> tuple[int, int, int, int, int]:
    """The numbers of COUNTS for one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACE)), len(SYMBOLS.findall(text)), dup, repeated_words(words, window)


def judge_documents(docs: DataFrame, host: str = "source", least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """(doc_id, host, counts, base_failed) of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts_of(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5))], names=["doc_id", "host", *COUNTS])

    found = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text")).mapInArrow(tidy(each), "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.withColumn("base_failed", failed(least_words, repeat_percent))


def failed(least_words: int = 20, repeat_percent: int = 30):
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def keep_good(spark: SparkSession, docs: DataFrame, host: str = "source", limit: float = 0.5, sigmas: float = 3.0, least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """The rows of docs that pass the base rules and come from hosts that aren't rejected.

    Each text is counted once: the rows are written with what the base rules say, and its hosts are judged from that.
    """
    folder, bad, rejected = work_dir(spark, "quality"), free(docs, "failed"), free(docs, "rejected")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [counts_of(t) for t in batch.column("text").to_pylist()]
            yield batch.append_column(bad, pa.array([n < least_words or 100 * repeated > repeat_percent * n for n, _, _, _, repeated in counts], pa.bool_()))

    judged = materialize(docs.mapInArrow(tidy(each), T.StructType([*docs.schema, T.StructField(bad, T.BooleanType())])), f"{folder}/judged")
    hosts = judge_hosts(judged.select(F.col(host).cast("string").alias("host"), F.col(bad).alias("base_failed")), limit, sigmas).where("rejected")
    hosts = materialize(hosts.select(F.col("host").alias(rejected)), f"{folder}/rejected")
    return judged.where(~F.col(bad)).drop(bad).join(hosts, F.col(host).cast("string").eqNullSafe(F.col(rejected)), "left_anti")


def judge_hosts(judged: DataFrame, limit: float = 0.5, sigmas: float = 3.0) -> DataFrame:
    """(host, rejected): the posterior mean less ``sigmas`` posterior deviations passes ``limit``.

    The prior's mean and strength come from the hosts' rates: their variance beyond what the binomial explains.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k"))
    rate = F.col("k") / F.col("n")
    m = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * rate * rate).alias("s2")).first()
    mean = ((m["k"] or 0) + 0.5) / ((m["n"] or 0) + 1.0)
    strength = 50.0
    if m["n"] and m["hosts"] > 1:
        between = m["s2"] - m["n"] * (m["k"] / m["n"]) ** 2  # weighted squares around the mean
        expected = (m["hosts"] - 1) * mean * (1 - mean)
        excess = (between - expected) / max(m["n"] - m["nn"] / m["n"], 1e-9)
        strength = min(max(mean * (1 - mean) / excess - 1, 2.0), 1000.0) if excess > 0 else 1000.0
    a, b = F.col("k") + mean * strength, F.col("n") - F.col("k") + (1 - mean) * strength
    bound = a / (a + b) - sigmas * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", (bound > limit).alias("rejected"))


def judge(spark: SparkSession, docs: DataFrame, host: str = "source", limit: float = 0.5, sigmas: float = 3.0) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every document."""
    judged = materialize(judge_documents(docs, host), f"{work_dir(spark, 'quality')}/judged")
    hosts = judge_hosts(judged, limit, sigmas).withColumnRenamed("host", "h")
    out = judged.join(hosts, judged.host.eqNullSafe(hosts.h), "left")
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"))
