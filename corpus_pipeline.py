"""The corpus pipeline: documents to packed training sequences, a written table after each stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.memory import collect_heaps
from tidelog.llm.packing import pack_documents
from tidelog.llm.quality import keep_good
from tidelog.llm.shared import materialize, release, work_dir, work_dirs
from tidelog.llm.similar import keep_one
from tidelog.llm.suffix_array import without_repeats
from tidelog.llm.toxicity import keep_civil


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; learns from the labels outside fold 0."""
    return keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, of hosts that do."""
    return keep_good(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: operator 6's links, and shingles of five words with a similarity of 0.8 or more."""
    return keep_one(spark, docs, size=5, similarity=0.8, radius=3)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 bytes or more that an earlier one has."""
    return without_repeats(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the stage before has worked in.
_before: list[str] = []


def tidied(stage: Stage) -> Stage:
    """A stage that first removes what the one before it has worked in, unless ``docs`` still reads that: its result has been written.

    The executors' heaps are collected, too: the stage's workers need the memory that the one before it took.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_before, docs)
        collect_heaps(spark)
        there = set(work_dirs())
        out = stage(spark, docs, sf_dir)
        _before[:] = [d for d in work_dirs() if d not in there]
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [(f.__name__, tidied(f)) for f in (toxicity, quality, near_dedup, passages, packing)]
#: The stages learn, tokenise and sort suffixes, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each reads what the one before it has written."""
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
