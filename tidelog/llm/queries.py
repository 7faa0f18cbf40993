"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.oracles import OP5, OP9


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document in Arrow stream files, read back."""
    from tidelog.llm.token_files import token_file_digest

    return token_file_digest(spark, _table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a suffix tree learnt from four folds."""
    from tidelog.llm.suffix_tree import score_documents

    return score_documents(spark, _table(spark, sf_dir, "documents"), held_out_fold=1)


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    from tidelog.llm.suffix_array import removal_digest

    return removal_digest(spark, _table(spark, sf_dir, "documents"))


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    from tidelog.llm.packing import pack_documents

    return pack_documents(spark, _table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0, size=2048)


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the contract's rules and its host's reputation."""
    from tidelog.llm.urls import RULES, judge_urls

    return judge_urls(spark, _table(spark, sf_dir, "pages"), RULES)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and their components."""
    from pyspark.sql import functions as F

    from tidelog.llm.simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(spark, _table(spark, sf_dir, "documents"), size=3, radius=3)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    from tidelog.llm.quality import judge

    return judge(spark, _table(spark, sf_dir, "documents"))


def op7_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every twentieth embedding."""
    from tidelog.llm.neighbours import nearest

    return nearest(spark, _table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    from tidelog.llm.toxicity import toxicity

    return toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document."""
    from tidelog.llm.pieces import nbest_segmentations

    return nbest_segmentations(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), n=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_suffix_tree, op3_suffix_array, op4_best_two_fit, op5_host_reputation, op6_simhash, op7_projection_forest, op8_toxicity, op9_host_quality, op10_nbest_pieces)}
ORACLE_SQL: dict[str, str] = {"op5_host_reputation": OP5, "op9_host_quality": OP9}
