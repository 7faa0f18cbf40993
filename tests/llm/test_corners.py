"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest

from tidelog.llm import neighbours, packing, pieces, quality, simhash, similar, suffix_array, suffix_tree, token_files, toxicity, urls

LONG = "word " * 40_000
ROWS = [
    (0, "the same passage that is long enough to be found twice in two documents, is it", "a"), (1, None, "a"), (2, "", None), (3, "   \n\t", "a"), (4, "é日本 word", "b"),
    (5, "X the same passage that is long enough to be found twice in two documents, is it", "b"), (6, LONG, "b"), (7, LONG, "b"), (7, LONG, "b"), (None, "a document without an id", "a"), (None, None, None),
]
#: Names that the operators use inside.
CLASHING = ["n_chars", "score", "key", "_node", "_same", "value", "host", "fp", "block", "part", "rank", "length", "start", "root", "node", "gram", "held_out", "kind", "data", "path", "size", "rejected", "count", "_md5", "_key", "_id", "_host", "_bad", "_block", "failed", "_failed", "_rejected", "same", "rows", "toxic", "view", "fps"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHING)
    return spark.createDataFrame([(*r, *[9] * len(CLASHING)) for r in ROWS], schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 0, 1), (0, 0, 0), (4, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")


def tokenizer(name):
    return public_tokenizers.path(name)


def operators(spark, docs, labels):
    return {
        "token_files": lambda: token_files.token_file_digest(spark, docs, tokenizer("word_bpe_49k.json")),
        "suffix_tree": lambda: suffix_tree.score_documents(spark, docs),
        "suffix_array": lambda: suffix_array.removal_digest(spark, docs),
        "simhash": lambda: simhash.near_duplicates(spark, docs),
        "toxicity": lambda: toxicity.toxicity(spark, docs, labels),
        "quality": lambda: quality.judge(spark, docs),
        "pieces": lambda: pieces.nbest_segmentations(docs, tokenizer("piece_bpe_32k.model")),
    }


NAMES = ["token_files", "suffix_tree", "suffix_array", "simhash", "toxicity", "quality", "pieces"]
STAGES = {
    "toxicity": lambda spark, docs, labels: toxicity.keep_civil(docs, labels),
    "quality": lambda spark, docs, labels: quality.keep_good(spark, docs),
    "near_dedup": lambda spark, docs, labels: similar.keep_one(spark, docs),
    "passages": lambda spark, docs, labels: suffix_array.without_repeats(spark, docs),
}


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(spark, docs, labels, name):
    rows = operators(spark, docs, labels)[name]().collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if name != "pieces" or r["rank"] == 1)
    assert ids == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, docs, labels, name):
    assert operators(spark, docs.limit(0), labels.limit(0))[name]().collect() == []


@pytest.mark.parametrize("name", list(STAGES))
def test_stages(spark, docs, labels, name):
    kept = STAGES[name](spark, docs, labels)
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    rows = kept.collect()
    wanted = {"toxicity": 11, "quality": 0, "near_dedup": 5, "passages": 11}
    assert len(rows) == wanted[name] and all(r["rank"] == 9 for r in rows)
    assert STAGES[name](spark, docs.limit(0), labels).collect() == []


def test_what_stays_of_groups(spark, docs):
    assert sorted(r["doc_id"] for r in similar.keep_one(spark, docs).where("doc_id is not null").collect()) == [0, 1, 4, 6]  # 5 is close to 0, and texts without words are one group


def test_packing(spark, docs):
    rows = packing.pack_documents(spark, docs, tokenizer("byte_bpe_50k.json"), size=2048).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS) and all(1 <= r["length"] <= 2048 - r["offset"] for r in rows)
    assert packing.pack_documents(spark, docs.limit(0), tokenizer("byte_bpe_50k.json")).collect() == []


def test_urls(spark):
    given = [(1, None), (2, "no scheme"), (3, "http://"), (4, "http://A.ORG?x"), (5, "x://b.example.ORG/es/a#f"), (6, "http://example.org/en/12?q"), (7, "http://com/de/"), (7, "http://com/de/"), (None, "http://É.net/p")]
    pages = spark.createDataFrame([(*g, "h", "d") for g in given], "page_id long, url string, host string, domain string")
    rows = {r["page_id"]: tuple(r)[1:4] for r in urls.judge_urls(spark, pages, urls.RULES).collect()}
    assert rows == {
        1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("a.org", "", None), 5: ("b.example.org", "/es/a", "example.org/es/"), 6: ("example.org", "/en/12", "example.org/en/1"),
        7: ("com", "/de/", "com/de/"), None: ("É.net", "/p", None),
    }
    assert urls.judge_urls(spark, pages, urls.RULES).count() == 9 and urls.judge_urls(spark, pages.limit(0), urls.RULES).count() == 0


def test_neighbours(spark):
    given = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.6, 0.8]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (40, None)]
    vectors = spark.createDataFrame([(*g, 1) for g in given], "vec_id long, embedding array<float>, rep int")
    rows = sorted(tuple(r) for r in neighbours.nearest(spark, vectors).collect())
    assert [r[:3] for r in rows] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert neighbours.nearest(spark, vectors.limit(0)).collect() == []
