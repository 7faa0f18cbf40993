import pytest
from pyspark.sql import functions as F

from tidelog.errors import MalformedOperationError, UnreadableSourceError
from tidelog.functions.parsing import PARSERS, parser_for
from tidelog.sources.operations import ArraySource, TextSource


def parse(spark, format, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [tuple(r["p"]) for r in df.select("i", PARSERS[format](F.col("line")).alias("p")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("value", "wanted"),
    [('"v"', "v"), ('""', ""), ("true", "1"), ("false", ""), ("1.0", "1"), ("1.50", "1.5"), ("12", "12"), ("100", "100"), ("-0.25", "-0.25"), ('"1.0"', "1.0"), ('"true"', "true")],
)
def test_json_scalars(spark, value, wanted):
    assert parse(spark, "jsonl", f'{{"type":"put","key":"k","value":{value}}}') == [(False, "put", "k", wanted, None)]


@pytest.mark.parametrize("value", ["null", "[1]", '{"a":1}'])
def test_json_without_a_scalar(spark, value):
    assert parse(spark, "json", f'{{"type":"put","key":"k","value":{value}}}')[0][4] == "a put needs a value"


def test_json_lines(spark):
    deep = '{"type":"get","key":"k","x":' + "[" * 8 + "]" * 8 + "}"
    fine = '{"type":"get","key":"k","x":' + "[" * 7 + "]" * 7 + ',"y":"[[[[[[[[["}'
    rows = parse(spark, "ndjson", "", "  ", ' {"type":" PUT ","key":" k ","value":"v"} ', "{not json", '{"key":"k"}', deep, fine)
    assert rows[0][0] and rows[1][0] and rows[2] == (False, "put", " k ", "v", None)
    assert [r[4] for r in rows[3:]] == ["not valid JSON", "type and key are needed", "nested too deeply", None]


def test_separated_lines(spark):
    rows = parse(spark, "csv", "type,key,value", "", " Put , a ,x,more", 'put,a,"x, ""y"""', "delete,a,", "put,a,", "put,,x", "upsert,a,x", "put,a,back\\slash")
    assert [r[0] for r in rows] == [True, True] + [False] * 7
    assert rows[2][1:] == ("put", "a", "x", None) and rows[3][3] == 'x, "y"' and rows[4][1:] == ("delete", "a", None, None)
    assert [r[4] for r in rows[5:8]] == ["a put needs a value", "the key is missing", "unknown operation upsert"] and rows[8][3] == "back\\slash"
    assert parse(spark, "tsv", "put\ta\tx,y")[0][1:] == ("put", "a", "x,y", None)


def test_formats(spark):
    assert parser_for("a/B.JSONL") is PARSERS["jsonl"] and parser_for("x.tsv") is PARSERS["tsv"]
    with pytest.raises(UnreadableSourceError):
        parser_for("a.xlsx")


def test_lines_are_numbered_and_a_bad_one_stops_all(spark, tmp_path):
    path = tmp_path / "ops.jsonl"
    path.write_text("\n".join(['{"type":"put","key":"a","value":"1"}', "", '{"type":"get","key":"a"}']) + "\n")
    assert [tuple(r) for r in TextSource(spark, str(path)).operations().orderBy("pos").collect()] == [(1, "put", "a", "1"), (3, "get", "a", None)]
    path.write_text("\n".join(['{"type":"get","key":"a"}'] * 6 + ["{not json"]))
    with pytest.raises(MalformedOperationError, match="line 7: not valid JSON"):
        TextSource(spark, str(path)).operations()
    with pytest.raises(UnreadableSourceError):
        TextSource(spark, str(tmp_path / "missing.csv")).operations()


def test_order_of_a_file_in_many_blocks(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("".join(f"put,k,{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = TextSource(spark, str(path)).operations().orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["pos"] for r in rows] == list(range(1, 20_001)) and [int(r["value"]) for r in rows] == list(range(20_000))


def test_array_source(spark):
    assert ArraySource(spark, [("put", "a", "1"), (" GET ", "a")]).operations().count() == 2
    for bad in (("upsert", "a"), ("put", "a"), ("get", "")):
        with pytest.raises(ValueError):
            ArraySource(spark, [bad])
