from tidelog.operators.merge import merge_runs
from tidelog.operators.replay import asof_reads, reads_map, sequenced, summary
from tidelog.schema import ENTRY, OPERATION


def run(spark, *rows):
    return spark.createDataFrame(rows, ENTRY)


def as_dict(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_newest_wins(spark):
    merged = merge_runs([run(spark, ("a", "new", 9), ("b", "kept", 4)), run(spark, ("a", "old", 1), ("c", "kept", 2))])
    assert as_dict(merged) == {"a": "new", "b": "kept", "c": "kept"}


def test_of_equal_sequences_the_newer_run_wins(spark):
    assert as_dict(merge_runs([run(spark, ("a", "newer", 5)), run(spark, ("a", "older", 5))])) == {"a": "newer"}


def test_tombstone_survives_unless_dropped(spark):
    runs = [run(spark, ("a", None, 9)), run(spark, ("a", "old", 1))]
    assert as_dict(merge_runs(runs)) == {"a": None}
    assert as_dict(merge_runs(runs, drop_tombstones=True)) == {}


def test_empty_value_is_live(spark):
    assert as_dict(merge_runs([run(spark, ("a", "", 2)), run(spark, ("a", "x", 1))], drop_tombstones=True)) == {"a": ""}


def test_keys_are_ordered_by_bytes(spark):
    df = spark.createDataFrame([(k,) for k in ("9", "10", "100", "2")], "key string")
    assert [r["key"] for r in df.sort("key").collect()] == ["10", "100", "2", "9"]


def test_one_shuffle_with_partial_aggregation(spark):
    plan = merge_runs([run(spark, ("a", "x", 1)), run(spark, ("b", "y", 2))])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_max_by" in plan


def test_sequences_have_no_gaps(spark):
    df = sequenced(spark.range(0, 5000, 7).withColumnRenamed("id", "pos").repartition(5), "pos", base=10)
    rows = df.orderBy("pos").collect()
    assert [r["sequence"] for r in rows] == list(range(11, 11 + len(rows)))


def test_workload(spark):
    ops = spark.createDataFrame([(1, "put", "a", "1"), (2, "get", "a", None), (3, "delete", "a", None), (4, "get", "a", None), (5, "get", "b", None), (6, "get", "c", None)], OPERATION)
    base = spark.createDataFrame([("a", "0"), ("b", "stored")], "key string, value string")
    reads = asof_reads(ops, base)
    assert {r["pos"]: r["value"] for r in reads.collect()} == {2: "1", 4: None, 5: "stored", 6: None}
    assert as_dict(reads_map(reads)) == {"a": None, "b": "stored", "c": None}
    assert tuple(summary(ops).first()) == (1, 1, 4, 6)
