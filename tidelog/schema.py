"""The tables of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: One version of a key; a null value is a tombstone.
ENTRY = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), True), T.StructField("sequence", T.LongType(), False)])
#: A workload: operations in the order of pos.
OPERATION = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), True)])
#: A row for each run of a store.
RUN = T.StructType([
    T.StructField("run_id", T.StringType(), False), T.StructField("level", T.IntegerType(), False), T.StructField("run_no", T.LongType(), False), T.StructField("count", T.LongType(), False),
    T.StructField("min_key", T.StringType(), False), T.StructField("max_key", T.StringType(), False), T.StructField("max_sequence", T.LongType(), False),
])
STATISTICS = T.StructType([
    *(T.StructField(n, T.LongType(), False) for n in ("sequence", "buffered", "buffer_capacity", "runs")),
    T.StructField("runs_per_level", T.MapType(T.IntegerType(), T.IntegerType()), False), T.StructField("wal_entries", T.LongType(), False), T.StructField("levels", T.IntegerType(), False), T.StructField("read_amplification", T.LongType(), False),
])
PUT, DELETE, GET = "put", "delete", "get"
