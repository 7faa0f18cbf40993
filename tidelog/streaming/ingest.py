"""Structured Streaming into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.engine import Engine
from tidelog.operators.replay import mutations


def ingest_stream(engine: Engine, ops: DataFrame, checkpoint: str, name: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of operations (pos, op, key, value) becomes one run named after the query and the batch.

    The manifest keeps the last batch of each query's name, so a batch that runs again after a crash does nothing, whatever has been merged since.
    ``once``: take what there is and end.
    """

    def batch(df: DataFrame, number: int) -> None:
        engine.ingest(mutations(df).select("pos", "key", "value"), once=f"{name}-{number:012d}")

    writer = ops.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_operations(events: DataFrame) -> DataFrame:
    """The workload that an events table describes: errors delete, views get, the others put."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    op = F.when(kind == "error", "delete").when(kind == "view", "get").otherwise("put")
    value = F.when(~kind.isin("error", "view"), F.concat(kind, F.lit(":"), number))
    return events.select(F.col("event_id").alias("pos"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), value.alias("value"))
