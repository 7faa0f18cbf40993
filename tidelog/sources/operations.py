"""Sources of operations: tables with pos, op, key and value."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import InvalidKeyError, MalformedOperationError, UnreadableSourceError
from tidelog.functions.parsing import OPERATIONS, PARSERS, parser_for
from tidelog.schema import GET, OPERATION, PUT


def checked(op: str, key: str, value: str | None = None) -> tuple[str, str, str | None]:
    """One operation, if it is a sound one."""
    op = op.strip().lower()
    if op not in OPERATIONS:
        raise MalformedOperationError(f"unknown operation {op}")
    if key == "":
        raise InvalidKeyError("the key is empty")
    if op == PUT and value is None:
        raise MalformedOperationError("a put needs a value")
    return op, key, value if op == PUT else None


class ArraySource:
    """Operations in memory."""

    def __init__(self, spark: SparkSession, operations: Iterable[tuple]):
        self.spark, self.rows = spark, [checked(*o) for o in operations]

    def describe(self) -> str:
        return f"{len(self.rows)} operations in memory"

    def operations(self) -> DataFrame:
        return self.spark.createDataFrame([(i, *row) for i, row in enumerate(self.rows, 1)], OPERATION)


class TextSource:
    """Operations in text files that Spark reads, local or remote, parsed by the path's extension or a named format.

    Lines are parsed in the tasks that read them, once, and written below ``work``; everything else reads what was written.  Without a folder
    they are parsed again for each look at them.
    """

    def __init__(self, spark: SparkSession, path: str, format: str | None = None, work: str | None = None):
        self.spark, self.path, self.work = spark, path, work
        self.parse = PARSERS[format] if format else parser_for(path)
        self._held: DataFrame | None = None

    def describe(self) -> str:
        return self.path

    def _read(self, *columns: Column) -> DataFrame:
        """(file, block, i, ...): within a block of a file ids rise with the lines, one by one."""
        try:
            return self.spark.read.text(self.path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), *columns)
        except AnalysisException as e:
            raise UnreadableSourceError(f"{self.path} can't be read: {str(e).splitlines()[0]}") from e

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """With pos, the number of the line: blocks follow each other by file and start; a row for each block comes to the driver."""
        blocks = sorted((r["file"], r["block"], r["first"], r["n"]) for r in rows.groupBy("file", "block").agg(F.min("i").alias("first"), F.count("*").alias("n")).collect())
        shifts, at = [], 1
        for file, block, first, n in blocks:
            shifts.append((file, block, at - first))
            at += n
        table = self.spark.createDataFrame(shifts, "file string, block long, shift long")
        return rows.join(F.broadcast(table), ["file", "block"]).withColumn("pos", F.col("i") + F.col("shift")).drop("file", "block", "i", "shift")

    def lines(self) -> DataFrame:
        """(pos, line): pos counts lines from 1, in the order of the files' names and places in them."""
        return self._numbered(self._read(F.col("value").alias("line"))).select("pos", "line")

    def parsed(self) -> DataFrame:
        """(pos, op, key, value, error) of all lines that aren't skipped."""
        if self._held is None:
            rows = self._read(self.parse(F.col("value")).alias("p")).select("file", "block", "i", "p.*")
            if self.work:
                path = f"{self.work}/imports/{uuid.uuid4().hex}"
                rows.write.parquet(path)
                rows = self.spark.read.schema(rows.schema).parquet(path)
            self._held = self._numbered(rows)
        return self._held.where("not skip").select("pos", "op", "key", "value", "error")

    def operations(self) -> DataFrame:
        """All operations, if every line is sound; else the first bad line is raised and nothing has been applied."""
        parsed = self.parsed()
        bad = parsed.where("error is not null").orderBy("pos").select("pos", "error").first()
        if bad is not None:
            raise MalformedOperationError.at_line(self.path, bad["pos"], bad["error"])
        return parsed.select("pos", "op", "key", F.when(F.col("op") != GET, F.col("value")).alias("value"))
