"""Documents as blocks: files of a few megabytes of text that later passes read whole, each by its number.

Several operators look at every text more than once and, in between, have to learn something about what is in it from
all other texts.  They write the documents once as blocks.  A pass over the blocks sends keys, packed and sorted out
by bucket; a bucket's task sees a key's rows from all blocks and answers each block; the next pass reads a block along
with the answers to it.  So only keys and answers are shuffled, never texts, and any task can be run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidelog.llm.memory import tidy
from tidelog.llm.shared import filesystem, materialize

#: Bytes of text in a block; a longer document is a block of its own.  Larger for larger clusters: buckets times blocks
#: is the number of packed rows in a shuffle.
BLOCK_BYTES = 4 << 20
MANIFEST = "block long, path string, n_docs long, n_bytes long"


def write_blocks(docs: DataFrame, uri: str, block_bytes: int = BLOCK_BYTES, kept: Callable[[pa.Table], pa.Table] = lambda table: table) -> DataFrame:
    """Write (text, ...) rows as blocks and return their manifest; every row is in exactly one block, of which ``kept`` is written.

    A file's name is unique to an attempt of a task; only what finished attempts name is in the manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0
        out: list[dict] = []

        def flush() -> None:
            nonlocal held, size, number
            fs, path = filesystem(name := f"{uri}/block-{part:06d}-{number:06d}-{uuid.uuid4().hex}.arrow")
            whole = pa.Table.from_batches(held)
            table = kept(whole)
            with fs.open_output_stream(path) as sink, pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            out.append({"block": (part << 32) + number, "path": name, "n_docs": whole.num_rows, "n_bytes": size})
            held, size, number = [], 0, number + 1

        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
            at = 0
            for i, n in enumerate(sizes):
                if size and size + n > block_bytes:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    flush()
                    at = i
                size += n
            if at < len(sizes):
                held.append(batch.slice(at))
        if held:
            flush()
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_bytes", pa.int64())]))

    import pyarrow.compute  # noqa: F401  before the function is sent

    return materialize(docs.mapInArrow(tidy(write), MANIFEST), f"{uri}/manifest")


def read_block(path: str) -> pa.Table:
    fs, inside = filesystem(path)
    with fs.open_input_file(inside) as source:
        return pa.ipc.open_file(source).read_all().combine_chunks()


def spread(manifest: DataFrame) -> tuple[DataFrame, int]:
    """The manifest with a block to a task, and the number of blocks."""
    n = manifest.count()
    return manifest.repartition(max(1, n)), n
