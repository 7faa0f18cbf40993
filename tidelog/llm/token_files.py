"""Token ids in Arrow stream files of fixed-size-list batches.

A token file holds one stream of ids, cut into sequences of ``length`` ids.  Each record batch has ``ROWS`` sequences
in two columns, ``ids`` (fixed-size list of unsigned 16- or 32-bit integers) and ``mask`` (fixed-size list of
booleans, false on the padding after the last id).  As every batch but the last has the same shape, sequence *i* is
row *i % ROWS* of batch *i // ROWS*: a reader maps the file and slices it without copying.  A second stream beside it
(``.docs``) has each document's id, first token and number of tokens.

Corner cases: a null or empty text is the end id alone; null ids of documents come first; repeated ids and rows stay
rows of their own, in no fixed order among themselves; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.memory import tidy
from tidelog.llm.shared import filesystem, materialize, texts, work_dir
from tidelog.llm.tokens import encoder

#: Sequences in a record batch.
ROWS = 128
MANIFEST = "part int, path string, n_docs long, n_tokens long, width int"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class TokenWriter:
    """Writes a token file; holds one batch of sequences at most."""

    def __init__(self, uri: str, length: int, width: int):
        fs, path = filesystem(uri)
        self.length, self.type = length, {2: pa.uint16(), 4: pa.uint32()}[width]
        self.schema = pa.schema([("ids", pa.list_(self.type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sinks = [fs.open_output_stream(path), fs.open_output_stream(f"{path}.docs")]
        self.out, self.docs_out = pa.ipc.new_stream(self.sinks[0], self.schema), pa.ipc.new_stream(self.sinks[1], DOCS)
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_tokens = self.n_docs = 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_tokens, len(ids)))
        self.n_docs += 1
        self.n_tokens += len(ids)
        self.pending.append(ids.astype(self.type.to_pandas_dtype()))
        self.n_pending += len(ids)
        if self.n_pending >= ROWS * self.length:
            self._flush(False)
        if len(self.docs) >= 1 << 16:
            self._flush_docs()

    def _flush(self, last: bool) -> None:
        ids, step = np.concatenate(self.pending) if self.pending else np.zeros(0, self.type.to_pandas_dtype()), ROWS * self.length
        for at in range(0, len(ids) if last else len(ids) - step + 1, step):
            part = ids[at : at + step]
            full = -(-len(part) // self.length) * self.length
            mask = np.arange(full) < len(part)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(np.pad(part, (0, full - len(part)))), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
            self.out.write_batch(pa.record_batch(arrays, schema=self.schema))
        rest = ids[:0] if last else ids[len(ids) // step * step :]
        self.pending, self.n_pending = [rest], len(rest)

    def _flush_docs(self) -> None:
        if self.docs:
            self.docs_out.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in zip(*self.docs)], schema=DOCS))
            self.docs = []

    def close(self) -> None:
        self._flush(True)
        self._flush_docs()
        for x in (self.out, self.docs_out, *self.sinks):
            x.close()


class TokenFile:
    """Random access to a token file, without copies where the file is local."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        source = pa.memory_map(path) if local else fs.open_input_file(path)
        stream = pa.ipc.open_stream(source)
        self.batches = list(stream)
        self.length = stream.schema.field("ids").type.list_size
        self.docs = pa.ipc.open_stream(pa.memory_map(f"{path}.docs") if local else fs.open_input_file(f"{path}.docs")).read_all()

    def __len__(self) -> int:
        return sum(len(b) for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a sequence; the ids are a view of the file."""
        b, row = self.batches[i // ROWS], i % ROWS
        at = row * self.length
        return self._flat(i // ROWS)[at : at + self.length], b.column(1).values[at : at + self.length].to_numpy(zero_copy_only=False)

    def _flat(self, batch: int) -> np.ndarray:
        return self.batches[batch].column(0).values.to_numpy()

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views that together are the ids [start, start + n) of the stream."""
        step = ROWS * self.length
        while n > 0:
            part = self._flat(start // step)[start % step : start % step + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int, length: int = 2048) -> DataFrame:
    """Encode every text, append the end id, and write the ids in ascending doc_id order; returns the manifest.

    The documents are dealt out by ranges of doc_id, sorted within them, and each task streams its range into a file of
    its own.  A name is unique to an attempt, and only what a finished attempt names enters the manifest, so a task
    that is run again leaves no wrong file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, enc = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                enc = encoder(tokenizer_path)
                width = 2 if max(enc.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
                out = TokenWriter(path := f"{uri}/shard-{part:06d}-{uuid.uuid4().hex}.arrows", length, width)
            for at in range(0, len(batch), 256):
                piece = batch.slice(at, 256)
                for doc_id, ids in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist())):
                    out.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": out.n_docs, "n_tokens": out.n_tokens, "width": width}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(tidy(write, "tokens"), MANIFEST), f"{uri}/manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; start counts over all files."""
    shards = sorted(manifest.select("part", "path", "n_tokens").collect())  # a row for each file
    starts = np.cumsum([0, *(s.n_tokens for s in shards)]).tolist()
    rows = [(at, s.path) for at, s in zip(starts, shards)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, path in zip(*(c.to_pylist() for c in batch.columns)):
                f = TokenFile(path)
                for docs in f.docs.to_batches(max_chunksize=1 << 16):
                    crcs = []
                    for start, n in zip(docs["start"].to_pylist(), docs["n_tokens"].to_pylist()):
                        crc = 0
                        for ids in f.tokens(start, n):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    starts = pa.array(docs["start"].to_numpy() + first)
                    yield pa.record_batch([docs["doc_id"], starts, docs["n_tokens"], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "first long, path string")
    return (listed.repartition(max(1, len(rows))) if rows else listed).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write the token files in the shared folder and read each document back."""
    return read_token_files(spark, write_token_files(docs, work_dir(spark, "tokens"), tokenizer_path, end_id, length))
