"""What the operators share: the shared folder, files in it, and small column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words everywhere here: the space and \\t \\n \\v \\f \\r, as ``bytes.split()`` has them.
SPACE = " \t\n\x0b\x0c\r"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; a plain path is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _remove(uri: str) -> None:
    try:
        fs, path = filesystem(uri)
        fs.delete_dir(path)
    except OSError:
        pass


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one is set only where it is unset and there is no cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        atexit.register(_remove, root)
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


#: Work folders of this driver that are still there, in the order of their making.
_MADE: list[str] = []


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one.  It stays until the driver's Python ends, as results read it lazily, or until it is released."""
    uri = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
    atexit.register(_remove, uri)
    _MADE.append(uri)
    return uri


def work_dirs() -> list[str]:
    return list(_MADE)


def release(uris: list[str], reader: DataFrame) -> None:
    """Remove work folders, but not those that ``reader`` still reads."""
    files = reader.inputFiles() if uris else []
    for uri in uris:
        if uri in _MADE and not any(uri.rsplit("/", 1)[-1] in f for f in files):
            _MADE.remove(uri)
            _remove(uri)


def materialize(df: DataFrame, uri: str) -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text) with a null text as an empty one; the columns named in ``more`` follow."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def free(df: DataFrame, name: str) -> str:
    """The name, with as many marks before it as it takes to be no column's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod5(doc_id="doc_id"):
    """crc32 of the id as decimal text, mod 5: the folds of the contracts."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))
