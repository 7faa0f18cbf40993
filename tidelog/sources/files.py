"""Small files through Hadoop's file systems, so a store may lie wherever Spark can read."""

from __future__ import annotations

import uuid
from typing import Any

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Reads, lists and publishes files under any URI that the session knows."""

    def __init__(self, spark: SparkSession):
        self.gateway, self.jvm, self.conf = spark.sparkContext._gateway, spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def make(self, path: str) -> None:
        self._fs(path).mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path))) if self.exists(path) else []

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        now = self.jvm.java.lang.System.currentTimeMillis()
        return (now - self._fs(path).getFileStatus(self._path(path)).getModificationTime()) / 1000

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files below a folder."""
        return self._fs(path).getContentSummary(self._path(path)).getLength()

    def read(self, path: str) -> bytes:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_at(self, path: str, offset: int, length: int) -> bytes | None:
        """Some bytes of a file, without reading the rest; null if it isn't there or ends before them."""
        try:
            stream = self._fs(path).open(self._path(path))
            try:
                stream.seek(offset)
                found = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
            finally:
                stream.close()
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() in ("FileNotFoundException", "EOFException"):
                return None
            raise
        return found if len(found) == length else None

    def stream(self, path: str) -> Any:
        """A Java output stream to a new file whose ``hflush`` and ``hsync`` take effect at once, local files included."""
        fs = self._fs(path)
        if is_instance_of(self.gateway, fs, "org.apache.hadoop.fs.ChecksumFileSystem"):
            fs = fs.getRawFileSystem()  # one with checksums holds back what doesn't fill a chunk
        return fs.create(self._path(path), True)

    def write(self, path: str, data: bytes) -> None:
        stream = self._fs(path).create(self._path(path), True)
        try:
            stream.write(bytearray(data))
            stream.hflush()
        finally:
            stream.close()

    def publish(self, path: str, data: bytes) -> bool:
        """Write a file whole or not at all; false if there is one of that name already."""
        if self.exists(path):
            return False
        parent, _, name = path.rpartition("/")
        temporary = f"{parent}/.{name}.{uuid.uuid4().hex}"
        self.write(temporary, data)
        try:
            return self.rename(temporary, path)
        finally:
            self.delete(temporary)

    def rename(self, path: str, to: str) -> bool:
        """Move a file; false if the target is there already, or the file isn't any more."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs(path).getUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._path(path), self._path(to), none)
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "FileNotFoundException"):
                return False
            raise

    def delete(self, path: str) -> bool:
        return self._fs(path).delete(self._path(path), True)
