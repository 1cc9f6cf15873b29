"""Files through Hadoop's FileSystem, so that a store may lie on any of them."""

from __future__ import annotations

import os
import posixpath
import uuid
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

join = posixpath.join
#: bytes that pass between Python and the JVM at once
PIECE = 4 << 20


def encode(name: str) -> str:
    """A topic or partition name as one path element."""
    return quote(name, safe="").replace(".", "%2E") or "%00"


def decode(name: str) -> str:
    return "" if name == "%00" else unquote(name)


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def walk(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of the files below."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toString(), s.getLen()))
        return out

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            left, parts = fs.getFileStatus(p).getLen(), []
            while left:  # in pieces, as each passes through the JVM as text
                parts.append(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(left, PIECE))))
                left -= len(parts[-1])
            return b"".join(parts).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            self._put(stream, text)
        finally:
            stream.close()

    @staticmethod
    def _put(stream, text: str) -> None:
        data = text.encode()
        for at in range(0, len(data), PIECE):
            stream.write(bytearray(data[at : at + PIECE]))

    def publish(self, path: str, text: str) -> bool:
        """Write a new file so that it appears whole or not at all; False if it is already there.

        Of two writers one wins: on a local file system the name is linked to
        the written file, which fails if it is taken; on HDFS a rename does; an
        object store creates the file conditionally when it is closed.
        """
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        scheme = fs.getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            return self._create(fs, p, text)
        temporary = f"{posixpath.dirname(path)}/.{posixpath.basename(path)}.{uuid.uuid4().hex}.tmp"
        self.write(temporary, text)
        _, t = self._at(temporary)
        try:
            if scheme == "file":
                os.link(t.toUri().getPath(), p.toUri().getPath())
                return True
            return fs.rename(t, p)
        except FileExistsError:
            return False
        finally:
            fs.delete(t, False)

    def _create(self, fs, p, text: str) -> bool:
        try:
            stream = fs.createFile(p).overwrite(False).recursive().opt("fs.option.create.conditional.overwrite", True).build()
            self._put(stream, text)
            stream.close()
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise OSError(f"can't write {p}") from e
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
