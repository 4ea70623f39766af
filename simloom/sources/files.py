"""Small files and folders in whatever file system a path names, through Hadoop's API."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str, fsync: bool = True):
        self._jvm, self.fsync = spark._jvm, fsync
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        return sorted(self.sizes(name))

    def sizes(self, name: str = "") -> dict[str, int]:
        """The entries of a folder and their lengths."""
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(self.at(name)))} if self.exists(name) else {}

    def mkdirs(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(self.at(name)))

    def rename(self, a: str, b: str) -> None:
        """``b`` must not exist: then a rename is one step in file systems that have it."""
        if self.exists(b) or not self._fs.rename(self._path(self.at(a)), self._path(self.at(b))):
            raise OSError(f"cannot rename {a} to {b}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(self.at(name))).getLength() if self.exists(name) else 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def tail(self, name: str, n: int) -> bytes:
        """The last ``n`` bytes of a file, or all it has."""
        size = self._fs.getFileStatus(self._path(self.at(name))).getLen()
        stream = self._fs.open(self._path(self.at(name)))
        try:
            stream.seek(max(0, size - n))
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file, whole or not there at all: written beside, then renamed. What exists is never written over."""
        stream = self._fs.create(self._path(self.at(f"{name}.tmp")), True)
        stream.write(bytearray(text.encode()))
        if self.fsync:
            stream.hsync()
        stream.close()
        self.rename(f"{name}.tmp", name)
