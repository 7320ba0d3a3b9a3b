"""Small driver-side file operations on whatever file system a path names, through Hadoop's API."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset and all runs on one machine, as in tests, a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidekeep-")
    return folder


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def is_directory(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def make_directory(self, path: str) -> bool:
        """True if the directory is there afterwards; a file in its place gives False."""
        if self.exists(path):
            return self.is_directory(path)
        p, fs = self._at(path)
        return fs.mkdirs(p)

    def remove(self, path: str) -> bool:
        """Whether there was something to remove."""
        p, fs = self._at(path)
        return fs.exists(p) and fs.delete(p, True)

    def list(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def count_numbered(self, path: str) -> int:
        """Files whose name is digits and .txt."""
        return sum(1 for name in self.list(path) if name.endswith(".txt") and name[:-4].isascii() and name[:-4].isdigit())

    def read_text(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Readers see the old text or the new one, never a part."""
        p, fs = self._at(path)
        tmp = self._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        self._jvm.java.lang.reflect.Array.set(options, 0, self._jvm.java.lang.Enum.valueOf(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.isAbsolute() and p.toUri().getScheme() else fs.getUri(), self._conf)
        context.rename(fs.makeQualified(tmp), fs.makeQualified(p), options)
