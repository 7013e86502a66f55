"""Small files and folders on any file system that the session's Hadoop configuration reaches."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Files:
    """Access to one folder, by paths relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = str(root).rstrip("/")

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _system(self):
        return self._path().getFileSystem(self._conf)

    def exists(self, name: str = "") -> bool:
        return self._system().exists(self._path(name))

    def names(self) -> list[str]:
        """Names in the folder, sorted; none if it doesn't exist."""
        return sorted(s.getPath().getName() for s in self._system().listStatus(self._path())) if self.exists() else []

    def read(self, name: str) -> str | None:
        """The text of a file; null if it doesn't exist."""
        if not self.exists(name):
            return None
        stream = self._system().open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Writes a file beside its place and renames it over, so that readers see the old text or the new."""
        waiting = f"_{name}.new"
        stream = self._system().create(self._path(waiting), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = SparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._path(waiting), self._path(name), options)

    def delete(self, name: str) -> None:
        self._system().delete(self._path(name), True)
