"""Small files in the store that holds the tables, whichever file system that is."""

from __future__ import annotations

from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """Names and texts below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._root = spark._jvm, root
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def paths(self, pattern: str) -> list[str]:
        """Paths below the folder that match, relative to it."""
        base = self._fs.makeQualified(self._path("")).toString().rstrip("/") + "/"
        found = self._fs.globStatus(self._path(pattern)) or []
        return sorted(status.getPath().toString().removeprefix(base) for status in found)

    def create(self, name: str, text: str = "") -> bool:
        """Make a file that must not exist yet; says whether that worked."""
        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        source = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def seconds(self, name: str) -> float:
        """When a file was last changed, in seconds since 1970."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def set_seconds(self, name: str, seconds: int) -> None:
        """Date a file; an error if the store doesn't keep that."""
        self._fs.setTimes(self._path(name), seconds * 1000, -1)
        if int(self.seconds(name)) != seconds:
            raise RuntimeError(f"the store of {self._root} does not let files be dated")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}" if name else self._root)
