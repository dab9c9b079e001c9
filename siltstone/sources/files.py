"""Small metadata files on whatever file system the cluster shares."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

from siltstone.errors import StorageError


class Files:
    """Hadoop file system calls of the driver, for paths under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def mkdirs(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def read_json(self, name: str) -> Any:
        stream = self._fs.open(self._path(name))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError as e:
            raise StorageError(f"{name} is damaged: {e}") from None

    def write_json(self, name: str, value: Any) -> None:
        """By a temporary file and a rename that replaces, so that a reader sees the old one or the new one, whenever the writer dies."""
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(temporary), True)
        try:
            stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
        finally:
            stream.close()
        self._replace(temporary, name)

    def _replace(self, old: str, new: str) -> None:
        """One rename over what is there."""
        fs = self._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._path("").toUri() if self._path("").toUri().getScheme() else self._fs.getUri(), self._fs.getConf())
        # The enumeration is nested, so it is reached by its loaded class.
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(kind, 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        context.rename(self._path(old), self._path(new), options)

    def clear_temporary(self, name: str = "") -> None:
        """Remove what writers that died left behind."""
        for n in self.names(name):
            if n.endswith(".tmp"):
                self.delete(f"{name}/{n}" if name else n)
