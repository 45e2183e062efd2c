"""Small control files of a table, read and written by the driver through Hadoop's file systems."""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

from pyspark.sql import SparkSession


def opened(uri: str):
    """A pyarrow file system and the path on it, for tasks; a path without a scheme is local."""
    from pyarrow import fs

    if uri.startswith("file:") or ":/" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(quote(uri, safe=":/=@"))


class Folder:
    """A folder that holds manifests and pointers; data files never pass through here."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        target = self._hadoop.Path(path)
        conf = spark._jsc.hadoopConfiguration()
        self._fs = target.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._gateway = spark.sparkContext._gateway
        self._bytes = spark._jvm.org.apache.commons.io.IOUtils

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}") if name else self._hadoop.Path(self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in the folder or in `name` below it, none where that is missing."""
        target = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(target)) if self._fs.exists(target) else []

    def read(self, name: str) -> str | None:
        """The text of a file, null where there is none."""
        target = self._at(name)
        if not self._fs.exists(target):
            return None
        stream = self._fs.open(target)
        try:
            return bytes(self._bytes.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = False) -> None:
        """Put a whole file in place by a rename; without `replace` a taken name is an error."""
        draft = self._at(f".{name.replace('/', '_')}-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._at(name).getParent())
        stream = self._fs.create(draft, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        kinds = getattr(self._hadoop, "Options$Rename")
        options = self._gateway.new_array(kinds, 1 if replace else 0)
        if replace:
            options[0] = kinds.OVERWRITE
        try:
            self._context.rename(draft, self._at(name), options)
        except Exception as exc:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(exc):
                raise FileExistsError(f"{self.path}/{name} is taken") from exc
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
