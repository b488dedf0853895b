"""Commits by marker files: a folder's written data counts once its marker is there."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Commits:
    """Markers in ``folder``/_commits: a name, made once and for all, and what was committed under it.

    A marker is created, never written over: of two writers of one name the file system lets one pass.
    (Where a store's create is not atomic, one writer at a time is needed.)
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = f"{folder}/_commits"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def there(self, name: str) -> bool:
        path = self._path(f"{self.folder}/{name}")
        return self._fs.exists(path) and self._fs.getFileStatus(path).getLen() > 0

    def mark(self, name: str, what: dict) -> bool:
        """Commit ``what`` under a name; False if the name is taken."""
        path = self._path(f"{self.folder}/{name}")
        if self._fs.exists(path) and not self.there(name):
            self._fs.delete(path, False)  # its writer died before it wrote
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as e:
            if self.there(name):
                return False
            raise e
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        return True

    def all(self) -> dict[str, dict]:
        """What is committed by name, without what a later commit ``replaces``."""
        root = self._path(self.folder)
        found = {}
        for status in self._fs.listStatus(root) if self._fs.exists(root) else []:
            if status.getLen():  # without content, its writer died
                source = self._fs.open(status.getPath())
                found[status.getPath().getName()] = json.loads(self._io.toString(source, "UTF-8"))
                source.close()
        gone = {name for what in found.values() for name in what.get("replaces", [])}
        return {name: what for name, what in sorted(found.items()) if name not in gone}

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
