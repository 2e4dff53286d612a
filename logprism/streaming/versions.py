"""Which folders make up a store's tables: small JSON files, one per version, each written once."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has made the next version."""


class Versions:
    """The versions of a store below ``path``, on any storage that Hadoop reaches.

    A version is written under a name of its own and renamed, which fails if the name is
    taken; so readers see whole versions only, and of two writers one must start again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._conf)
        self._files.mkdirs(self._at(""))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        names = [status.getPath().getName() for status in self._files.listStatus(self._at(""))]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and name[0] != "_")

    def latest(self) -> tuple[int, dict]:
        """Number and content of the newest version; -1 and nothing before the first."""
        numbers = self.numbers()
        if not numbers:
            return -1, {}
        text = self.spark.read.text(f"{self.path}/{numbers[-1]:012d}.json", wholetext=True).first()[0]
        return numbers[-1], json.loads(text)

    def commit(self, after: int, state: dict) -> None:
        """Write the version that follows ``after``."""
        draft, final = self._at(f"_{uuid.uuid4().hex}"), self._at(f"{after + 1:012d}.json")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._files.makeQualified(draft), self._files.makeQualified(final), no_options)
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(final.toString()) from None
            raise

    def remove(self, folders: list[str]) -> None:
        """Delete folders of the store that no version names any more."""
        for folder in folders:
            self._files.delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)

    def forget(self, keep: int = 10) -> None:
        """Delete all versions but the last ones."""
        for number in self.numbers()[:-keep]:
            self._files.delete(self._at(f"{number:012d}.json"), False)
