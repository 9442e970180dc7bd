"""Small documents in numbered versions: readers see a whole version, writers cannot overwrite each other."""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class VersionConflict(RuntimeError):
    """Somebody else has written the version that was to be written."""


class VersionedDocument:
    """A JSON document under a folder, one file per version, the highest one counts.

    A version is written under its final number only if no file of that number exists, so of two writers that
    started from the same version one fails and can start again from what the other wrote. A file that cannot be
    read as JSON (its writer died) is passed over, and its number is not used again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def _numbers(self) -> list[int]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def read(self) -> tuple[int, dict]:
        """Number of the last version (0 if there is none) and the newest readable document."""
        numbers = self._numbers()
        for number in reversed(numbers):
            stream = self._files.open(self._path(f"{number:010d}.json"))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return numbers[-1], json.loads(text)
            except ValueError:
                continue
        return (numbers[-1] if numbers else 0), {}

    def write(self, document: dict, after: int) -> int:
        """Write the version that follows ``after``; ``VersionConflict`` if there is one already."""
        number = after + 1
        try:
            stream = self._files.create(self._path(f"{number:010d}.json"), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                raise VersionConflict(f"{self.folder}: version {number}") from error
            raise
        try:
            stream.write(bytearray(json.dumps(document).encode()))
        finally:
            stream.close()
        return number

    def update(self, change: Callable[[dict], dict], attempts: int = 20) -> dict:
        """Apply ``change`` to the newest document and write it, again if others were faster."""
        for _ in range(attempts):
            number, document = self.read()
            changed = change(document)
            try:
                self.write(changed, number)
                return changed
            except VersionConflict:
                continue
        raise VersionConflict(f"{self.folder}: {attempts} attempts")
