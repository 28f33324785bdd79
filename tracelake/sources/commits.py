"""A folder of numbered commits: each is one small JSON file that appears whole, under a number that only one writer gets."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import SparkSession


class CommitLog:
    """Commits 1, 2, 3 and so on below a folder of any file system that Spark knows.

    A commit is written beside the log and moved to its number by a rename that refuses to replace, so that readers see
    whole commits only, and a writer that lost its number is told so. A writer that dies before the rename leaves the
    log as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs_package = jvm.org.apache.hadoop.fs
        self._gateway = spark.sparkContext._gateway
        self.path = path
        self._folder = self._fs_package.Path(path)
        self._fs = self._folder.getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """The numbers of all commits, in order."""
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _file(self, number: int):
        return self._fs_package.Path(f"{self.path}/{number:020d}.json")

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._file(number))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """The last number and what was committed under it; 0 and None if there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def commit(self, number: int, entry: dict) -> bool:
        """Put entry under number; False if another writer has it."""
        draft = self._fs_package.Path(f"{self.path}/.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        files = self._fs_package.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(draft, self._file(number), self._gateway.new_array(self._fs_package.Options.Rename, 0))
        except Exception as e:
            if not self._fs.exists(self._file(number)):
                raise
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def delete(self, number: int) -> None:
        self._fs.delete(self._file(number), False)


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder with all it holds, on any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def child_folders(spark: SparkSession, path: str, older_than: datetime | None = None) -> list[str]:
    """The names of the folders right below a folder, or of those last changed before a time (in UTC, if it has no zone)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    until = None if older_than is None else 1000 * (older_than if older_than.tzinfo else older_than.replace(tzinfo=UTC)).timestamp()
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and (until is None or s.getModificationTime() < until)]
