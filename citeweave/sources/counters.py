"""Counters of identifiers' numbers that outlive a run: no number is ever given twice."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

#: How often a claim that another run is just writing is looked at, and the seconds between.
LOOKS, PAUSE = 50, 0.1


class MemoryCounters:
    """Counters that last as long as this object."""

    def __init__(self):
        self.last: dict[tuple[str, str], int] = {}

    def reserve(self, kind: str, prefix: str, n: int, above: int = 0) -> int:
        """The first of ``n`` numbers in a row, above all given so far and above ``above``."""
        first = max(self.last.get((kind, prefix), 0), above) + 1
        self.last[kind, prefix] = first + n - 1
        return first


class StoredCounters:
    """Counters in a folder that all runs share, by kind and prefix.

    A claim is a file that is created only if it isn't there, named by its place in the row of claims, with the last number
    it takes. A run gives numbers out once its claim is written, so runs at one time never share a number. Tasks get theirs
    from one claim by the counts of their partitions.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _claims(self, folder: str) -> list[int]:
        where = self.path(folder)
        return sorted(int(s.getPath().getName()) for s in self.files.listStatus(where)) if self.files.exists(where) else []

    def _said(self, claim: str) -> int:
        for _ in range(LOOKS):
            opened = self.files.open(self.path(claim))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
            opened.close()
            if text.endswith("\n"):
                return int(text)
            time.sleep(PAUSE)
        raise TimeoutError(f"{claim} was never finished: delete it if no run is at it")

    def reserve(self, kind: str, prefix: str, n: int, above: int = 0) -> int:
        """The first of ``n`` numbers in a row, above all given so far and above ``above``; with 0 the counter is raised only."""
        folder = f"{self.folder}/{kind}/{prefix or '_'}"
        while True:
            claims = self._claims(folder)
            last = self._said(f"{folder}/{claims[-1]:019d}") if claims else 0
            first = max(last, above) + 1
            if first + n - 1 == last:
                return first
            claim = self.path(f"{folder}/{(claims[-1] if claims else 0) + 1:019d}")
            if self._create(claim, first + n - 1):
                for old in claims[:-1]:  # the newest claims say all
                    self.files.delete(self.path(f"{folder}/{old:019d}"), False)
                return first

    def _create(self, claim, last: int) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            out = self.files.create(claim, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        out.write(bytearray(f"{last}\n".encode()))
        out.close()
        return True
