"""Loaded tables and prepared sides that several comparisons share.

What is held is known by the path it was read from and by the length and modification time of every
file there, so a table that was written again is read again.  Entries are bounded in number and age; one
that goes is unpersisted.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyweave.config import Comparison
from keyweave.operators.reconcile import Prepared, prepare

#: Seconds and number of entries that are held at most.
AGE, ENTRIES = 300.0, 4


def stamp(spark: SparkSession, path: str) -> tuple:
    """(name, length, modification time) of every file of ``path``, in any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


class LoadCache:
    def __init__(self, spark: SparkSession, age: float = AGE, entries: int = ENTRIES, clock: Callable[[], float] = time.monotonic):
        self.spark, self.age, self.entries, self.clock = spark, age, entries, clock
        #: by what was asked for: the files' stamp, when it was loaded, the value; the least used first
        self._held: OrderedDict[tuple, tuple[tuple, float, DataFrame | Prepared]] = OrderedDict()

    def table(self, path: str, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
        """The table at ``path``, held as it was read; rows are materialised by the first that asks for them."""
        return self._get((path, "table"), path, lambda: (read or self.spark.read.parquet)(path).persist())

    def side(self, path: str, config: Comparison, side: str, read: Callable[[str], DataFrame] | None = None, **options) -> Prepared:
        """The table at ``path`` prepared as a side of comparisons: keyed, normalised and dealt out by key once."""
        return self._get((path, side, repr(config), repr(sorted(options.items()))), path, lambda: prepare((read or self.spark.read.parquet)(path), config, side, **options))

    def _get(self, key: tuple, path: str, load: Callable[[], DataFrame | Prepared]) -> DataFrame | Prepared:
        now, files = self.clock(), stamp(self.spark, path)
        for k in [k for k, (_, since, _) in self._held.items() if now - since > self.age]:
            self._drop(k)
        if key in self._held and self._held[key][0] != files:
            self._drop(key)
        if key not in self._held:
            self._held[key] = (files, now, load())
        self._held.move_to_end(key)
        while len(self._held) > self.entries:
            self._drop(next(iter(self._held)))
        return self._held[key][2]

    def _drop(self, key: tuple) -> None:
        self._held.pop(key)[2].unpersist()

    def clear(self) -> None:
        for key in list(self._held):
            self._drop(key)

    def __len__(self) -> int:
        return len(self._held)
