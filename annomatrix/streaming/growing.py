"""All six statistics of a growing matrix, from a state that each batch is merged into.

The state holds, per group and exponent bucket, the number of entries, the integer lanes of their sum and squares, and
their extremes. States add up exactly, so that the statistics have the bits of a single pass over all entries. Each batch
writes a new version of the state beside the last one; a batch that is run again starts from the version before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import AnnotatedMatrix
from ..operators.stats import combined, empty_filled, finished, partial
from ..params import Direction

#: Versions that stay, so that a reader of the last one can end.
KEPT = 3


class GrowingStatistics:
    """Statistics per observation or variable of the entries that add() was given, kept in a folder all machines see. One
    writer at a time; readers may read while it writes. A batch's cost is the batch and the groups, not the entries so far."""

    def __init__(self, spark: SparkSession, folder: str, direction: Direction) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), direction.key
        self.direction = direction

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        root = self._path("state")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n) for n in names if fs.exists(self._path(f"state/{n}/_SUCCESS")))

    def _state(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/state/{version}")

    def add(self, entries: DataFrame, batch: int) -> None:
        """Merges a batch of entries (obs_idx, var_idx, value); pass it to foreachBatch. Batches count up from 0."""
        new = partial(entries, self.key)
        before = [v for v in self.versions() if v < batch]
        if before:
            new = combined(self._state(before[-1]).unionByName(new), self.key)
        new.write.mode("overwrite").parquet(f"{self.folder}/state/{batch}")
        for old in before[: -(KEPT - 1)]:
            path = self._path(f"state/{old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, am: AnnotatedMatrix | None = None) -> DataFrame:
        """The key and the six statistics as of the last complete version: of the groups seen so far or, with a bundle, of
        its whole axis. An error before the first batch."""
        if not (known := self.versions()):
            raise ValueError("no batch was added yet")
        found = finished(self._state(known[-1]), self.key)
        return found if am is None else empty_filled(am, self.direction, found)
