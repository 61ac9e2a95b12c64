"""Entries of a matrix in compressed blocks: one row holds many entries of neighbouring observations or variables.

A block has the ids of its major axis that have entries in it (ids), where each one's entries begin and the last one's end
(offsets, from 0), and the minor ids and values of all of them (indices, vals). Blocks are cut at a number of entries, not of
ids, from rows sorted by both ids, so that an observation with a third of all entries is spread over many blocks and tasks.
Columns are read apart: counts along the major axis need ids and offsets only, along the minor axis indices only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LAYOUTS, AnnotatedMatrix
from ..operators.stats import axis_stats, empty_filled
from ..params import Direction

#: Entries of a block at most: some 1 MB of indices and values.
BLOCK_ENTRIES = 1 << 16
BLOCK = "first long, last long, ids array<long>, offsets array<int>, indices array<long>, vals array<double>"


def _axes(layout: str) -> tuple[str, str]:
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {LAYOUTS}")
    return ("obs_idx", "var_idx") if layout == "csr" else ("var_idx", "obs_idx")


def _block(rows: pa.Table) -> pa.RecordBatch:
    major = rows.column(0).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], major[1:] != major[:-1]]))
    offsets = np.append(starts, len(major)).astype(np.int32)
    whole = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, kind))
    minor, vals = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    arrays = [whole(major[starts], pa.int64()), whole(offsets, pa.int32()), whole(minor, pa.int64()), whole(vals, pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(major[:1]), pa.array(major[-1:]), *arrays], names=["first", "last", "ids", "offsets", "indices", "vals"])


def _packer(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, most - n)
                held.append(part)
                n, at = n + len(part), at + len(part)
                if n == most:
                    yield _block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield _block(pa.Table.from_batches(held))

    return run


def _packed(x: DataFrame, layout: str, block_entries: int) -> DataFrame:
    if block_entries < 1:
        raise ValueError("a block holds one entry at least")
    major, minor = _axes(layout)
    x = x.select(*[F.col(c).cast("long").alias(c) for c in (major, minor)], F.col("value").cast("double").alias("value")).dropna()
    return x.repartitionByRange(major, minor).sortWithinPartitions(major, minor).mapInArrow(_packer(block_entries), BLOCK)


@dataclass(frozen=True)
class BlockMatrix:
    """Blocks of one layout, 'csr' by observation or 'csc' by variable, with the tables of both axes. Nothing is evaluated
    until an action; write() and read_blocks() keep blocks as Parquet."""

    blocks: DataFrame
    obs: DataFrame
    var: DataFrame
    layout: str = "csr"

    @property
    def major(self) -> str:
        return _axes(self.layout)[0]

    @property
    def minor(self) -> str:
        return _axes(self.layout)[1]

    def _runs(self, *arrays: str) -> DataFrame:
        """(id, n, *arrays): for each id of a block, its number of entries and its part of the arrays."""
        at = lambda i: F.get("offsets", i)

        def run(i: Column) -> Column:
            n = at(i + 1) - at(i)
            return F.struct(F.get("ids", i).alias("id"), n.alias("n"), *[F.slice(F.col(a), at(i) + 1, n).alias(a) for a in arrays])

        return self.blocks.select(F.inline(F.transform(F.sequence(F.lit(0), F.size("ids") - 1), run)))

    def entries(self) -> DataFrame:
        """The entries as obs_idx, var_idx, value, in the order of their blocks."""
        pairs = F.arrays_zip(F.col("indices"), F.col("vals"))
        x = self._runs("indices", "vals").select(F.col("id").alias(self.major), F.inline(pairs))
        return x.select(*[F.col({self.major: self.major, self.minor: "indices"}[k]).alias(k) for k in ("obs_idx", "var_idx")], F.col("vals").alias("value"))

    def matrix(self) -> AnnotatedMatrix:
        return AnnotatedMatrix(self.entries(), self.obs, self.var, layout=self.layout)

    def counts(self, direction: Direction) -> DataFrame:
        """The key and count of stored entries of the whole axis, from offsets along the layout's own axis and from indices
        across it; values are not read."""
        if direction.key == self.major:
            found = self._runs().groupBy(F.col("id").alias(direction.key)).agg(F.sum(F.col("n").cast("long")).alias("count"))
        else:
            found = self.blocks.select(F.explode("indices").alias(direction.key)).groupBy(direction.key).agg(F.count(F.lit(1)).alias("count"))
        return empty_filled(AnnotatedMatrix(self._no_entries(), self.obs, self.var, layout=self.layout), direction, found, ("count",))

    def _no_entries(self) -> DataFrame:
        return self.blocks.sparkSession.createDataFrame([], "obs_idx long, var_idx long, value double")

    def stats(self, direction: Direction, which: tuple[str, ...]) -> DataFrame:
        """As axis_stats(); a count alone comes from counts()."""
        return self.counts(direction) if tuple(which) == ("count",) else axis_stats(self.matrix(), direction, which)

    def chunks(self) -> DataFrame:
        """One row per block: the first and last id of its major axis, how many ids and how many entries it has. Neighbouring
        blocks share an id whose entries a cut divides."""
        return self.blocks.select("first", "last", F.size("ids").alias("n_ids"), F.element_at("offsets", -1).alias("n_entries"))

    def between(self, low: int, high: int) -> DataFrame:
        """Entries of the major ids from low to high, both included. Blocks outside are skipped by the statistics of first
        and last, and of the blocks at the edges the ids outside are cut off."""
        inside = BlockMatrix(self.blocks.where((F.col("last") >= low) & (F.col("first") <= high)), self.obs, self.var, self.layout)
        return inside.entries().where(F.col(self.major).between(low, high))

    def turned(self, block_entries: int = BLOCK_ENTRIES) -> BlockMatrix:
        """The same entries by the other axis, with one shuffle of them."""
        other = "csc" if self.layout == "csr" else "csr"
        return BlockMatrix(_packed(self.entries(), other, block_entries), self.obs, self.var, other)

    def write(self, path: str) -> None:
        """Writes to a new path. first and last ascend within a file, so that its row groups cover narrow ranges."""
        self.blocks.write.option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks-{self.layout}")
        self.obs.write.parquet(f"{path}/obs")
        self.var.write.parquet(f"{path}/var")


def to_blocks(am: AnnotatedMatrix, layout: str | None = None, block_entries: int = BLOCK_ENTRIES) -> BlockMatrix:
    """The matrix in blocks of at most block_entries entries. Rows of x with a null coordinate or value are no entries;
    repeated coordinates stay apart; empty observations and variables stay in obs and var. A matrix without entries has
    no blocks. Extra columns of x are not kept."""
    layout = layout or am.layout
    return BlockMatrix(_packed(am.x, layout, block_entries), am.obs, am.var, layout)


def read_blocks(spark: SparkSession, path: str, layout: str = "csr") -> BlockMatrix:
    """What write() left at path."""
    _axes(layout)
    return BlockMatrix(spark.read.schema(BLOCK).parquet(f"{path}/blocks-{layout}"), spark.read.parquet(f"{path}/obs"), spark.read.parquet(f"{path}/var"), layout)
