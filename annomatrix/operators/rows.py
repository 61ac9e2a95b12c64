"""A QR decomposition of very many rows: each task keeps one triangle, and triangles are merged in a tree.

The rows get a leading one. So the first row of the triangle holds the number of rows and the means, and the rest is the
triangle of the centred rows: neither a squared matrix nor a difference of large sums is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AnnotatedMatrix
from ..storage import drop, stored
from .dense import DENSE_CELLS

#: Triangles that one task of the tree stacks: at 1024 variables some 8 MB each.
FAN = 8
FACTOR = "node long, r array<double>"


def observations(am: AnnotatedMatrix, columns: DataFrame | None = None) -> DataFrame:
    """(obs_idx, entries): each observation's entries as an array of (var_idx, value), empty without any; of the variables
    in columns, or of all."""
    x = am.x if columns is None else am.x.join(columns.select("var_idx"), "var_idx", "left_semi")
    entry = F.struct(F.col("var_idx").cast("long").alias("var_idx"), F.col("value").cast("double").alias("value"))
    lists = x.groupBy("obs_idx").agg(F.collect_list(entry).alias("entries"))
    return am.obs.select("obs_idx").join(lists, "obs_idx", "left").select("obs_idx", F.coalesce("entries", F.array().cast("array<struct<var_idx:bigint,value:double>>")).alias("entries"))


def known_variables(rows: DataFrame, column: str, most: int) -> np.ndarray:
    """The ids that occur in an entries column, in ascending order; an error if there are more than most."""
    entry = rows.select(F.explode(rows[column]).alias("e")).select(F.col("e.var_idx").cast("long").alias("var_idx"))
    found = entry.where("var_idx is not null").distinct().limit(most + 1).toArrow().column("var_idx").to_numpy()
    if len(found) > most:
        raise ValueError(f"more than {most} variables")
    return np.sort(found)


def dense_rows(lists: pa.Array, ids: np.ndarray) -> np.ndarray:
    """One row per list, one column per id. Entries of other variables are left out, repeated ones are added up, and null
    lists and values count as zeros."""
    out = np.zeros(len(lists) * len(ids))
    many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    var = pc.fill_null(flat.field("var_idx"), -1).to_numpy(zero_copy_only=False)
    value = pc.fill_null(flat.field("value"), 0.0).to_numpy(zero_copy_only=False)
    if len(ids) and len(var):
        at = np.searchsorted(ids, var).clip(max=len(ids) - 1)
        known = ids[at] == var
        cell = np.repeat(np.arange(len(lists)), many) * len(ids) + at
        out = np.bincount(cell[known], value[known].astype(float), minlength=len(out))
    return out.reshape(len(lists), len(ids))


def _leaves(rows: DataFrame, column: str, ids: np.ndarray) -> DataFrame:
    width = len(ids) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, step = np.zeros((0, width)), max(width, DENSE_CELLS // width)
        for batch in batches:
            for lo in range(0, len(batch), step):
                x = dense_rows(batch.column(0).slice(lo, step), ids)
                r = np.linalg.qr(np.vstack([r, np.hstack([np.ones((len(x), 1)), x])]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["node", "r"])

    return rows.select(column).mapInArrow(run, FACTOR)


def _merged(factors: DataFrame, width: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py() // FAN
        parts = [np.asarray(v.values) for v in table.sort_by("node").column("r")]
        r = np.linalg.qr(np.concatenate(parts).reshape(-1, width), mode="r")
        return pa.table({"node": pa.array([node], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    return factors.groupBy(F.expr(f"node div {FAN}")).applyInArrow(run, FACTOR)


@dataclass(frozen=True)
class RowFactor:
    """The triangle of the rows with a leading one. n: rows; mean and deviation (population) of each variable, implicit
    zeros included, the deviation being 0 where it is below the rounding of a constant."""

    r: np.ndarray

    @property
    def n(self) -> int:
        return round(float(self.r[0, 0]) ** 2)

    @property
    def mean(self) -> np.ndarray:
        return self.r[0, 1:] / self.r[0, 0]

    @property
    def deviation(self) -> np.ndarray:
        own, size = (np.linalg.norm(self.r[lo:, 1:], axis=0) / np.sqrt(self.n) for lo in (1, 0))
        return np.where(own > 1e-12 * size, own, 0.0)

    def inverse(self, scale: bool) -> np.ndarray:
        """What a variable is multiplied by: 1, or one over its deviation and 0 for a constant."""
        s = self.deviation
        return np.divide(1.0, s, out=np.zeros(len(s)), where=s > 0) if scale else np.ones(len(s))

    def prepared(self, center: bool, scale: bool) -> np.ndarray:
        """A small matrix with the singular values and right vectors of the rows, centred and scaled as asked."""
        return (self.r[1:, 1:] if center else self.r[:, 1:]) * self.inverse(scale)


def tall_qr(rows: DataFrame, column: str, ids: np.ndarray) -> RowFactor:
    """The triangle of all rows of an entries column over the variables ids. Each task turns its rows into one triangle,
    written once; each further round stacks FAN of them. What moves is a triangle per task, whatever the rows.

    Rows without entries count. No rows, or a value that is not finite, are an error."""
    width = len(ids) + 1
    leaves = stored(_leaves(rows, column, ids))
    try:
        last, factors = leaves.agg(F.max("node")).first()[0], leaves
        if last is None:
            raise ValueError("there are no rows")
        while True:
            factors, last = _merged(factors, width), last // FAN
            if not last:
                break
        found = np.asarray(factors.first().r).reshape(-1, width)
    finally:
        drop(leaves)
    if not np.isfinite(found).all():
        raise ValueError("values are finite")
    r = np.zeros((width, width))
    r[: len(found)] = found
    return RowFactor(r * np.where(r[0, 0] < 0, -1.0, 1.0))
