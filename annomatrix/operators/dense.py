"""Dense rows: one array of doubles per observation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AnnotatedMatrix
from ..params import FeatureSelection
from .features import select_features

#: Numbers of dense rows that a task writes at once.
DENSE_CELLS = 1 << 21


def scatter(cells: pa.Array, width: int) -> np.ndarray:
    """A matrix with one row per list of (out_pos, value); a null list is a row of zeros."""
    out = np.zeros((len(cells), width))
    many = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
    flat = cells.flatten()
    out[np.repeat(np.arange(len(cells)), many), flat.field("out_pos").to_numpy()] = flat.field("value").to_numpy()
    return out


def cell_lists(x: DataFrame) -> DataFrame:
    """(obs_idx, cells): the entries (obs_idx, out_pos, value) of each observation."""
    return x.groupBy("obs_idx").agg(F.collect_list(F.struct(F.col("out_pos").cast("long").alias("out_pos"), F.col("value").cast("double").alias("value"))).alias("cells"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        width = batch.column("width")[0].as_py() if len(batch) else 0
        step = max(1, DENSE_CELLS // max(1, width))
        for lo in range(0, len(batch), step):
            part = batch.slice(lo, step)
            dense = scatter(part.column("cells"), width)
            offsets = pa.array(np.arange(0, dense.size + 1, width) if width else np.zeros(len(part) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("obs_idx"), pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()))], names=["obs_idx", "vec"])


def to_dense_selected(am: AnnotatedMatrix, columns: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """columns: (var_idx, out_pos), positions dense from 0; rows: (obs_idx), all by default. Returns (obs_idx, vec)
    with 0.0 where nothing is stored. Entries are gathered per observation and written into rows of zeros, so nothing
    of the size rows x columns is shuffled, and a row costs its width and its entries."""
    width = columns.agg(F.count(F.lit(1)).cast("int").alias("width"))
    axis = am.obs.select("obs_idx") if rows is None else rows.select("obs_idx")
    x = am.x.join(columns.select("var_idx", "out_pos"), "var_idx")
    if rows is not None:
        x = x.join(axis, "obs_idx", "left_semi")
    full = axis.join(cell_lists(x), "obs_idx", "left").join(F.broadcast(width))  # one row: an aggregate without keys
    return full.select("obs_idx", "cells", "width").mapInArrow(_vectors, "obs_idx long, vec array<double>")


def to_dense(am: AnnotatedMatrix) -> DataFrame:
    """Every variable, in the order of var_idx."""
    return to_dense_selected(am, select_features(am, FeatureSelection.everything()))
