"""Positional selections: masks, index lists and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AnnotatedMatrix
from ..params import Direction


def select_mask(am: AnnotatedMatrix, direction: Direction, mask: Column | str | None) -> DataFrame:
    """Ids whose boolean mask is true; None selects all, a null is false."""
    axis = am.axis(direction)
    if mask is None:
        return axis.select(direction.key)
    mask = F.col(mask) if isinstance(mask, str) else mask
    return axis.where(F.coalesce(mask, F.lit(False))).select(direction.key)


def select_indices(am: AnnotatedMatrix, direction: Direction, indices: list[int]) -> DataFrame:
    """(key, out_pos) in the order given. Raises for an id that the axis lacks or that comes twice."""
    key = direction.key
    if len(set(indices)) != len(indices):
        raise ValueError("an index comes twice")
    schema = f"{key} long, out_pos long"
    chosen = am.x.sparkSession.createDataFrame([(int(v), i) for i, v in enumerate(indices)], schema)
    found = am.axis(direction).where(F.col(key).isin([int(v) for v in indices])).select(key).distinct().count() if indices else 0
    if found != len(indices):
        raise IndexError("an index lies outside the axis")
    return chosen


def select_slice(am: AnnotatedMatrix, direction: Direction, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """Ids start, start + step, ... below end. An empty axis gives an empty selection."""
    if start < 0 or step < 1 or (end is not None and end < start):
        raise ValueError("a slice needs 0 <= start <= end and step >= 1")
    key = F.col(direction.key)
    bound = am.axis(direction).agg(F.max(key)).first()[0]
    if bound is not None and (start > bound or (end is not None and end > bound + 1)):
        raise IndexError("the slice lies outside the axis")
    keep = (key >= start) & (F.pmod(key - start, F.lit(step)) == 0)
    return am.axis(direction).where(keep if end is None else keep & (key < end)).select(direction.key)
