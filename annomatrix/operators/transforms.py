"""Scaling to a total, and ln(1 + x)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import log1p_ieee
from ..model import AnnotatedMatrix
from ..params import Direction


def normalize_total(am: AnnotatedMatrix, target: float = 1e4, direction: Direction = Direction.ROW) -> AnnotatedMatrix:
    """Scales each group's entries to sum to target; where they sum to exactly 0 they become 0 and stay stored.

    The sums are aggregated on the map side and joined back, so a huge group is never gathered in one task."""
    key = direction.key
    sums = am.x.groupBy(key).agg(F.sum(F.col("value").cast("double")).alias("total"))
    factor = F.when(F.col("total") == 0.0, F.lit(0.0)).otherwise(F.lit(float(target)) / F.col("total"))
    x = am.x.join(sums.select(key, factor.alias("factor")), key)
    return am.with_x(x.select("obs_idx", "var_idx", (F.col("value") * F.col("factor")).alias("value")))


def log1p(am: AnnotatedMatrix) -> AnnotatedMatrix:
    """ln(1 + value) of stored entries: -inf at -1, NaN below. The result is double whatever the input."""
    return am.with_x(am.x.withColumn("value", log1p_ieee(F.col("value"))))
