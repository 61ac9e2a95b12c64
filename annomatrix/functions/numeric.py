"""Column expressions with IEEE results where Spark's own give null or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def log1p_ieee(v: Column) -> Column:
    """ln(1 + v): -inf at -1 and NaN below, where Spark's log1p gives null. A null stays null."""
    v = v.cast("double")
    return F.when(v == -1.0, F.lit(-INF)).when(v < -1.0, F.lit(NAN)).otherwise(F.log1p(v))


def skip_nan(v: Column) -> Column:
    """v, or null for NaN, so that min and max pass over it; Spark orders NaN above everything else."""
    return F.when(~F.isnan(v), v)


def finite(v: Column) -> Column:
    """v, or null where it is NaN or infinite."""
    return F.when(~F.isnan(v) & (F.abs(v) != INF), v)
