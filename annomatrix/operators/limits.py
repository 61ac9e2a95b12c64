"""Limits on counts and sums, and the exact interpolated quantiles that relative ones need."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Absolute, Limit, Relative, Unbounded


def check(limit: Limit) -> Limit:
    if not isinstance(limit, Absolute | Relative | Unbounded):
        raise TypeError("a limit is Absolute, Relative or Unbounded")
    return limit


def predicate(lower: Limit, upper: Limit) -> Column:
    """Both ends are inclusive and independent; columns count, sum, q_lower and q_upper."""
    keep = F.lit(True)
    for limit, at_least, q in ((lower, True, "q_lower"), (upper, False, "q_upper")):
        if isinstance(limit, Unbounded):
            continue
        value, bound = (F.col("count"), F.lit(limit.value)) if isinstance(limit, Absolute) else (F.col("sum"), F.col(q))
        keep = keep & (value >= bound if at_least else value <= bound)
    return keep


def quantile_row(stats: DataFrame, lower: Limit, upper: Limit, accuracy: int = 10_000) -> DataFrame | None:
    """One row with q_lower and q_upper over every group's sum, in the plan; None if no limit is relative. NaN counts as
    the largest sum.

    A mergeable sketch brackets the two ranks around each quantile. The sums below a bracket are counted as one group,
    so that only the distinct ones inside, some 4/accuracy of the axis, meet in one task."""
    ps = [(n, x.p) for n, x in (("q_lower", lower), ("q_upper", upper)) if isinstance(x, Relative)]
    if not ps:
        return None
    size = F.when(F.isnan("sum"), F.lit(float("inf"))).otherwise(F.col("sum"))
    slack = 2.0 / accuracy
    around = [e for _, p in ps for e in (max(0.0, p - slack), min(1.0, p + slack))]
    brackets = stats.agg(F.count("sum").alias("n"), F.percentile_approx(size, around, accuracy).alias("ends"))
    end = lambda i: F.col("ends")[i]
    starts = [end(2 * i) for i in range(len(ps))]
    inside = reduce(Column.__or__, [size.between(a, end(2 * i + 1)) for i, a in enumerate(starts)])
    above = F.array_min(F.array(*[F.when(size < a, a) for a in starts]))
    near = stats.select("sum").join(F.broadcast(brackets)).withColumn("exact", inside)  # one row
    near = near.select(F.when(F.col("exact"), F.col("sum")).otherwise(above).alias("s"), "exact", "n").where("s is not null")
    counted = near.groupBy("s", "exact", "n").agg(F.count(F.lit(1)).alias("times"))
    seen = counted.withColumn("seen", F.sum("times").over(Window.orderBy("s", "exact")))
    found, out = [], []
    for name, p in ps:
        at = F.lit(p) * (F.col("n") - 1)
        low, high = (F.min(F.when(F.col("seen") > f(at), F.col("s"))) for f in (F.floor, F.ceil))
        found += [low.alias(f"{name}_low"), high.alias(f"{name}_high"), F.max(at - F.floor(at)).alias(f"{name}_part")]
        low, high, part = (F.col(f"{name}_{c}") for c in ("low", "high", "part"))
        out.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    return seen.agg(*found).select(*out)


def bracketed(values: DataFrame, column: str, p: float, accuracy: int = 10_000) -> float | None:
    """The same quantile as a number, found by jobs of its own. A mergeable sketch brackets the two neighbouring ranks, one
    pass counts what lies below the bracket, and only the distinct values inside it, some 8/accuracy of all, are
    sorted. None for no values."""
    slack = 2.0 / accuracy
    ends = F.percentile_approx(column, [max(0.0, p - slack), min(1.0, p + slack)], accuracy)
    n, bounds = values.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)), ends).first()
    if not n:
        return None
    a, b = bounds
    rank = p * (n - 1)
    below = values.where(F.col(column) < a).count()
    inside = values.where(F.col(column).between(a, b)).groupBy(column).count().orderBy(column)
    found, seen = [], below
    wanted = [floor(rank), ceil(rank)]
    for value, times in inside.toLocalIterator():
        while wanted and wanted[0] < seen + times:
            found.append(value)
            wanted.pop(0)
        seen += times
        if not wanted:
            break
    return found[0] + (found[1] - found[0]) * (rank - floor(rank))
