"""Filters of observations and variables by stored-entry count or by a quantile of the sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AnnotatedMatrix
from ..params import Direction, Limit, Relative, Unbounded
from .limits import bracketed, check, predicate, quantile_row
from .stats import axis_stats


def kept_ids(am: AnnotatedMatrix, direction: Direction, lower: Limit, upper: Limit, huge_axis: bool = False) -> DataFrame:
    """Ids within both limits. Empty groups count as 0 entries of sum 0, also for the quantiles. huge_axis finds
    the quantiles by jobs of their own, whose plan then holds numbers; the result is the same."""
    lower, upper = check(lower), check(upper)
    if isinstance(lower, Unbounded) and isinstance(upper, Unbounded):
        return am.axis(direction).select(direction.key)
    stats = axis_stats(am, direction, ("count", "sum"))
    if huge_axis:
        for name, limit in (("q_lower", lower), ("q_upper", upper)):
            if isinstance(limit, Relative):
                stats = stats.withColumn(name, F.lit(bracketed(stats, "sum", limit.p)).cast("double"))
    elif (bounds := quantile_row(stats, lower, upper)) is not None:
        stats = stats.join(F.broadcast(bounds))  # one row: an aggregate without keys
    return stats.where(predicate(lower, upper)).select(direction.key)


def filter_obs(am: AnnotatedMatrix, lower: Limit = Unbounded(), upper: Limit = Unbounded(), huge_axis: bool = False) -> AnnotatedMatrix:
    """The bundle with the observations that lie within both limits."""
    return am.subset(Direction.ROW, kept_ids(am, Direction.ROW, lower, upper, huge_axis))


def filter_var(am: AnnotatedMatrix, lower: Limit = Unbounded(), upper: Limit = Unbounded(), huge_axis: bool = False) -> AnnotatedMatrix:
    """The bundle with the variables that lie within both limits."""
    return am.subset(Direction.COLUMN, kept_ids(am, Direction.COLUMN, lower, upper, huge_axis))


filter_cells, filter_genes = filter_obs, filter_var
